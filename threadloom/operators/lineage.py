"""History that child sessions copied from their parents: find it, merge it, drop it.

A child session re-records its ancestors' conversation. A child's unit goes only when an ancestor
holds the same question (same message ids, same text) and can take over whatever the copy has
more of; otherwise it stays and is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import present, sha
from ..functions.tokens import FIELDS
from ..session import stage
from .scan import cut_hot, max_before, running, sum_upto

UID = ["file_id", "pair"]


@dataclass
class Lineage:
    """``units``: survivors with merged data; ``removed``/``conflicts``: (file_id, pair, …)."""

    units: DataFrame
    removed: DataFrame
    conflicts: DataFrame


def threads(sessions: DataFrame) -> DataFrame:
    """One row per thread id: the session discovered first. Sessions without an id are left out."""
    found = F.struct("root_rank", "file_id")
    row = F.struct("file_id", "parent_thread", "lineage_id", "is_sub")
    named = sessions.where(F.col("thread_id") != "")
    return named.groupBy("thread_id").agg(F.min_by(row, found).alias("t")).select("thread_id", "t.*")


def thread_ancestors(known: DataFrame) -> DataFrame:
    """(id, ancestor, step): the ancestors of every thread, nearest first from step 1 on, by pointer doubling.

    After k rounds the table holds all ancestors up to step 2**k; those at exactly that step carry the next round, so the
    rounds grow with the logarithm of the depth. A walk that comes back to an id stops there, as an ancestor keeps
    its least step and no thread is its own ancestor.
    """
    ids = known.select(F.col("thread_id").alias("ancestor"))
    up = known.select(F.col("thread_id").alias("id"), F.col("parent_thread").alias("ancestor"))
    reach = stage(up.where("id <> ancestor").join(ids, "ancestor").select("id", "ancestor", F.lit(1).alias("step")), "ancestors")
    length = 1
    while not reach.where(F.col("step") == length).isEmpty():
        far = reach.where(F.col("step") == length).select("id", F.col("ancestor").alias("_via"))
        more = far.join(reach.select(F.col("id").alias("_via"), "ancestor", "step"), "_via")
        more = more.where("id <> ancestor").select("id", "ancestor", (F.col("step") + length).alias("step"))
        both = reach.unionByName(more).groupBy("id", "ancestor").agg(F.min("step").alias("step"))
        reach = stage(both, "ancestors")
        length *= 2
    return reach


def ancestor_closure(sessions: DataFrame) -> DataFrame:
    """(file_id, step, ancestor, is_root): ancestors of every subagent session, nearest first.

    ``sessions``: file_id, root_rank, thread_id, parent_thread, lineage_id, is_sub. The walk ends
    at a missing parent and at a repeated id, however deep; the lineage root, marked ``is_root``,
    comes one step after the last ancestor unless the walk met it.
    """
    known = stage(threads(sessions), "threads")
    above = thread_ancestors(known)
    subs = sessions.where("is_sub").select("file_id", "thread_id", "lineage_id", "parent_thread")
    named = known.select(F.col("thread_id").alias("ancestor"), F.col("file_id").alias("_file"))
    own = F.col("ancestor").eqNullSafe(F.col("thread_id"))
    slim = subs.select("file_id", "thread_id", "parent_thread")
    first = slim.withColumnRenamed("parent_thread", "ancestor").withColumn("step", F.lit(0))
    later = slim.join(above.withColumnRenamed("id", "parent_thread"), "parent_thread")
    walk = first.unionByName(later.select(*first.columns))
    # A session that is not its thread's first may meet its own id on the way up: the walk ends there.
    ends = F.min(F.when(own, F.col("step"))).over(Window.partitionBy("file_id"))
    walk = walk.withColumn("_end", ends).where("_end IS NULL OR step < _end").join(named, "ancestor")
    walk = stage(walk.select("file_id", "step", "ancestor", "_file"), "walks")
    depth = walk.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("step"))
    roots = subs.where(~F.col("lineage_id").eqNullSafe(F.col("thread_id"))).select("file_id", F.col("lineage_id").alias("ancestor"))
    roots = roots.join(named, "ancestor").join(walk.select("file_id", "ancestor"), ["file_id", "ancestor"], "left_anti")
    roots = roots.join(depth, "file_id", "left").select(
        "file_id", F.coalesce("step", F.lit(0)).alias("step"), F.col("_file").alias("ancestor"), F.lit(True).alias("is_root"))
    found = walk.select("file_id", "step", F.col("_file").alias("ancestor"), F.lit(False).alias("is_root"))
    return roots.unionByName(found)


def processing_groups(sessions: DataFrame, closure: DataFrame) -> DataFrame:
    """(file_id, depth, slot): subagents in the order they are reduced.

    Fewer ancestors first, then thread id. Sessions of equal depth are independent unless one is an
    ancestor of another; then a new slot starts at the later one.
    """
    depth = closure.groupBy("file_id").agg(F.count(F.lit(1)).alias("depth"))
    subs = sessions.where("is_sub").join(depth, "file_id").select("file_id", "thread_id", "depth")
    a, b = subs.alias("a"), subs.alias("b")
    related = (
        closure.alias("c")
        .join(a, F.col("a.file_id") == F.col("c.file_id"))
        .join(b, F.col("b.file_id") == F.col("c.ancestor"))
        .where((F.col("a.depth") == F.col("b.depth")) & (F.col("a.file_id") != F.col("b.file_id")))
        .select(F.col("a.depth").alias("depth"),
                F.greatest("a.thread_id", "b.thread_id").alias("cut"))
        .distinct()
    )
    if related.isEmpty():
        return subs.withColumn("slot", F.lit(0).cast("bigint"))
    # A session's slot is the number of cuts at or before its thread id.
    marks = related.select(
        F.lit(None).cast("string").alias("file_id"), F.col("cut").alias("thread_id"), "depth"
    )
    rows = subs.select("file_id", "thread_id", "depth").unionByName(marks)
    rows = rows.withColumn("_is_file", F.col("file_id").isNotNull())
    rows, order = cut_hot(rows, ["depth"], ["thread_id", "_is_file", "file_id"])
    cut = F.when(F.col("_is_file"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    rows = running(rows, order, slot=sum_upto(cut)).where("_is_file")
    return rows.select("file_id", "thread_id", "depth", "slot")


def subsequence(a: Column, b: Column) -> Column:
    """Every element of ``a`` occurs in ``b`` in order."""
    i = F.aggregate(
        b, F.lit(0), lambda i, x: F.when(F.get(a, i) == x, i + 1).otherwise(i)
    )
    return (F.size(a) <= F.size(b)) & (i == F.size(a))


def progress_verdict(t_count: Column, t_sig: Column, s_count: Column, s_sig: Column) -> Column:
    """Whose progress covers the other's: ``target``, ``source`` or ``divergent``."""
    return (
        F.when(s_count == 0, "target")
        .when(t_count == 0, "source")
        .when(subsequence(s_sig, t_sig), "target")
        .when(subsequence(t_sig, s_sig), "source")
        .otherwise("divergent")
    )


def absorbable(t_answer: Column, s_answer: Column, said: Column) -> Column:
    """The target lacks nothing of the copy's answer; ``said``: the target gave it at some point."""
    return (s_answer == "") | (s_answer == t_answer) | (t_answer == "") | said


def replay_matches(children: DataFrame, closure: DataFrame, units: DataFrame) -> DataFrame:
    """Child unit -> the unit of the nearest ancestor with the same replay key and text.

    Columns: file_id, pair (child), target_file, target_pair. The ancestor side is reduced to one
    unit per (file, key, text) first, so a popular key never multiplies.
    """
    key = ["replay_key", "replay_hash"]
    first = (
        units.where(F.col("replay_key") != "")
        .groupBy(F.col("file_id").alias("ancestor"), *key)
        .agg(F.min_by("pair", "ordinal").alias("target_pair"))
    )
    return (
        children.where(F.col("replay_key") != "")
        .select(*UID, *key)
        .join(closure, "file_id")
        .join(first, ["ancestor", *key])
        .groupBy(*UID)
        .agg(F.min_by(F.struct("ancestor", "target_pair"), "step").alias("t"))
        .select(*UID, F.col("t.ancestor").alias("target_file"), "t.target_pair")
    )


def _fold(children: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply children to their targets in order; (judged children, new target states).

    A target changes only when it gains its answer or richer progress. Each round finds, for all
    targets at once, the next child that changes its target, judges every child up to it against
    the state at hand, and goes on with the rest. Children that change nothing, the usual case,
    are all settled in the first round; no target's children are ever gathered.
    """
    target_key = ["target_file", "target_pair"]
    reason = F.when(F.col("absorbs"), F.lit(None)).when(~F.col("ok"), "answer").otherwise("progress")
    out_cols = [*UID, *target_key, "place", "absorbs", reason.alias("reason"), *FIELDS]
    state = stage(targets, "fold-state")
    open_ = stage(children, "fold-open")
    judged: DataFrame | None = None
    while not open_.isEmpty():
        s = open_.join(state, target_key)
        ok = absorbable(F.col("t_answer"), F.col("answer"), F.col("said"))
        s = s.withColumns(
            {
                "ok": ok,
                "verdict": progress_verdict(
                    F.col("t_count"), F.col("t_sig"), F.col("progress_count"), F.col("sig")
                ),
            }
        )
        absorbs = F.col("ok") & (F.col("verdict") != "divergent")
        gains_answer = (F.col("t_answer") == "") & (F.col("answer") != "")
        changes = absorbs & (gains_answer | (F.col("verdict") == "source"))
        s = stage(s.withColumns({"absorbs": absorbs, "changes": changes}), "fold-judged")
        changing = s.where("changes")
        if changing.isEmpty():
            out = s.select(*out_cols, F.lit(False).alias("enriched"))
            return (out if judged is None else judged.unionByName(out)), state
        nxt = (
            changing
            .groupBy(*target_key)
            .agg(
                F.min("place").alias("upto"),
                F.min_by(
                    F.struct("answer", "verdict", "progress_count", "sig", *UID), "place"
                ).alias("c"),
            )
        )
        nxt = stage(nxt, "fold-next")
        s = s.join(nxt.select(*target_key, "upto"), target_key, "left")
        due = F.col("upto").isNull() | (F.col("place") <= F.col("upto"))
        turned = F.coalesce(F.col("changes") & (F.col("place") == F.col("upto")), F.lit(False))
        out = s.where(due).select(*out_cols, turned.alias("enriched"))
        out = stage(out, "fold-out")
        judged = out if judged is None else judged.unionByName(out)
        richer = F.col("c.verdict") == "source"
        state = state.join(nxt, target_key, "left")
        took = F.col("c").isNotNull() & richer
        state = state.select(
            *target_key,
            F.when(F.col("c").isNotNull() & (F.col("t_answer") == ""), F.col("c.answer"))
            .otherwise(F.col("t_answer")).alias("t_answer"),
            F.when(took, F.col("c.progress_count")).otherwise(F.col("t_count")).alias("t_count"),
            F.when(took, F.col("c.sig")).otherwise(F.col("t_sig")).alias("t_sig"),
            F.when(took, F.col("c.file_id")).otherwise(F.col("t_from_file")).alias("t_from_file"),
            F.when(took, F.col("c.pair")).otherwise(F.col("t_from_pair")).alias("t_from_pair"),
            *[F.col(f"t_{f}") for f in FIELDS],
        )
        state = stage(state, "fold-state")
        open_ = stage(s.where(~due).select(*children.columns), "fold-open")
    return judged, state


def _enriched_tokens(judged: DataFrame, state: DataFrame) -> DataFrame:
    """Absorbed children with ``enriched`` also set where they raised one of the target's counts."""
    key = ["target_file", "target_pair"]
    rows = judged.where("absorbs").join(state.select(*key, *[f"t_{f}" for f in FIELDS]), key)
    rows, order = cut_hot(rows, key, ["place"])
    rows = running(rows, order, **{f"m_{f}": max_before(F.col(f)) for f in FIELDS})
    raised = F.lit(False)
    for f in FIELDS:
        before = F.greatest(F.col(f"m_{f}"), F.col(f"t_{f}"))
        raised = raised | F.coalesce(F.col(f) > before, F.col(f).isNotNull() & before.isNull())
    return rows.withColumn("enriched", F.col("enriched") | F.coalesce(raised, F.lit(False)))


def remove_inherited(
    units: DataFrame, sessions: DataFrame, signatures, answers: DataFrame
) -> Lineage:
    """Drop copied history from subagent sessions and merge what only the copies had.

    ``units``: family-B units with ordinal; ``sessions``: file_id, root_rank, thread_id,
    parent_thread, lineage_id, is_sub; ``signatures(units)`` gives (file_id, pair, signature) for
    the units asked about; ``answers``: file_id, pair, hash of every text a unit ever gave as its
    answer. ``progress_file``/``progress_pair`` of a survivor name the unit whose
    progress it shows.
    """
    sessions = stage(sessions, "sessions")
    empty_removed = units.select(*UID).limit(0).withColumn("enriched", F.lit(False))
    empty_conf = units.select(*UID).limit(0).withColumn("reason", F.lit(""))
    pointer = {"progress_file": F.col("file_id"), "progress_pair": F.col("pair")}
    untouched = Lineage(units.withColumns(pointer), empty_removed, empty_conf)
    if sessions.where("is_sub").isEmpty():
        return untouched
    closure = stage(ancestor_closure(sessions), "closure")
    if closure.isEmpty():
        return untouched

    groups = stage(processing_groups(sessions, closure), "groups")
    involved = closure.select("file_id").unionByName(
        closure.select(F.col("ancestor").alias("file_id"))
    ).distinct()
    live = units.where(F.col("replay_key") != "").join(involved, "file_id", "left_semi")
    live = live.select(
        *UID, "ordinal", "replay_key", "replay_hash", "answer", "progress_count",
        *FIELDS,
    ).withColumns(pointer)
    shared = (
        live.groupBy("replay_key", "replay_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    # A key held by one unit only can match nothing.
    live = live.join(shared.select("replay_key", "replay_hash"), ["replay_key", "replay_hash"], "left_semi")
    sig = signatures(live).select(*UID, F.col("signature").alias("sig"))
    none = F.array().cast("array<string>")
    live = stage(
        live.join(sig, UID, "left").withColumn("sig", F.coalesce("sig", none)), "live"
    )
    removed, conflicts = [], []
    # One entry per nesting depth (and slot): as many as sessions nest.
    slots = groups.select("depth", "slot").distinct().orderBy("depth", "slot").toLocalIterator()
    for g in slots:
        now = groups.where((F.col("depth") == g.depth) & (F.col("slot") == g.slot))
        children = live.join(now.select("file_id", "thread_id"), "file_id")
        match = stage(replay_matches(children, closure, live), "matches")
        if match.isEmpty():
            continue
        placed = children.join(match, UID).withColumn(
            "place", F.struct("thread_id", "file_id", "ordinal")
        )
        given = answers.select(
            F.col("file_id").alias("target_file"), F.col("pair").alias("target_pair"),
            F.col("hash").alias("_h"), F.lit(True).alias("_said"),
        ).distinct()
        placed = placed.withColumn("_h", sha(F.col("answer"))).join(
            given, ["target_file", "target_pair", "_h"], "left"
        )
        placed = placed.select(
            *UID, "target_file", "target_pair", "place", "answer", "progress_count", "sig", *FIELDS,
            F.coalesce("_said", F.lit(False)).alias("said"),
        )
        t = live.select(
            F.col("file_id").alias("target_file"), F.col("pair").alias("target_pair"),
            F.col("answer").alias("t_answer"),
            F.col("progress_count").alias("t_count"), F.col("sig").alias("t_sig"),
            F.col("progress_file").alias("t_from_file"), F.col("progress_pair").alias("t_from_pair"),
            *[F.col(f).alias(f"t_{f}") for f in FIELDS],
        ).join(match.select("target_file", "target_pair").distinct(), ["target_file", "target_pair"], "left_semi")
        judged, state = _fold(placed, t)
        gone = stage(_enriched_tokens(judged, state).select(*UID, "target_file", "target_pair", "enriched", *FIELDS), "gone")
        removed.append(gone.select(*UID, "enriched"))
        conflicts.append(judged.where(~F.col("absorbs")).select(*UID, "reason"))
        most = gone.groupBy("target_file", "target_pair").agg(*[F.max(f).alias(f"m_{f}") for f in FIELDS])
        state = state.join(most, ["target_file", "target_pair"], "left").select(
            F.col("target_file").alias("file_id"), F.col("target_pair").alias("pair"),
            F.struct("t_answer", "t_count", "t_sig", "t_from_file", "t_from_pair",
                     *[F.greatest(f"t_{f}", f"m_{f}").alias(f) for f in FIELDS]).alias("n"),
        )
        live = live.join(gone.select(*UID), UID, "left_anti").join(state, UID, "left")
        new = {"answer": "t_answer", "progress_count": "t_count", "sig": "t_sig",
               "progress_file": "t_from_file", "progress_pair": "t_from_pair",
               **{f: f for f in FIELDS}}
        has = F.col("n").isNotNull()
        live = stage(
            live.withColumns(
                {c: F.when(has, F.col(f"n.{s}")).otherwise(F.col(c)) for c, s in new.items()}
            ).drop("n"),
            "live",
        )
    gone = _union(removed, empty_removed)
    clash = _union(conflicts, empty_conf)
    live, dropped, clash = _collapse_siblings(live, clash, sessions, groups)
    gone = gone.unionByName(dropped)
    changed = ["answer", "progress_count", "progress_file", "progress_pair", *FIELDS]
    new = live.select(*UID, F.struct(*changed).alias("n"))
    has = F.col("n").isNotNull()
    out = units.withColumns(pointer).join(new, UID, "left")
    out = out.withColumns(
        {c: F.when(has, F.col(f"n.{c}")).otherwise(F.col(c)) for c in changed}
    ).drop("n")
    out = out.join(gone.select(*UID), UID, "left_anti")
    return Lineage(out, gone, clash)


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.unionByName(p)
    return out


def _collapse_siblings(live, conflicts, sessions, groups):
    """Equal copies kept in several children of one lineage become one; own work is untouched."""
    lineage = F.coalesce(present(F.col("lineage_id")), F.col("parent_thread"))
    info = sessions.select("file_id", lineage.alias("lineage")).where("lineage != ''")
    place = F.struct("depth", "slot", "thread_id", "file_id", "ordinal")
    rows = (
        live.join(conflicts, UID)
        .join(info, "file_id")
        .join(groups, "file_id")
        .withColumn("place", place)
    )
    key = ["lineage", "replay_key", "replay_hash", "_a", "_s"]
    rows = rows.withColumns({"_a": sha(F.col("answer")), "_s": sha(F.to_json("sig"))})
    best = rows.groupBy(*key).agg(
        F.min("place").alias("_first"), *[F.max(f).alias(f"m_{f}") for f in FIELDS]
    )
    rows = stage(rows.join(best, key), "siblings")
    first = F.col("place") == F.col("_first")
    gone = rows.where(~first)
    raised = F.lit(False)
    ordered, order = cut_hot(rows.drop(*[f"m_{f}" for f in FIELDS]), key, ["place"])
    ordered = running(ordered, order, **{f"m_{f}": max_before(F.col(f)) for f in FIELDS})
    for f in FIELDS:
        raised = raised | F.coalesce(
            F.col(f) > F.col(f"m_{f}"), F.col(f).isNotNull() & F.col(f"m_{f}").isNull()
        )
    dropped = ordered.where(~first).select(*UID, raised.alias("enriched"))
    raise_to = rows.where(first).select(*UID, F.struct(*[F.col(f"m_{f}").alias(f) for f in FIELDS]).alias("n"))
    live = live.join(gone.select(*UID), UID, "left_anti").join(raise_to, UID, "left")
    live = live.withColumns(
        {f: F.when(F.col("n").isNotNull(), F.col(f"n.{f}")).otherwise(F.col(f)) for f in FIELDS}
    ).drop("n")
    return live, dropped, conflicts.join(gone.select(*UID), UID, "left_anti")


def former_ids(sessions: DataFrame) -> DataFrame:
    """Subagents once filed under their lineage's id: (file_id, session_id, former_id)."""
    moved = F.col("is_sub") & (F.col("lineage_id") != "") & (F.col("lineage_id") != F.col("session_id"))
    return sessions.where(moved).select("file_id", "session_id", F.col("lineage_id").alias("former_id"))

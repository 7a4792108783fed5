"""From log directories to question units, and the two ways to lay them out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_ms
from ..operators import belonging, dedupe, format_a, format_b, ids, lineage, names, pairs
from ..operators.render import render
from ..operators.scan import cut_dense
from ..params import SOURCE_A, SOURCE_B, Params
from ..session import stage
from ..sources.lines import Lines, bad_lines, read_lines

SESSION_COLUMNS = [
    "source", "file_id", "file_path", "rel_path", "extra_root", "root_dir", "root_rank",
    "subagent_dir", "recognised", "session_id", "session_name", "session_cwd", "file_is_subagent",
    "thread_id", "lineage_id", "parent_thread", "first_cwd",
]


@dataclass
class Parsed:
    """One log family after its only pass over JSON: everything later reads these tables."""

    source: str
    sessions: DataFrame
    entries: DataFrame
    events: DataFrame  # source, file_id, line_no, event
    bad: DataFrame
    content: DataFrame  # file_id, line_no, h1, h2
    lines: Lines | None = None


@dataclass
class Analysis:
    units: DataFrame  # with block_id; hidden ones are gone
    sessions: DataFrame  # belonging sessions, also those without units
    hidden: DataFrame  # source, hidden
    removed: DataFrame
    conflicts: DataFrame
    families: list[Parsed]


def parse_family(lines: Lines, source: str, params: Params) -> Parsed:
    if source == SOURCE_A:
        parsed = stage(format_a.parse_a(lines.df, params), "parsed-a")
        entries = format_a.entries_a(parsed, lines.order).select(*format_a.ENTRY_COLUMNS)
        sessions, events = format_a.sessions_a(parsed), format_a.event_stream_a(parsed)
        entries = stage(entries, "entries-a")
    else:
        parsed = stage(format_b.parse_b(lines.df), "parsed-b")
        ctx = stage(format_b.context(parsed, lines.order, params), "context-b")
        entries = stage(format_b.entries_b(ctx, lines.order, params), "entries-b")
        sessions = format_b.sessions_b(ctx)
        # Entry ids count up in file order, so the emission number orders the stream.
        events = entries.select(
            "source", "file_id", F.col("seq").alias("line_no"),
            F.concat_ws(" ", F.when(F.col("is_assistant"), "assistant").otherwise("user"), "uuid")
            .alias("event"),
        )
    sessions = stage(sessions.select(*SESSION_COLUMNS), "sessions")
    return Parsed(source, sessions, entries, events, bad_lines(parsed),
                  parsed.select("file_id", "line_no", "h1", "h2"), lines)


def unify(units: DataFrame, sessions: DataFrame) -> DataFrame:
    """Units with their session's facts and their place in the session."""
    facts = sessions.select(
        "file_id", "session_id", "session_name", "file_path", "file_is_subagent",
    )
    df = ids.ordinals(units).join(facts, "file_id")
    return df.withColumns(
        {
            "is_subagent": F.col("side") | F.col("file_is_subagent"),
            "ts_ms": to_ms(F.col("ts_raw")),
        }
    ).drop("file_is_subagent")


def analyse(
    spark: SparkSession,
    params: Params,
    index_names: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> Analysis:
    """Read, segment, attribute, repair lineage, hide, identify.

    ``index_names``/``titles``: root_dir, id, name of renamed family-B threads.
    """
    families = []
    for source in params.sources:
        roots = [r for r in params.roots if r.source == source]
        lines = read_lines(spark, roots)
        if lines is None:
            continue
        if source == SOURCE_B:
            lines = Lines(belonging.drop_foreign(lines.df, params), lines.order)
        families.append(parse_family(lines, source, params))
    if not families:
        raise ValueError("no log files under the given roots")
    return attribute(families, params, index_names, titles)


def attribute(families, params, index_names=None, titles=None) -> Analysis:
    """Everything after parsing; cheap to repeat when only names or projects changed."""
    all_units, all_sessions, removed, conflicts = [], [], [], []
    for fam in families:
        rolled = stage(
            pairs.roll_up(fam.entries, params.wants_progress, params.wants_full_progress), "units"
        )
        own = belonging.own_units(rolled, fam.sessions, params)
        sessions = belonging.own_sessions(fam.sessions, own, params)
        renamed = index_names is not None or titles is not None
        if renamed and fam.source == SOURCE_B:
            none = sessions.select("root_dir", F.col("session_id").alias("id"), F.lit("").alias("name")).limit(0)
            sessions = names.resolve(
                sessions, none if index_names is None else index_names,
                none if titles is None else titles,
            )
        sessions = stage(sessions, "sessions")
        units = stage(unify(own, sessions), "unified")
        if fam.source == SOURCE_B:
            found = lineage.remove_inherited(
                units,
                sessions.withColumnRenamed("file_is_subagent", "is_sub"),
                lambda u, e=fam.entries, s=SOURCE_B: pairs.signatures(
                    e, u.select(F.lit(s).alias("source"), "file_id", F.lit(False).alias("side"), "pair")
                ),
                pairs.answers_given(fam.entries),
            )
            moved = _moved_progress(found.units, units)
            units = stage(moved, "merged")
            removed.append(found.removed)
            conflicts.append(found.conflicts)
        all_units.append(units)
        all_sessions.append(sessions)
    units, sessions = _union(all_units), _union(all_sessions)
    shown = stage(belonging.display_filter(units, params), "shown")
    hidden = shown.groupBy("source").agg(F.count_if("hidden").alias("hidden"))
    if shown.isEmpty():
        raise ValueError("no question units: no session matched this project")
    out = ids.block_ids(shown.where("not hidden").drop("hidden"), params.id_prefix)
    return Analysis(
        stage(out, "blocks"), sessions, hidden,
        _union(removed) if removed else None, _union(conflicts) if conflicts else None, families,
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _moved_progress(survivors: DataFrame, units: DataFrame) -> DataFrame:
    """Progress text of the unit a survivor points at."""
    cols = [c for c in ("progress", "progress_full") if c in units.columns]
    if cols:
        text = units.select(
            F.col("file_id").alias("progress_file"), F.col("pair").alias("progress_pair"), *cols
        )
        survivors = survivors.drop(*cols).join(text, ["progress_file", "progress_pair"], "left")
    return survivors.drop("progress_file", "progress_pair")


@dataclass
class Timeline:
    blocks: DataFrame  # ord, block_id, md, unit columns
    verdicts: DataFrame  # every unit with verdict / fork


def aggregate(found: Analysis, params: Params) -> Timeline:
    """All units on one timeline, copies removed, rendered."""
    ordered = stage(ids.timeline(found.units), "timeline")
    shared = dedupe.with_candidate_key(ordered).groupBy("dup_key").agg(
        F.count(F.lit(1)).alias("_n")
    ).where("_n > 1")
    # Contents and streams are hashed only for files of units that share a key.
    suspects = stage(
        dedupe.with_candidate_key(ordered).join(shared, "dup_key", "left_semi")
        .select("file_id").distinct(), "suspects",
    )
    hashes, prefixes = [], []
    for fam in found.families:
        keep = ["file_id"]
        hashes.append(dedupe.content_hashes(fam.content.join(suspects, keep, "left_semi")))
        events = fam.events.join(suspects, keep, "left_semi")
        prefixes.append(dedupe.stream_prefixes(*cut_dense(events, keep, "line_no")))
    hashes, prefixes = stage(_union(hashes), "hashes"), stage(_union(prefixes), "prefixes")
    judged = dedupe.logical_dedupe(ordered, hashes, prefixes)
    kept = stage(judged.where("verdict <> 'removed'"), "kept")
    forked = stage(dedupe.fork_dedupe(kept), "forked")
    blocks = render(forked.where("not removed"), params)
    verdicts = judged.select("file_id", "side", "pair", "ord", "verdict").join(
        forked.where("removed").select("file_id", "side", "pair", F.lit(True).alias("fork")),
        ["file_id", "side", "pair"], "left",
    )
    return Timeline(blocks, verdicts)


def per_session(found: Analysis, params: Params) -> DataFrame:
    """Every session on its own, not de-duplicated across sessions; a shared name is an error."""
    clash = (
        found.units.groupBy("source", "session_id")
        .agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"))
        .where("a <> b")
    )
    if not clash.isEmpty():
        raise ValueError("two session logs share one output name")
    return render(ids.with_order_columns(found.units), params)


def write_sessions(blocks: DataFrame, path: str) -> None:
    """One partition per session, in timeline order within it. Sessions not in ``blocks`` keep what they have."""
    cols = ["source", "session_id", *ids.TOTAL_ORDER]
    (
        blocks.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .select("source", "session_id", "block_id", "ts_raw", "file_path", "md")
        .write.option("partitionOverwriteMode", "dynamic")
        .partitionBy("source", "session_id").mode("overwrite").parquet(path)
    )


def sources_present(units: DataFrame) -> DataFrame:
    """(source, units) of the log families that the result holds units of."""
    return units.groupBy("source").agg(F.count(F.lit(1)).alias("units"))


def metrics(found: Analysis, timeline: Timeline | None = None) -> DataFrame:
    """(metric, key, value): what a run did."""
    def rows(df: DataFrame, metric: str, key, value) -> DataFrame:
        return df.select(
            F.lit(metric).alias("metric"), key.cast("string").alias("key"),
            value.cast("bigint").alias("value"),
        )

    nothing = F.lit("")
    per_session = found.units.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    present = sources_present(found.units)
    out = [rows(present, "source_units", F.col("source"), F.col("units")),
           rows(per_session, "units", F.col("file_id"), F.col("n")),
           rows(found.hidden, "hidden", F.col("source"), F.col("hidden"))]
    for fam in found.families:
        out.append(rows(fam.bad, "bad_lines", F.col("file_id"), F.col("bad_lines")))
        skipped = fam.sessions.where(~F.col("recognised"))
        out.append(rows(skipped, "format_skipped", F.col("file_id"), F.lit(1)))
    if found.removed is not None:
        r = found.removed.agg(F.count(F.lit(1)).alias("r"), F.count_if("enriched").alias("m"))
        out += [rows(r, "inherited_removed", nothing, F.col("r")), rows(r, "inherited_merged", nothing, F.col("m"))]
        shown = found.conflicts.join(found.units, ["file_id", "pair"], "left_semi")
        out.append(rows(shown.groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "kept_conflicts", F.col("reason"), F.col("n")))
    if timeline is not None:
        v = timeline.verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
        out.append(rows(v, "verdict", F.col("verdict"), F.col("n")))
        forks = timeline.verdicts.agg(F.count_if("fork").alias("n"))
        out.append(rows(forks, "forks_removed", nothing, F.col("n")))
    return _union(out)

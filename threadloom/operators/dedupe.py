"""Removing copies of the same question unit: snapshots, complete copies, resumed sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nul_join, sha
from ..session import stage
from .ids import session_key
from .scan import Order, running, sum_upto


def _wide_hash(c: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), c).cast("decimal(20,0)")


def _fingerprint(first: Column, second: Column) -> Column:
    return F.concat_ws(":", first.cast("string"), second.cast("string"))


def line_hashes(value: Column) -> list[Column]:
    """Two independent hashes of a line, kept with its parsed row so contents are read once."""
    return [F.xxhash64(F.lit(1), value).alias("h1"), F.xxhash64(F.lit(2), value).alias("h2")]


def content_hashes(lines: DataFrame) -> DataFrame:
    """One fingerprint per file that equals exactly for equal content.

    Position-salted line hashes (``line_no``, ``h1``, ``h2``) are summed exactly, so the
    fingerprint is a partial aggregate and no task ever holds a whole file.
    """
    first = F.sum(_wide_hash(F.struct("line_no", "h1"), 1))
    second = F.sum(_wide_hash(F.struct("line_no", "h2"), 2))
    count = F.count(F.lit(1)).cast("string")
    return lines.groupBy("file_id").agg(
        F.concat_ws(":", count, _fingerprint(first, second)).alias("file_hash")
    )


def stream_prefixes(events: DataFrame, order: Order) -> DataFrame:
    """(file_id, n, hash of the first n events); ``events``: file_id, event, ordered by ``order``.

    The hash sums position-salted hashes, so a prefix is a running sum and stays parallel.
    """
    one = F.lit(1).cast("bigint")
    df = running(events, order, n=sum_upto(one))
    cell = F.struct("n", "event")
    df = df.withColumns({"_h1": _wide_hash(cell, 3), "_h2": _wide_hash(cell, 4)})
    df = running(df, order, _s1=sum_upto(F.col("_h1")), _s2=sum_upto(F.col("_h2")))
    return df.select("file_id", "n", _fingerprint(F.col("_s1"), F.col("_s2")).alias("hash"))


def with_candidate_key(units: DataFrame) -> DataFrame:
    """``dup_key``: source, session, time and question; the answer is left out on purpose."""
    material = nul_join(F.col("source"), session_key(), F.col("ts_raw"), F.col("question"))
    return units.withColumn("dup_key", sha(material))


def _confirmed(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Adds ``same``: row and ``m`` (a kept unit of the same candidate key) are the same unit.

    Any of: same session and question id; same session and one file's event stream is a strict
    prefix of the other's; equal file contents.
    """
    r_n, m_n = F.col("n_events"), F.col("m.n_events")
    shorter = F.when(r_n < m_n, F.col("stream_hash")).otherwise(F.col("m.stream_hash"))
    longer = F.when(r_n < m_n, F.col("m.file_id")).otherwise(F.col("file_id"))
    rows = rows.withColumns({"_long": longer, "_short_n": F.least(r_n, m_n), "_short": shorter})
    p = prefixes.select(
        F.col("file_id").alias("_long"), F.col("n").alias("_short_n"), F.col("hash").alias("_at")
    )
    rows = rows.join(p, ["_long", "_short_n"], "left")
    session = (F.col("session_id") != "") & (F.col("session_id") == F.col("m.session_id"))
    same_id = session & (F.col("q_uuid") != "") & (F.col("q_uuid") == F.col("m.q_uuid"))
    prefix = session & (r_n != m_n) & (F.col("_short_n") > 0) & (F.col("_at") == F.col("_short"))
    copy = (F.col("file_hash") != "") & (F.col("file_hash") == F.col("m.file_hash"))
    same = F.coalesce(same_id, F.lit(False)) | F.coalesce(prefix, F.lit(False)) | F.coalesce(copy, F.lit(False))
    return rows.withColumn("same", same).drop("_long", "_short_n", "_short", "_at")


def logical_dedupe(units: DataFrame, files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Units in order; the first confirmed one of a candidate key stays. Adds ``verdict``:
    ``kept``, ``possible`` (kept, but could not be told from an earlier one) or ``removed``.

    An answered copy takes the place (``ord``) of an unanswered kept one and stands for it from
    then on. Every round settles, in all groups at once, the first open unit and all copies of it,
    so the number of rounds is the number of distinct units sharing one key, and no group is ever
    gathered. There is no cap on comparisons.

    ``units``: ord + unit columns; ``files``: file_id, file_hash; ``prefixes`` as built above.
    """
    keyed = with_candidate_key(units)
    shared = keyed.groupBy("dup_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    ends = prefixes.groupBy("file_id").agg(
        F.max("n").alias("n_events"), F.max_by("hash", "n").alias("stream_hash")
    )
    slim = (
        keyed.join(shared.select("dup_key"), "dup_key", "left_semi")
        .select(
            "dup_key", "ord", "file_id", "session_id",
            F.coalesce("q_uuid", F.lit("")).alias("q_uuid"),
            (F.col("answer") != "").alias("answered"),
        )
        .join(files, "file_id", "left")
        .join(ends, "file_id", "left")
        .withColumns(
            {
                "file_hash": F.coalesce("file_hash", F.lit("")),
                "n_events": F.coalesce("n_events", F.lit(0).cast("bigint")),
            }
        )
    )
    cols = ["ord", "file_id", "session_id", "q_uuid", "answered", "file_hash", "n_events", "stream_hash"]
    open_rows = stage(slim, "dup-open")
    decided: DataFrame | None = None
    rounds = 0
    while not open_rows.isEmpty():
        head = open_rows.groupBy("dup_key").agg(F.min_by(F.struct(*cols), "ord").alias("m"))
        seen = stage(_confirmed(open_rows.join(head, "dup_key"), prefixes), "dup-head")
        # First answered copy of an unanswered head: it takes over for the units after it.
        heir = (
            seen.where(F.col("same") & F.col("answered") & ~F.col("m.answered"))
            .groupBy("dup_key")
            .agg(F.min_by(F.struct(*cols), "ord").alias("heir"))
        )
        seen = seen.join(heir, "dup_key", "left")
        before = F.col("heir").isNull() | (F.col("ord") <= F.col("heir.ord"))
        early = seen.where(before)
        late = seen.where(~before).withColumn("m", F.col("heir")).drop("same")
        judged = stage(early.unionByName(_confirmed(late, prefixes)), "dup-judged")
        is_head = F.col("ord") == F.col("m.ord")
        outcome = (
            F.when(is_head & F.col("heir").isNull(), F.col("ord"))
            .when(is_head, F.lit(-1))
            .when(F.col("ord") == F.col("heir.ord"), F.col("m.ord"))
            .when(F.col("same"), F.lit(-1))
        )
        first_round = F.lit(rounds == 0)
        settled = judged.withColumn("new_ord", outcome.cast("bigint")).where(
            F.col("new_ord").isNotNull()
        )
        settled = settled.select(
            "ord", "new_ord",
            F.when(F.col("new_ord") < 0, "removed").when(first_round, "kept").otherwise("possible")
            .alias("verdict"),
        )
        settled = stage(settled, "dup-settled")
        decided = settled if decided is None else decided.unionByName(settled)
        open_rows = judged.where(outcome.isNull()).select("dup_key", *cols)
        open_rows = stage(open_rows, "dup-open")
        rounds += 1
    if decided is None:
        return units.withColumn("verdict", F.lit("kept"))
    joined = units.join(decided, "ord", "left")
    return joined.withColumns(
        {
            "verdict": F.coalesce("verdict", F.lit("kept")),
            "ord": F.when(F.col("new_ord") >= 0, F.col("new_ord")).otherwise(F.col("ord")),
        }
    ).drop("new_ord")


def _rivals(open_keys: DataFrame) -> DataFrame:
    """(ord, up, several): the earlier open unit that alone decides on this one, null if there is none.

    Per id only its first and second holder are looked at: later holders have several rivals.
    """
    first = open_keys.groupBy("key").agg(F.min("ord").alias("_first"))
    led = open_keys.join(first, "key")
    second = led.where("ord > _first").groupBy("key").agg(F.min("ord").alias("_second"))
    led = led.join(second, "key", "left").withColumn("_up", F.when(F.col("ord") > F.col("_first"), F.col("_first")))
    return led.groupBy("ord").agg(
        F.min("_up").alias("up"),
        (F.coalesce(F.min("_up") < F.max("_up"), F.lit(False))
         | F.bool_or(F.coalesce(F.col("ord") > F.col("_second"), F.lit(False)))).alias("several"),
    )


def _settled(rivals: DataFrame) -> DataFrame:
    """(ord, kept) of all units whose fate is known: first for all their ids, or at the end of a chain of
    single rivals that begins with such a unit. Along a chain kept and removed alternate, so pointers
    that double their reach and carry the parity find the outcome in as many steps as the length has binary digits.
    """
    free = rivals.where("NOT several AND up IS NULL").select("ord")
    chain = rivals.where("NOT several AND up IS NOT NULL").select("ord", "up", F.lit(True).alias("odd"))
    while True:
        chain = stage(chain, "fork-chain")
        ahead = chain.select(F.col("ord").alias("up"), F.col("up").alias("_up"), F.col("odd").alias("_odd"))
        if chain.join(ahead.select("up"), "up", "left_semi").isEmpty():
            break
        chain = chain.join(ahead, "up", "left").select(
            "ord", F.coalesce("_up", "up").alias("up"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"))
    ends = chain.join(free.withColumnRenamed("ord", "up"), "up", "left_semi").select("ord", (~F.col("odd")).alias("kept"))
    return free.withColumn("kept", F.lit(True)).unionByName(ends)


def fork_dedupe(units: DataFrame) -> DataFrame:
    """In order, a unit is removed when an earlier kept unit already showed one of its message ids.
    Adds ``removed``. Units without ids always stay.

    ``units``: ord, fork_keys. A round keeps every open unit that is the earliest for all its ids,
    follows chains of units with one earlier rival each to their end, and removes the open units sharing an id
    with a kept one; it repeats while units are open. A kept unit of a chain is the only rival before it, so whatever
    else shares its ids is later.
    """
    keys = units.select("ord", F.explode("fork_keys").alias("key")).distinct()
    # Ids seen once decide nothing: their unit stands or falls with its other ids.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    open_keys = stage(keys.join(shared.select("key"), "key", "left_semi"), "fork-open")
    removed: DataFrame | None = None
    while not open_keys.isEmpty():
        known = stage(_settled(stage(_rivals(open_keys), "fork-rivals")), "fork-settled")
        kept = known.where("kept").select("ord")
        taken = open_keys.join(kept, "ord", "left_semi").select("key").distinct()
        lost = open_keys.join(taken, "key", "left_semi").join(kept, "ord", "left_anti").select("ord").distinct()
        lost = stage(lost, "fork-lost")
        removed = lost if removed is None else removed.unionByName(lost)
        open_keys = stage(open_keys.join(kept.unionByName(lost), "ord", "left_anti"), "fork-open")
    if removed is None:
        return units.withColumn("removed", F.lit(False))
    gone = removed.select("ord", F.lit(True).alias("removed"))
    return units.join(gone, "ord", "left").withColumn("removed", F.coalesce("removed", F.lit(False)))

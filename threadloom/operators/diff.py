"""Comparing a result with the previous snapshot: what to write, what would get lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nul_join, sha
from ..functions.tokens import FIELDS
from .lineage import subsequence
from .scan import cut_hot, running, sum_before


def compare_positions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per position: ``equal``, ``changed``, ``old_only`` or ``new_only`` (ord, md on both sides)."""
    # Digests travel instead of texts.
    o = old.select("ord", sha(F.col("md")).alias("o"))
    n = new.select("ord", sha(F.col("md")).alias("n"))
    state = (
        F.when(F.col("o").isNull(), "new_only")
        .when(F.col("n").isNull(), "old_only")
        .when(F.col("o") == F.col("n"), "equal")
        .otherwise("changed")
    )
    return o.join(n, "ord", "full").select("ord", state.alias("state"))


def outcome(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row: ``create``, ``noop``, ``append`` (old is a strict prefix) or ``rewrite``; counts."""
    if old is None:
        return new.agg(F.lit("create").alias("outcome"), F.count(F.lit(1)).alias("added"))
    c = compare_positions(old, new).agg(
        F.count_if(F.col("state").isin("changed", "old_only")).alias("_touched"),
        F.count_if(F.col("state") == "new_only").alias("added"),
    )
    kind = (
        F.when(F.col("_touched") > 0, "rewrite").when(F.col("added") > 0, "append").otherwise("noop")
    )
    return c.select(kind.alias("outcome"), "added")


def append_tail(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` after the last position of ``old``."""
    return new.join(old.select("ord"), "ord", "left_anti")


def snapshot_digest(snapshot: DataFrame) -> str:
    """Equal for equal rows in equal places (``ord``), whatever files hold them.

    A count and two exact sums of 64-bit hashes of the rows with their places: a partial aggregate, no row is moved.
    """
    row = F.struct(*[F.col(c) for c in sorted(snapshot.columns)])
    sums = [F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(20,0)")) for salt in (1, 2)]
    found = snapshot.agg(F.count(F.lit(1)), *sums).first()
    return ":".join(str(v) for v in found)


def lost_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks of the old snapshot whose id is gone."""
    return old.join(new.select("block_id"), "block_id", "left_anti")


def ids_decidable(snapshot: DataFrame) -> bool:
    """Ids are present, well formed and unique; otherwise nothing can be proven about a loss."""
    ids = snapshot.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    bad = (F.col("n") > 1) | ~F.coalesce(F.col("block_id").rlike("^[^:]+:[0-9a-f]{24}$"), F.lit(False))
    return not snapshot.isEmpty() and ids.where(bad).isEmpty()


def destructive(old: DataFrame, new: DataFrame) -> bool:
    """Overwriting would lose a block, or it cannot be ruled out."""
    if not (ids_decidable(old) and ids_decidable(new)):
        return True
    return not lost_ids(old, new).isEmpty()


def ids_in_text(text: DataFrame, prefix: str = "blockid") -> DataFrame:
    """Block ids found in rendered text lines (column ``value``): (value, block_id, malformed)."""
    loose = f"^<!-- {prefix}:"
    marked = text.where(F.col("value").rlike(loose))
    block = F.regexp_extract("value", f"^<!-- ({prefix}:[0-9a-f]{{24}}) -->$", 1)
    return marked.select("value", block.alias("block_id"), (block == "").alias("malformed"))


def _changes(o: str, n: str) -> tuple[Column, Column]:
    """(something was lost or moved, something was gained) for one surviving id."""

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    moved = F.lit(False)
    for f in ("question", "session_id", "session_name", "ts_raw", "model", "version", "branch", "cwd"):
        moved = moved | ~col(o, f).eqNullSafe(col(n, f))
    swapped = (col(o, "answer") != "") & (col(o, "answer") != col(n, "answer"))
    gained = (col(o, "answer") == "") & (col(n, "answer") != "")
    lost_progress = ~subsequence(col(o, "progress"), col(n, "progress"))
    grew = F.size(col(n, "progress")) > F.size(col(o, "progress"))
    shrank, more = F.lit(False), F.lit(False)
    for f in FIELDS:
        a, b = col(o, f), col(n, f)
        shrank = shrank | F.coalesce(b < a, a.isNotNull() & b.isNull())
        more = more | F.coalesce(b > a, b.isNotNull() & a.isNull())
    return moved | swapped | lost_progress | shrank, gained | grew | more


def classify_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(block_id, class) over both snapshots.

    A surviving id is ``unchanged``, ``enriched`` (only gained) or ``mutated``. An id that is gone
    is ``id-changed`` when a new id carries the same question and answer, ``duplicate-removed``
    when the same question and answer still show elsewhere, else ``unexplained``. A new id is
    ``instruction`` or ``new-content`` unless it explains a change of id.

    Both need: block_id, ord, question, answer, session_id, session_name, ts_raw, model, version,
    branch, cwd, progress (array), token fields.
    """
    bad, gain = _changes("o", "n")
    both = old.alias("o").join(new.alias("n"), F.col("o.block_id") == F.col("n.block_id"))
    kept = both.select(
        F.col("o.block_id").alias("block_id"),
        F.when(bad, "mutated").when(gain, "enriched").otherwise("unchanged").alias("class"),
    )
    same_text = sha(nul_join(F.col("question"), F.col("answer"))).alias("_qa")
    told = F.col("question").startswith("Message Type:").alias("told")

    def slim(df: DataFrame) -> DataFrame:
        return df.select("block_id", "ord", same_text, told)

    gone = slim(old).join(new.select("block_id"), "block_id", "left_anti")
    fresh = slim(new).join(old.select("block_id"), "block_id", "left_anti")
    key = ["_qa"]
    one = F.lit(1).cast("bigint")

    def ranked(df: DataFrame) -> DataFrame:
        df, order = cut_hot(df, key, ["ord"])
        return running(df, order, _k=sum_before(one)).drop("_chunk")

    g, f = ranked(gone), ranked(fresh)
    renamed = g.join(f.select(*key, "_k", F.lit(True).alias("_new")), [*key, "_k"], "left")
    still = new.select(same_text).distinct().withColumn("_there", F.lit(True))
    lost = renamed.join(still, key, "left").select(
        "block_id",
        F.when(F.col("_new"), "id-changed").when(F.col("_there"), "duplicate-removed")
        .otherwise("unexplained").alias("class"),
    )
    extra = f.join(g.select(*key, "_k"), [*key, "_k"], "left_anti").select(
        "block_id",
        F.when(F.col("told"), "instruction").otherwise("new-content").alias("class"),
    )
    return kept.unionByName(lost).unionByName(extra)


def stale_partitions(existing: DataFrame, sessions: DataFrame, former: DataFrame) -> DataFrame:
    """Written per-session partitions that may go: the session now has no unit, or the partition
    carries a subagent's former id, belongs to no live session and names that subagent's file.

    ``existing``: source, session_id, file_path; ``sessions``: source, session_id, file_path,
    units; ``former``: file_path, former_id.
    """
    key = ["source", "session_id", "file_path"]
    emptied = existing.join(sessions.where("units = 0"), key, "left_semi")
    live = sessions.select("source", "session_id")
    renamed = existing.join(live, ["source", "session_id"], "left_anti").join(
        former.select("file_path", F.col("former_id").alias("session_id")),
        ["file_path", "session_id"], "left_semi",
    )
    return emptied.select(*key).unionByName(renamed.select(*key)).distinct()

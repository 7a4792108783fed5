"""Session names: rename records, title tables, and which root's name counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import is_object, object_at, str_at, text_at
from ..functions.text import present, strip, to_ms, within
from ..session import hot_bytes, if_found
from .scan import COLD, Order, running, sum_before


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """Rename records of one index file: id, name ('' clears), at (ms or NULL), seq."""
    text = if_found(lambda: spark.read.option("lineSep", "\n").text(path))
    if text is None:
        return None
    meta = F.col("_metadata")
    raw = text.select(
        "value", F.lit(path).alias("index_path"),
        F.when(meta.file_size > hot_bytes(spark), meta.file_block_start).otherwise(F.lit(COLD)).alias("_chunk"),
        meta.file_block_start.alias("_block"), F.monotonically_increasing_id().alias("_mid"),
        meta.file_size.alias("_size"),
    )
    huge = not raw.where(F.col("_size") > hot_bytes(spark)).limit(1).isEmpty()
    v = F.try_parse_json("value")
    rows = raw.withColumn("v", v).where(
        is_object(F.col("v")) & (str_at(F.col("v"), "$.id") != "")
        & object_at(F.col("v")).getItem("thread_name").isNotNull()
    )
    rows = rows.select(
        "index_path", "_chunk", "_block", "_mid",
        str_at(F.col("v"), "$.id").alias("id"),
        strip(str_at(F.col("v"), "$.thread_name")).alias("name"),
        to_ms(text_at(F.col("v"), "$.updated_at")).alias("at"),
    )
    order = Order(("index_path",), ("_block", "_mid"), "_chunk" if huge else None)
    rows = running(rows, order, seq=sum_before(F.lit(1).cast("bigint")))
    return rows.select("id", "name", "at", "seq")


def latest_names(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The record that stands after all renames of one index, per id.

    In file order a record replaces the current one unless both are dated and it is older. An
    undated record therefore always takes over, so only records from the last undated one on
    matter, and among the dated ones after it the newest wins, later ones on a tie.
    """
    keys = keys or ["id"]
    undated = records.groupBy(*keys).agg(
        F.max(F.when(F.col("at").isNull(), F.col("seq"))).alias("_reset")
    )
    since = F.coalesce("_reset", F.lit(-1))
    rank = F.struct(F.col("at").isNotNull(), F.coalesce("at", F.lit(0).cast("bigint")), "seq")
    best = F.max_by(F.struct("name", "at", "seq"), rank)
    return (
        records.join(undated, keys)
        .where(F.col("seq") >= since)
        .groupBy(*keys)
        .agg(best.alias("r"))
        .select(*keys, "r.name", "r.at", "r.seq")
    )


def merge_indexes(own: DataFrame, parent: DataFrame) -> DataFrame:
    """Two indexes of one root: the fresher record per id, the parent's on a tie."""
    o = own.select("id", F.struct("name", "at", "seq").alias("o"))
    p = parent.select("id", F.struct("name", "at", "seq").alias("p"))
    both_dated = F.col("o.at").isNotNull() & F.col("p.at").isNotNull() & (F.col("o.at") != F.col("p.at"))
    parent_wins = F.when(both_dated, F.col("p.at") > F.col("o.at")).otherwise(
        F.col("p.seq") >= F.col("o.seq")
    )
    pick = (
        F.when(F.col("o").isNull(), F.col("p"))
        .when(F.col("p").isNull() | ~parent_wins, F.col("o"))
        .otherwise(F.col("p"))
    )
    return o.join(p, "id", "full").select("id", pick.alias("r")).select("id", "r.*")


def title_names(titles: DataFrame) -> DataFrame:
    """Names of a thread table (id, name, title): the name, else the title, where not blank."""
    name = F.coalesce(
        present(strip(F.coalesce("name", F.lit("")))), present(strip(F.coalesce("title", F.lit(""))))
    )
    return titles.where(F.col("id") != "").select("id", name.alias("name")).where("name is not null")


def resolve(
    sessions: DataFrame,
    names: DataFrame,
    titles: DataFrame,
    session: str = "session_id",
    path: str = "file_path",
    current: Column | None = None,
) -> DataFrame:
    """The name from the most specific root holding the file that knows one; a rename record beats
    the title table. Otherwise the name stays.

    ``names`` and ``titles``: root_dir, id, name. The list of roots is a parameter-sized relation.
    """
    current = F.col("session_name") if current is None else current
    index = names.select("root_dir", "id", present(F.col("name")).alias("_n"))
    table = titles.select("root_dir", "id", present(F.col("name")).alias("_t"))
    known = (
        index.join(table, ["root_dir", "id"], "full")
        .select("root_dir", "id", F.coalesce("_n", "_t").alias("_known"))
        .where("_known is not null")
    )
    # Equality on the id keeps this an equi-join; the path test only filters its matches.
    s, k = sessions.alias("s"), known.alias("k")
    best = (
        s.select(F.col(session).alias("_sid"), F.col(path).alias("_path"))
        .distinct()
        .join(k, F.col("_sid") == F.col("k.id"))
        .where(within(F.col("_path"), F.col("k.root_dir")))
        .groupBy("_sid", "_path")
        .agg(F.max_by("_known", F.length("k.root_dir")).alias("_best"))
    )
    joined = sessions.join(
        best, (F.col(session) == F.col("_sid")) & (F.col(path) == F.col("_path")), "left"
    )
    return joined.withColumn("session_name", F.coalesce("_best", current)).drop("_sid", "_path", "_best")

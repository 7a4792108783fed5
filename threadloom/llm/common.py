"""Helpers the operators share: row keys, staged global ranks, connected components, word columns."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.session import scratch_dir, stage

NULL_ID = -(2**63)
#: Bits of a row number that tell the row's place in its file.
FILE_BITS = 40
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send this module's functions to Python workers by value, so that workers need no import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(df: DataFrame, name: str, kind: str) -> Column:
    """The column, cast, or null where the table has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def row_key(df: DataFrame) -> list[Column]:
    """``d`` and ``h``: the id (nulls as the least long) and 64 hash bits of the text, which tell repeated ids apart."""
    return [
        F.coalesce(column(df, "doc_id", "long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64(F.coalesce(column(df, "text", "string"), F.lit(""))).alias("h"),
    ]


def slices(batches, rows: int, size: int):
    """Parts of the batches, of at most so many rows and bytes of strings and of one row at least."""
    for b in batches:
        each = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                each += pc.fill_null(pc.binary_length(c), 0).to_numpy()
        total, at = each.cumsum(), 0
        while at < b.num_rows:
            most = (total[at - 1] if at else 0) + size
            end = min(at + rows, max(at + 1, int(total.searchsorted(most, "right"))))
            yield b.slice(at, end - at)
            at = end


def give_back() -> None:
    """Hand memory that this process has freed, but still holds, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def lean(run):
    """``run`` over a task's batches, for ``mapInArrow`` and ``mapInPandas``: Spark keeps a worker for other tasks, so what the task held goes."""
    def whole(batches):
        yield from run(batches)
        give_back()
    return whole


def doc_id_of(key: str = "d") -> Column:
    return F.when(F.col(key) != NULL_ID, F.col(key))


def stage_packed(df: DataFrame, label: str) -> DataFrame:
    """A written table in the shared folder, packed tighter than usual, for large ones.

    Spark deletes the shuffle files of a finished write when the driver's collector finds them unused, so that is called.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """These columns of ``docs`` with ``rid``, a number of the row's own that is the same each time the table is read.

    Rows of a table as it is read from Parquet are numbered by their files and their places there, without a copy; any other
    table, and one that reads a file twice, is written once.
    """
    rows = _file_rows(docs, columns)
    if rows is None:
        rows = stage_packed(docs.select(*columns, F.monotonically_increasing_id().alias("rid")), "numbered")
    return rows


def _file_rows(docs: DataFrame, columns: list[Column]) -> DataFrame | None:
    if docs._jdf.queryExecution().analyzed().children().nonEmpty():  # a join may give a row of a file twice
        return None
    file, at = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    try:
        placed = docs.select(*columns, file, at)
    except AnalysisException:
        return None
    starts = docs.select(file, at).groupBy("_file").agg(F.count_if(F.col("_at") == 0).alias("_starts"))
    no = F.row_number().over(Window.orderBy("_file")).cast("long") - 1
    files = stage(starts.withColumn("_no", no), "files")
    if files.filter("_starts > 1").limit(1).count():
        return None
    rid = (F.shiftleft("_no", FILE_BITS) + F.col("_at")).alias("rid")
    return placed.join(F.broadcast(files.select("_file", "_no")), "_file").withColumn("rid", rid).drop("_file", "_at", "_no")


def global_rank(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``df`` as a written table with ``rank``, the row's place from 0 in the order of ``keys``.

    Rows are range-partitioned and sorted once; a row's place is its place in its partition plus
    the rows of the partitions before. Only one count for each partition is broadcast.
    """
    placed = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.alias("x").join(F.broadcast(counts.alias("y")), F.col("y._part") < F.col("x._part"), "left")
    offsets = before.groupBy(F.col("x._part").alias("_part")).agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop(
        "_part", "_before", "_at"
    )


def components(edges: DataFrame, label: str) -> DataFrame:
    """(``v``, ``c``) for every end of ``edges`` (``a``, ``b``): ``c`` is the least vertex that links reach.

    Each round takes the least label among the neighbours and then follows labels one step
    (pointer jumping); it ends when no label changes. Every round is a written table.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    now = stage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("c")), label)
    while True:
        near = both.join(now.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        low = now.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        low = stage(low, label)
        up = low.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = stage(low.join(up, "c", "left").select("v", "was", F.least("c", F.coalesce("cc", "c")).alias("c")), label)
        if not new.filter("was <> c").limit(1).count():
            return new.select("v", "c")
        now = new.select("v", "c")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))

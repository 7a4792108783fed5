"""Running values over ordered streams that stay parallel when one stream is huge.

A plain window puts a whole partition key into one task. Here a key holding more rows than the
session's hot limit is cut into ordered chunks: windows run per (key, chunk), every chunk is
summarised by a partial aggregate, the few summary rows are scanned, and what entered a chunk
from earlier ones is joined back on (key, chunk), the partitioning the rows already have.
Streams below the limit use the plain window and pay for none of this.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import hot_rows, spark_of, stage

CHUNK = "_chunk"
COLD = -1  # chunk number of the rows of streams that were not cut


@dataclass(frozen=True)
class Order:
    """How rows form streams: partition keys, order columns, and the chunk column of cut streams."""

    keys: tuple[str, ...]
    seq: tuple[str, ...]
    chunk: str | None = None

    def by(self, *extra: str) -> Order:
        """The same order within finer streams."""
        return replace(self, keys=(*self.keys, *extra))

    @property
    def partition(self) -> list[str]:
        return [*self.keys, self.chunk] if self.chunk else list(self.keys)


@dataclass(frozen=True)
class Running:
    op: str  # last | first | sum | max
    col: Column
    current: bool = False  # include the current row
    ahead: bool = False  # look at following rows instead


def last_before(c: Column) -> Running:
    """Nearest earlier non-null value."""
    return Running("last", c)


def last_upto(c: Column) -> Running:
    """Nearest non-null value at or before the row (forward fill)."""
    return Running("last", c, current=True)


def first_upto(c: Column) -> Running:
    """Earliest non-null value at or before the row."""
    return Running("first", c, current=True)


def sum_before(c: Column) -> Running:
    return Running("sum", c)


def sum_upto(c: Column) -> Running:
    return Running("sum", c, current=True)


def max_before(c: Column) -> Running:
    return Running("max", c)


def next_after(c: Column) -> Running:
    """Nearest later non-null value."""
    return Running("last", c, ahead=True)


def _window_value(r: Running, col: Column, window) -> Column:
    if r.op in ("sum", "max"):
        return (F.sum if r.op == "sum" else F.max)(col).over(window)
    fn = F.last if r.op == "last" else F.first
    return fn(col, ignorenulls=True).over(window)


def running(df: DataFrame, order: Order, **specs: Running) -> DataFrame:
    """Add one column per spec. Missing sums are 0, missing values NULL."""

    def frame(r: Running, keys: Sequence[str], seq: Sequence[str], end: int):
        cols = [F.col(s).desc() if r.ahead else F.col(s).asc() for s in seq]
        return Window.partitionBy(*keys).orderBy(*cols).rowsBetween(Window.unboundedPreceding, end)

    values = {
        name: _window_value(r, r.col, frame(r, order.partition, order.seq, 0 if r.current else -1))
        for name, r in specs.items()
    }
    if order.chunk is None:
        return df.withColumns(
            {n: F.coalesce(v, F.lit(0)) if specs[n].op == "sum" else v for n, v in values.items()}
        )

    # One summary row per chunk of the cut streams, then what all earlier (later) chunks hand over.
    inputs = df.where(F.col(order.chunk) > COLD).select(
        *order.partition, *order.seq, *[r.col.alias(f"_in_{n}") for n, r in specs.items()]
    )
    pos = F.struct(*order.seq)
    aggs = []
    for n, r in specs.items():
        c = F.col(f"_in_{n}")
        if r.op in ("sum", "max"):
            aggs.append((F.sum if r.op == "sum" else F.max)(c).alias(f"_in_{n}"))
        else:
            pick = F.min_by if (r.op == "first" or r.ahead) else F.max_by
            aggs.append(pick(c, F.when(c.isNotNull(), pos)).alias(f"_in_{n}"))
    carried = {
        f"_carry_{n}": _window_value(r, F.col(f"_in_{n}"), frame(r, order.keys, [order.chunk], -1))
        for n, r in specs.items()
    }
    carry = (
        inputs.groupBy(*order.partition)
        .agg(*aggs)
        .withColumns(carried)
        .select(*order.partition, *carried)
        .where(reduce(or_, [F.col(c).isNotNull() for c in carried]))
    )
    carry = stage(carry, "carry")

    out = df.withColumns(values).join(carry, order.partition, "left")
    merged = {}
    for n, r in specs.items():
        local, before = F.col(n), F.col(f"_carry_{n}")
        if r.op == "sum":
            merged[n] = F.coalesce(local, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif r.op == "max":
            merged[n] = F.greatest(local, before)
        elif r.op == "first":
            merged[n] = F.coalesce(before, local)
        else:
            merged[n] = F.coalesce(local, before)
    return out.withColumns(merged).drop(*carried)


def cut_hot(
    df: DataFrame, keys: Sequence[str], seq: Sequence[str], limit: int | None = None
) -> tuple[DataFrame, Order]:
    """Give rows of over-full keys a chunk number that follows the order.

    Only keys above the limit are range-partitioned and written; the list of such keys has at most
    rows/limit entries. Without any, the data is returned as it is.
    """
    limit = limit or hot_rows(spark_of(df))
    order = Order(tuple(keys), tuple(seq))
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    if hot.isEmpty():
        return df, order
    hot = stage(hot.select(*keys), "hot-keys")
    cold = df.join(hot, list(keys), "left_anti").withColumn(CHUNK, F.lit(COLD))
    cut = _range_chunks(df.join(hot, list(keys), "left_semi"), [*keys, *seq])
    return cold.unionByName(cut), replace(order, chunk=CHUNK)


def cut_dense(
    df: DataFrame, keys: Sequence[str], seq: str, limit: int | None = None
) -> tuple[DataFrame, Order]:
    """As ``cut_hot`` for a stream numbered 0, 1, 2, …: the number itself gives the chunk."""
    limit = limit or hot_rows(spark_of(df))
    order = Order(tuple(keys), (seq,))
    if df.where(F.col(seq) >= limit).select(seq).isEmpty():
        return df, order
    cut = df.withColumn(CHUNK, F.floor(F.col(seq) / limit).cast("bigint"))
    return cut, replace(order, chunk=CHUNK)


def _range_chunks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    # Staged, because range bounds are sampled and every reader must see the same cut.
    ranged = df.repartitionByRange(*[F.col(c) for c in cols])
    return stage(ranged.withColumn(CHUNK, F.spark_partition_id()), "range-chunks")


def total_rank(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based position in the total order of ``cols`` without a single-task sort."""
    ranged = _range_chunks(df, cols)
    one = sum_before(F.lit(1).cast("bigint"))
    ordered = running(ranged, Order((), tuple(cols), CHUNK), **{name: one})
    return ordered.drop(CHUNK)

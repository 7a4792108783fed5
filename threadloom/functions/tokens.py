"""Token counts: NULL means never reported, 0 means reported as zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SOURCE_A

# Token fields of a question unit, in display order.
FIELDS = ["tok_in", "tok_out", "tok_cache_read", "tok_write_5m", "tok_write_1h", "tok_reasoning"]
# Fields each log family reports.
REPORTED_A = {"tok_in", "tok_out", "tok_cache_read", "tok_write_5m", "tok_write_1h"}
REPORTED_B = {"tok_in", "tok_out", "tok_cache_read", "tok_reasoning"}


def totals(source: Column, has_usage: Column) -> list[Column]:
    """Aggregates: sums over the rows that carry usage, NULL when none does."""
    out = []
    for f in FIELDS:
        reported = F.when(
            source == SOURCE_A, F.lit(f in REPORTED_A)
        ).otherwise(F.lit(f in REPORTED_B))
        amount = F.when(has_usage & reported, F.coalesce(F.col(f), F.lit(0)))
        out.append(F.sum(amount.cast("bigint")).alias(f))
    return out


def display(col=F.col) -> Column:
    write = F.coalesce(col("tok_write_5m"), F.lit(0)) + F.coalesce(col("tok_write_1h"), F.lit(0))
    wrote = F.coalesce(col("tok_write_5m"), col("tok_write_1h")).isNotNull()

    def part(label: str, value: Column, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(label + " "), F.format_number(value, 0)))

    def plain(label: str, name: str) -> Column:
        return part(label, col(name), col(name).isNotNull())

    return F.concat_ws(
        ", ",
        plain("in", "tok_in"),
        plain("out", "tok_out"),
        plain("cache read", "tok_cache_read"),
        part("cache write", write, wrote),
        plain("reasoning", "tok_reasoning"),
    )

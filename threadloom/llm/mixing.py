"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent and normalised. The exponent is bisected: the largest
one whose weights reach the target entropy, but not so small that a source would be repeated more
than the limit allows (the limit wins). A budget of tokens is then spent by these weights: each
source is a sequence of epochs, each a permutation of its blocks and of the documents in them, cut
where its budget ends. A document belongs to the stream while its first token does.

Blocks hold about ``BLOCK_ROWS`` documents by hash, so sums run over small blocks and one row per
block; a source with most of the rows has most of the blocks. Nothing is gathered by source but those
sums. Each step of the bisection is one aggregate over the written table of sources.

A null source is a source of its own. Null and empty texts have no tokens; a source without tokens has
weight 0 and, with ``whole``, one epoch. Repeated rows are separate documents. Only doc_id, text and
source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, doc_id_of, row_key
from threadloom.session import stage

BLOCK_ROWS = 1000
SECTIONS = 16
ROUNDS = 10
SEED = 17


def count_tokens(text: Column) -> Column:
    """Words between white space."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " "))).cast("long")


def exponent(sources: DataFrame, target: float, limit: float, budget: float | None) -> float:
    """The exponent for shares ``p``: bisection in ``SECTIONS`` parts at a time, between 0 and 1.

    ``target`` is a share of the greatest possible entropy. ``limit`` bounds budget * weight / tokens; without a
    budget, the budget is what gives every source at least one epoch.
    """
    live = sources.filter("p > 0")

    def measure(grid: list[float]) -> list[tuple[float, float]]:
        aggs = [F.count("*").alias("n"), F.sum("tokens").alias("all")]
        for i, a in enumerate(grid):
            z = F.exp(F.lit(a) * F.log("p"))
            aggs += [F.sum(z).alias(f"z{i}"), F.sum(z * F.log("p")).alias(f"l{i}"),
                     F.max(z / F.col("p")).alias(f"hi{i}"), F.min(z / F.col("p")).alias(f"lo{i}")]
        r = live.agg(*aggs).first()
        out = []
        for i, a in enumerate(grid):
            entropy = math.log(r[f"z{i}"]) - a * r[f"l{i}"] / r[f"z{i}"]
            if budget is None:
                repeats = r[f"hi{i}"] / r[f"lo{i}"]
            else:
                repeats = budget / r["all"] * r[f"hi{i}"] / r[f"z{i}"]
            out.append((entropy / math.log(r["n"]) if r["n"] > 1 else 1.0, repeats))
        return out

    def bisect(fits) -> float:
        """The end of the run of exponents from ``good`` for which ``fits`` holds."""
        good, bad = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [good + (bad - good) * k / SECTIONS for k in range(SECTIONS + 1)]
            ok = [fits(m) for m in measure(grid)]
            if ok[-1]:
                return bad
            last = max((k for k in range(SECTIONS + 1) if ok[k] and all(ok[:k])), default=0)
            good, bad = grid[last], grid[last + 1]
            if bad - good < 1e-9:
                break
        return good

    if not live.limit(1).count():
        return 1.0
    entropic = bisect(lambda m: m[0] >= target)
    repeated = bisect(lambda m: m[1] > limit)
    at_zero = measure([0.0])[0][1] > limit
    return max(entropic, min(1.0, repeated + 1e-9) if at_zero else 0.0)


def mix(docs: DataFrame, target: float = 0.98, limit: float = 4.0, budget: float | None = None, whole: bool = False) -> DataFrame:
    """One row for each time a document is in the mixture.

    (doc_id, d, h, copy, source, n_tokens, weight, epoch, block, start): ``start`` is the place of its first token in its
    source's stream. ``budget`` defaults to all tokens; with ``whole`` it is the least that gives every document one epoch.
    """
    source = F.coalesce(F.concat(F.lit("s"), column(docs, "source", "string")), F.lit(""))
    rows = docs.select(*row_key(docs), source.alias("s"), count_tokens(column(docs, "text", "string")).alias("n_tokens"))
    rows = stage(rows, "tokens")
    sources = rows.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = stage(sources.withColumn("p", F.col("tokens") / F.lit(float(max(1, total)))), "sources")
    spend = None if whole else float(total if budget is None else budget)
    a = exponent(sources, target, limit, spend)
    z = F.when(F.col("p") > 0, F.exp(F.lit(a) * F.log("p"))).otherwise(0.0)
    sums = sources.agg(F.sum(z).alias("z"), F.max(F.when(F.col("p") > 0, F.col("p") / z)).alias("most")).first()
    norm = sums["z"] or 1.0
    if spend is None:
        spend = total * norm * (sums["most"] or 0.0)  # the source that the weights favour least gets one epoch
    share = sources.withColumn("weight", z / norm).withColumn("spend", F.col("weight") * spend)
    share = share.select(
        F.col("s").alias("s0"), "tokens", "weight", "spend",
        F.when(F.col("tokens") > 0, F.ceil(F.col("spend") / F.col("tokens") - 1e-9)).otherwise(0).cast("int").alias("epochs"),
    )
    # every source's blocks: as many as its rows need
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("d", "h", F.lit(SEED)), F.lit(blocks)))
    sizes = placed.groupBy("s", "block").agg(F.sum("n_tokens").alias("size"))
    least = F.lit(1 if whole else 0)
    turns = sizes.join(share, F.col("s") == F.col("s0")).filter(F.greatest("epochs", least) > 0).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.greatest("epochs", least) - 1)))
    shuffled = Window.partitionBy("s", "epoch").orderBy(F.xxhash64("s", "epoch", "block", F.lit(SEED)), "block")
    before = F.coalesce(F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("before", before + F.col("epoch") * F.col("tokens")).select("s", "block", "epoch", "before", "weight", "spend")
    if not whole:
        turns = turns.filter("before < spend")
    ordered = Window.partitionBy("s", "block", "epoch").orderBy(F.xxhash64("d", "h", "epoch", F.lit(SEED)), "d", "h")
    within = F.sum("n_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    copy = F.row_number().over(Window.partitionBy("s", "block", "epoch", "d", "h").orderBy("d")) - 1
    out = placed.join(turns, ["s", "block"]).withColumn("start", F.col("before") + within).withColumn("copy", copy)
    keep = F.col("start") < F.col("spend")
    out = out.filter((F.col("epoch") == 0) | keep if whole else keep)
    return out.select(
        doc_id_of().alias("doc_id"), "d", "h", "copy", F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("source"),
        "n_tokens", "weight", "epoch", F.col("block").cast("long").alias("block"), F.col("start").cast("long").alias("start"),
    )

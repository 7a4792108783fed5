"""Exact top-k by an impact-ordered index, score at a time.

Vectors become integers, floor(SCALE * x). Candidates are cut into blocks by hash; a block's index has, for
each dimension, its vectors in the order of their value, cut into segments of equal quantised
value. A query takes the segments of all dimensions in descending order of the impact they can have
(query value times the segment's best value, quantised) and adds their products to accumulators. After each
round, a vector's score is at most what it has plus, for each dimension not seen yet, the impact reached. The
k best of the vectors with the highest sums are scored exactly. Reading stops once the vectors that can still reach
the k-th of them (ties included) have fewer components than there are postings left: all others are proved
out, and these are scored exactly. When nothing can be ruled out, all postings are read.

Queries meet blocks in (query block, candidate block) groups of bounded size; their best k are merged
per query row. Vectors that are null or hold null or non-finite components take no part; shorter
vectors count as padded with zeros; of equal scores the smaller vec_id comes first. Rows with equal
vec_id are separate candidates and separate queries (each gets its own ranks), and a row is no candidate for itself only.
Fewer than k candidates give fewer rows. Sums of large components are bounded with their rounding and scored by exact integers;
components and scores beyond a long count as its nearest end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, ship
from threadloom.session import stage

ship(__name__)

SCALE = 256
K = 5
ROWS = 16384
QUERIES = 1024
LEVEL = 8
#: Postings read when proof is looked for, as shares of all.
SHARES = [0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
#: Greatest error of an operation on floats, with room to spare.
ROUNDING = 2.0**-51
#: Floats below this hold every integer.
EXACT = 2.0**53
END = 2.0**63


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, row, v): integer vectors that take part, ``row`` a number of the table as it is read."""
    e = F.col("e")
    rows = table.select(column(table, "vec_id", "long").alias("vec_id"), column(table, "embedding", "array<double>").alias("e"))
    good = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & good)
    return rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.transform(e, lambda x: F.floor(x * SCALE)).alias("v"))


def _matrix(v: pd.Series) -> np.ndarray:
    wide = max((len(x) for x in v), default=0)
    out = np.zeros((len(v), wide), np.int64)
    for i, x in enumerate(v):
        out[i, : len(x)] = x
    return out


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["vec_id", "row"], ignore_index=True)
    m = _matrix(rows["v"])
    small = np.array_equal(m, m.astype(np.int32))
    return pd.DataFrame({
        "block": [rows["block"].iloc[0]], "ids": [rows["vec_id"].to_numpy().tobytes()], "numbers": [rows["row"].to_numpy().tobytes()],
        "wide": [m.shape[1]], "data": [m.astype(np.int32 if small else np.int64).tobytes()]})


def _unpack(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row numbers, vectors) of a packed block."""
    ids, numbers = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["numbers"], np.int64)
    kind = np.int32 if len(block["data"]) == 4 * len(ids) * block["wide"] else np.int64
    return ids, numbers, np.frombuffer(block["data"], kind).reshape(len(ids), block["wide"]).astype(np.int64)


class Index:
    """Postings of a block: for each dimension, vectors by descending value, with segments of equal level."""

    def __init__(self, m: np.ndarray):
        n, wide = m.shape
        self.m, self.whole = m.astype(np.float64), m
        order = np.argsort(~m, axis=0, kind="stable")  # ~m is -m - 1, which no integer is too large for
        values = np.take_along_axis(m, order, 0)
        # one dimension after the other, so that a segment is one run of postings
        self.order, self.values = np.ascontiguousarray(order.T).ravel(), np.ascontiguousarray(values.T).ravel().astype(np.float64)
        self.largest = float(np.abs(self.m).max()) if m.size else 0.0
        found = []  # (dimension, start, end, greatest, least) of each segment
        for d in range(wide):
            level = values[:, d] // LEVEL
            cut = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True])
            found += [(d, d * n + s, d * n + e, values[s, d], values[e - 1, d]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
        self.segments = np.array(found, np.int64).reshape(-1, 5)

    def search(self, q: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) that hold the k best rows outside ``skip``."""
        n, wide = self.m.shape
        q = np.pad(q, (0, max(0, wide - len(q))))[:wide]
        d, first, end, most, least = self.segments.T
        real = q.astype(np.float64)
        impact = np.maximum(real[d] * most, real[d] * least)
        by = np.argsort(-impact, kind="stable")
        reads = np.cumsum((end - first)[by])
        total = int(reads[-1]) if len(reads) else 0
        reach_all = wide * float(np.abs(real).max(initial=0)) * self.largest
        # below EXACT all sums of floats are exact integers
        slack = 0.0 if reach_all < EXACT else reach_all * (wide + 8) * ROUNDING
        sums, seen, at = np.zeros(n), np.zeros(n, np.int64), 0
        sums[skip] = -np.inf
        for share in SHARES:
            upto = min(int(np.searchsorted(reads, total * share, side="left")) + 1, len(by))
            own = by[at:upto]
            at = upto
            if len(own):
                size = (end - first)[own]
                flat = np.arange(size.sum()) + np.repeat(first[own] - (np.cumsum(size) - size), size)
                rows = self.order[flat]
                sums += np.bincount(rows, np.repeat(real[d[own]], size) * self.values[flat], n)
                seen += np.bincount(rows, minlength=n)
            left = total - int(reads[at - 1]) if at else total
            reach = max(0, impact[by[at]]) if at < len(by) else 0
            lead = np.argpartition(-sums, min(k, n - 1))[:k] if n > k else np.arange(n)
            lead = lead[np.isfinite(sums[lead])]
            kth = (self.m[lead] @ real).min() if len(lead) >= k else -np.inf
            # scores beyond a long are equal to its ends, so rows past an end cannot be told out
            kth = -np.inf if kth - slack <= -END else min(kth, END)
            alive = np.flatnonzero((sums + (wide - seen) * reach >= kth - slack) & np.isfinite(sums))
            # what is left to read costs more than the exact scores of all that can still be members
            if len(alive) * wide <= left:
                break
        if not slack:
            return alive, (self.m[alive] @ real).astype(np.int64)
        exact = self.whole[alive].astype(object) @ q.astype(object)
        ends = np.iinfo(np.int64)
        return alive, np.array([min(max(x, ends.min), ends.max) for x in exact], np.int64)


def _search(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in left.iterrows():
            ids, numbers, m = _unpack(c)
            index = Index(m)
            for _, b in right.iterrows():
                qids, qrows, qs = _unpack(b)
                for qid, row, q in zip(qids, qrows, qs, strict=True):
                    rows, score = index.search(q, k, np.flatnonzero(numbers == row))
                    best = np.lexsort((ids[rows], ~score))[:k]
                    out += [(qid, row, ids[rows[i]], score[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])
    return run


def search(candidates: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects, its k best other rows."""
    v = stage(vectors(candidates), "vectors")

    def packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // size))
        placed = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        done = placed.groupBy("block").applyInPandas(_pack, "block int, ids binary, numbers binary, wide int, data binary")
        return stage(done, name).withColumnRenamed("block", name), blocks

    c, nc = packed(v, ROWS, "cb")
    q, nq = packed(v.filter(queries), QUERIES, "qb")
    left = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInPandas(_search(k), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

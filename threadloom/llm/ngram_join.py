"""N-gram Jaccard join: points of group counts in R-trees, bounded by summed coordinate minima.

A text is the set of its distinct shingles. Two texts link when their Jaccard similarity reaches
``percent``. Texts with equal sets are one class, and only classes are compared.

Which points share a tree: linked sets of sizes a and b differ in at most
(a + b) (100 - percent) / (100 + percent) = D shingles. Shingles are hashed into D + 1 + spare groups
(a number fixed by the size band of the smaller set), so linked sets agree wholly in more than
``spare`` groups. Every class therefore goes, for each group, to the bucket of that group's content,
except for groups of one shingle or none if it has at most ``spare`` of those. No link is lost.

Inside a bucket, a point is the counts of shingles in ``COORDINATES`` hash groups. The points are
packed into an R-tree; two nodes (or points) can only hold a linked pair if the sum over the
coordinates of the lesser of both maxima reaches the overlap that their least sizes demand. In long sets
nearly all counts are large and alike, so pairs left over meet the same bound once more on as many groups as their sizes ask for
(a multiple of ``COORDINATES``; the finer of two is summed up to the other's). What passes is verified on whole sets.

Large groups of near copies stay linear: first every class is compared with the class, among those it meets, that
meets most others (an original among its edited copies), then with the like of each of its buckets, and
what is linked becomes one component. Only buckets that still hold several components go through trees, in blocks of ``BLOCK`` members, and only for pairs across components.

Null texts and texts without words have no shingles and link with nothing; a null doc_id cannot name
a component but belongs to that of its text. Repeated rows get a row each. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, components, doc_id_of, lean, row_key, ship, slices
from threadloom.llm.common import stage_packed as stage
from threadloom.session import drop_staged

ship(__name__)

WORDS_IN_SHINGLE = 4
PERCENT = 85
COORDINATES = 256
#: Shingles for each hash group, at most, of a set's finer counts.
FINE = 4
#: Rows, and bytes of texts or points, that Python works on at a time.
SLICE = 1000
SLICE_BYTES = 4 << 20
BLOCK = 1024
LEAF = 16
#: Rows of buckets that a group holds in memory, and pairs of points compared at a time.
TASK_ROWS = 5000
PAIRS = 1 << 12
BAND = 0.8
M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int):
    """For each text, the sorted distinct 64-bit hashes of its shingles."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    full = np.diff(lists.offsets.to_numpy())
    words = hashes[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    blank = coded.dictionary.index("").as_py() if len(coded) else -1
    solid = np.ones(len(words), bool) if blank < 0 else coded.indices.to_numpy() != blank
    at = 0
    for n in full:
        w = words[at : at + n][solid[at : at + n]]
        at += n
        if not len(w):
            yield w
            continue
        k = min(width, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(M1) + w[i : len(w) - k + 1 + i])
        yield np.unique(h)


def band_of(n: int) -> int:
    return int(np.floor(np.log(n) / -np.log(BAND) + 1e-9))


def groups_of(band: int, percent: int) -> tuple[int, int]:
    """(groups, spare) for pairs whose smaller set lies in the band, or whose both sets do."""
    top = int(np.ceil(BAND ** -(band + 1)))
    most = int(top + top * 100 / percent) + 1  # the smaller set is below top, the larger at most 100 / percent of it
    apart = most * (100 - percent) // (100 + percent)
    spare = -(-(apart + 1) * 35 // 100)
    return apart + 1 + spare, spare


def keys_of(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Buckets of a set: its own band's, and those of all bands below in which a smaller partner may lie."""
    n = len(hashes)
    if (n + n * 100 // percent) * (100 - percent) < 100 + percent:
        return np.zeros(0, np.uint64)  # too small to link with any other set
    own = band_of(n)
    out = []
    for band in range(band_of(max(1, -(-n * percent // 100))), own + 1):
        groups, spare = groups_of(band, percent)
        g = (_mix(hashes + np.uint64(band * 2 + 1)) % np.uint64(groups)).astype(np.int64)
        size = np.bincount(g, minlength=groups)
        content = np.zeros(groups, np.uint64)
        np.add.at(content, g, _mix(hashes * np.uint64(M1)))
        rich = size > 1
        use = rich if groups - rich.sum() <= spare else np.ones(groups, bool)
        label = np.arange(groups, dtype=np.uint64) + np.uint64(band << 40)
        out.append(_mix(content + _mix(label * np.uint64(M2)) + size.astype(np.uint64))[use])
    return np.concatenate(out)


def _digest(hashes: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "little", signed=True)


def _slices(batches):
    """Parts of the batches, of one row at least: pairs of long texts are many bytes in few rows."""
    yield from slices(batches, SLICE, SLICE_BYTES)


def point_of(hashes: np.ndarray) -> bytes:
    """Counts of a set's shingles in the hash groups: a byte each, or four where one has more than a byte holds."""
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % COORDINATES, minlength=COORDINATES)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def coordinates_of(n: int) -> int:
    """Hash groups of the finer counts of a set of this size."""
    groups = COORDINATES
    while n > groups * FINE:
        groups *= 2
    return groups


def fine_of(hashes: np.ndarray) -> bytes | None:
    """Finer counts of a set, as in ``point_of``; None where the point's are fine enough."""
    groups = coordinates_of(len(hashes))
    if groups == COORDINATES:
        return None
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % groups, minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def fine_bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """No two sets with these finer counts share more shingles."""
    x, y = (np.frombuffer(p, np.uint8 if len(p) == coordinates_of(n) else np.int32) for p, n in ((a, na), (b, nb)))
    groups = min(len(x), len(y))
    x, y = (v if len(v) == groups else v.reshape(-1, groups).sum(0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


def counts_of(points: list[bytes]) -> np.ndarray:
    """One row of counts for each point."""
    if all(len(p) == COORDINATES for p in points):
        return np.frombuffer(b"".join(points), np.uint8).reshape(-1, COORDINATES)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == COORDINATES else np.int32).astype(np.int32) for p in points])


def _points(width: int):
    def run(batches):
        for b in _slices(batches):
            n, low, points, fine = [], [], [], []
            for h in shingles(b.column("text"), width):
                n.append(len(h))
                low.append(_digest(h))
                points.append(point_of(h))
                fine.append(fine_of(h))
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("h"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(points, pa.binary()), pa.array(fine, pa.binary())],
                ["d", "h", "n", "c", "point", "fine"],
            )
    return run


def _keys(width: int, percent: int):
    def run(batches):
        seen: set[int] = set()
        for b in _slices(batches):
            keys, classes = [], []
            for h in shingles(b.column("text"), width):
                if not len(h):
                    continue
                c = _digest(h)
                if c in seen:  # the same set in this task: the class has its keys
                    continue
                if len(seen) < 1 << 20:
                    seen.add(c)
                k = keys_of(h, percent)
                keys.append(k)
                classes.append(np.full(len(k), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes))], ["k", "c"])
    return run


def needed(a, b, percent: int):
    """The least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def tree_pairs(n: np.ndarray, points: np.ndarray, mark: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of different marks that the bound leaves, by walking an R-tree against itself.

    Levels are packed in the order of size and counts. Nodes carry the greatest coordinate values and the
    least and greatest size of what they hold.
    """
    order = np.lexsort((*points.T[:4], n))
    levels = [(points[order], n[order], n[order])]
    while len(levels[-1][1]) > LEAF:
        box, low, high = levels[-1]
        cut = np.arange(0, len(low), LEAF)
        levels.append((np.maximum.reduceat(box, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))
    top = len(levels[-1][1])
    i, j = np.triu_indices(top)
    for depth in range(len(levels) - 1, -1, -1):
        box, low, high = levels[depth]
        kept_i, kept_j = [], []
        for s in range(0, len(i), PAIRS):
            a, b = i[s : s + PAIRS], j[s : s + PAIRS]
            fit = (high[b] * 100 >= low[a] * percent) & (high[a] * 100 >= low[b] * percent)
            a, b = a[fit], b[fit]
            fit = np.minimum(box[a], box[b]).sum(1, dtype=np.int64) >= needed(low[a], low[b], percent)
            kept_i.append(a[fit])
            kept_j.append(b[fit])
        i, j = np.concatenate(kept_i), np.concatenate(kept_j)
        if depth:
            below = len(levels[depth - 1][1])
            grid = np.arange(LEAF)
            i, j = ((i[:, None, None] * LEAF + grid[None, :, None]) + 0 * grid, (j[:, None, None] * LEAF + grid[None, None, :]) + 0 * grid[None, :, None])
            i, j = i.ravel(), j.ravel()
            fit = (i < below) & (j < below) & (i <= j)
            i, j = i[fit], j[fit]
    i, j = order[i], order[j]
    fit = (i != j) & (mark[i] != mark[j])
    return i[fit], j[fit]


def _trees(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "x", "y", "c"], ignore_index=True)
        points = counts_of(rows["point"].tolist())
        c, n, m, part = (rows[x].to_numpy() for x in ("c", "n", "m", "part"))
        key = rows[["k", "x", "y"]].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        found = [np.zeros((2, 0), np.int64)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            i, j = tree_pairs(n[s:e], points[s:e], m[s:e], percent)
            i, j = i + s, j + s
            if key[s, 1] != key[s, 2]:
                across = part[i] != part[j]
                i, j = i[across], j[across]
            found.append(np.vstack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]))
        return pd.DataFrame(np.hstack(found).T, columns=["a", "b"]).drop_duplicates()
    return run


def _bounded(percent: int):
    def run(batches):
        for b in _slices(batches):
            pa_, pb_ = (counts_of(b.column(x).to_pylist()) for x in ("pa", "pb"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            need = needed(na, nb, percent)
            keep = np.minimum(pa_, pb_).sum(1, dtype=np.int64) >= need
            for i in keep.nonzero()[0].tolist():
                x, y = b.column("fa")[i].as_py(), b.column("fb")[i].as_py()
                if x is not None and y is not None:
                    keep[i] = fine_bound(x, y, int(na[i]), int(nb[i])) >= need[i]
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def _verify(width: int, percent: int):
    def run(batches):
        for b in _slices(batches):
            ok = []
            for x, y in zip(shingles(b.column("ta"), width), shingles(b.column("tb"), width), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])
    return run


def links(docs: DataFrame, width: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(classes, edges): each row's key (d, h), set size n and class c; verified links (a, b) between classes."""
    texts = docs.select(*row_key(docs), column(docs, "text", "string").alias("text"))
    classes = stage(texts.mapInArrow(lean(_points(width)), "d long, h long, n long, c long, point binary, fine binary"), "points")
    one = stage(classes.filter("n > 0").groupBy("c").agg(
        F.min(F.struct("d", "h", "n", "point", "fine")).alias("o")).select("c", "o.*"), "classes")
    rows = texts.select("text").mapInArrow(lean(_keys(width, percent)), "k long, c long")
    bucket = Window.partitionBy("k")
    shared = rows.withColumn("low", F.min("c").over(bucket)).withColumn("high", F.max("c").over(bucket)).filter("low <> high")
    shared = stage(shared.select("k", "c").distinct(), "buckets")
    # a bucket's pivot: the class that meets others most often, which is the original among edited copies
    sizes = shared.groupBy("k").agg((F.count("*") - 1).alias("others"))
    meets = shared.join(sizes, "k").groupBy("c").agg(F.sum("others").alias("meets"))
    rated = stage(shared.join(meets, "c").select("k", "c", F.struct("meets", "c").alias("r")), "rated")
    pivots = stage(rated.groupBy("k").agg(F.max("r").alias("p")), "pivots")

    def point(side: str) -> DataFrame:
        return one.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("point").alias(f"p{side}"), F.col("fine").alias(f"f{side}"))

    def verified(pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
        chosen = one.join(need, "c").select("c", "d", "h")
        found = texts.join(chosen.hint("shuffle_hash"), ["d", "h"])  # the few keys are hashed, so that not all texts are sorted
        body = stage(found.groupBy("c").agg(F.first("text").alias("text")), "texts")
        whole = pairs.join(body.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a").join(
            body.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b")
        sure = stage(whole.select("a", "b", "ta", "tb").mapInArrow(lean(_verify(width, percent)), "a long, b long"), "links")
        drop_staged(body)
        return sure

    def bounded(pairs: DataFrame) -> DataFrame:
        near = pairs.join(point("a"), "a").join(point("b"), "b")
        return stage(near.mapInArrow(lean(_bounded(percent)), "a long, b long"), "near")

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def marked(edges: DataFrame) -> DataFrame:
        """Members of buckets with the component they are in so far."""
        mark = components(edges, "marks")
        found = shared.join(mark.select(F.col("v").alias("c"), F.col("c").alias("m")), "c", "left")
        return stage(found.select("k", "c", F.coalesce("m", "c").alias("m")), "members")

    # first each class with the best pivot it meets, then the pivots of buckets that hold several components
    best = rated.join(pivots, "k").groupBy("c").agg(F.max("p").alias("p")).select("c", F.col("p.c").alias("p")).filter("c <> p")
    tried = stage(best.select(*ordered("c", "p")).distinct(), "tried")
    drop_staged(rated)
    edges = verified(bounded(tried))
    members = marked(edges)
    head = pivots.select("k", F.col("p.c").alias("c")).join(members, ["k", "c"]).select("k", F.col("c").alias("p"), F.col("m").alias("pm"))
    more = members.join(head, "k").filter("m <> pm").select(*ordered("c", "p")).distinct().join(tried, ["a", "b"], "left_anti")
    more = stage(more, "more")
    drop_staged(pivots)
    drop_staged(members)
    edges = stage(edges.union(verified(bounded(more))), "edges")
    tried = tried.union(more)
    members = marked(edges)
    drop_staged(shared)
    hashed = [F.bit_xor(F.xxhash64("c", F.lit(i))) for i in (1, 2)]
    open_ = members.groupBy("k").agg(F.count("*").alias("size"), F.min("m").alias("lo"), F.max("m").alias("hi"), F.struct(*hashed).alias("same"))
    open_ = open_.filter("size > 2 AND lo <> hi").groupBy("size", "same").agg(F.min("k").alias("k"))  # equal buckets once
    open_ = open_.select("k", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    placed = members.join(open_, "k").withColumn("part", F.pmod(F.xxhash64("c", "k"), F.col("parts")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "k", "c", "m", "part", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y"))
    placed = stage(placed, "placed")
    drop_staged(members)
    tasks = max(1, placed.count() // TASK_ROWS)
    points = one.select("c", "n", "point")  # joined where they are used: a class is in many buckets
    trees = placed.join(points, "c").groupBy(F.pmod(F.xxhash64("k", "x", "y"), F.lit(tasks))).applyInPandas(_trees(percent), "a long, b long")
    rest = stage(trees.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    drop_staged(placed)
    return classes.select("d", "h", "n", "c"), edges.union(verified(bounded(rest)))


def join(docs: DataFrame, width: int = WORDS_IN_SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) for every row; component_id is the least doc_id that links reach."""
    classes, edges = links(docs, width, percent)
    reach = components(edges, "reach")
    grouped = classes.join(reach.select(F.col("v").alias("c"), F.col("c").alias("g")), "c", "left")
    grouped = grouped.withColumn("g", F.when(F.col("n") > 0, F.coalesce("g", "c"))).withColumn("doc_id", doc_id_of())
    least = grouped.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "g", "left")
    return out.select("doc_id", "d", "h", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

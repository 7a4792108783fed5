"""Merkle manifest of a dataset: a digest tree per source under one root, and a proof for every document.

A document's fields give its leaf. Within a source, leaves ascend by doc_id (equal ids by leaf), every ``ARITY``
consecutive nodes become their digest until one is left, the source's subroot; subroots, ordered by source, give the root
in the same way. Digests are SHA-256, written as lower-case hex and hashed as that text.

Only digests are moved. Leaves are sorted by range once, which gives each its place; interior nodes come in rounds of
``STEPS`` levels, each from blocks of ``ARITY ** STEPS`` neighbours, and are kept as a table of coordinates
(tree, level, place). For proofs, leaves go in partitions of ``PART`` neighbours. A partition that holds a run of leaves can
derive most of the tree above it; what it lacks is, on every level, at most the siblings at both ends of the run. That
multiproof is fetched by one join, the shared interior is derived once, and each leaf's own proof is read off it.

Null fields are written as ``-``; null ids come first, null sources are one source before all others. Every row is a leaf,
equal rows too: their leaves are equal, so any order of them gives one tree. Missing columns count as null, others are not
read. An empty table has no leaf and gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, ship
from threadloom.session import stage

ship(__name__)

ARITY = 3
STEPS = 6
BLOCK = ARITY**STEPS
PART = 20_000
FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
#: Tree number of the subroots.
TOP = -1
NEEDS = "part long, t long, level int, pos long"
PROOFS = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "proof array<string>"
)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: dict[str, Column]) -> Column:
    """Digest (32 bytes) of a document's fields."""
    return F.unhex(F.sha2(F.concat(*[field(values[f]) for f in FIELDS]), 256))


def _ranked(df: DataFrame, keys: list[Column], label: str) -> DataFrame:
    """``df`` with ``rank``, its place from 0 in the order of ``keys``: place in its range plus the rows of the ranges before."""
    placed = stage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), label
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))  # a row per range
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")
    offsets = counts.select("_range", before.alias("_before"))
    ranked = placed.withColumn("_range", part).join(F.broadcast(offsets), "_range")
    return ranked.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_range", "_before", "_at")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Placed leaves: part, t (source number), pos, n (leaves of the source), doc_id, leaf, changed.

    ``tampered`` is the text that a tampered copy has, null where it is not tampered; ``changed`` is its leaf.
    """
    values = {f: column(docs, f, kind) for f, kind in FIELDS.items()}
    changed = F.lit(None).cast("binary")
    if tampered is not None:
        changed = F.when(tampered.isNotNull(), leaf_of(values | {"text": tampered}))
    rows = docs.select(values["source"].alias("source"), values["doc_id"].alias("doc_id"), leaf_of(values).alias("leaf"), changed.alias("changed"))
    rows = stage(rows.withColumn("_salt", F.monotonically_increasing_id()), "leaves")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_salt")]
    ranked = _ranked(rows, order, "ranked").drop("_salt").withColumn("part", F.floor(F.col("rank") / PART))
    runs = stage(ranked.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("rank").alias("first")), "runs")
    sources = runs.groupBy("source").agg(F.sum("rows").alias("n"), F.min("first").alias("first"))
    sources = _ranked(sources, [F.col("source").asc_nulls_first()], "sources").withColumnRenamed("rank", "t")
    # A source may hold most rows; a source within one part holds at most PART of them.
    known = runs.select("part", "source").join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.withColumnsRenamed({"part": "_part", "source": "_source"})
    placed = ranked.join(known, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return stage(
        placed.select("part", "t", (F.col("rank") - F.col("first")).alias("pos"), "n", "doc_id", "leaf", "changed"), "placed")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parents(nodes: list[str]) -> list[str]:
    return [digest("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def _levels(rows: pd.DataFrame) -> pd.DataFrame:
    """Up to STEPS levels above blocks of nodes; every block is whole, and a tree's levels end with its root."""
    out = []
    for (t, n, block), own in rows.sort_values("pos").groupby(["t", "n", "block"]):
        nodes, k = [d.hex() for d in own["d"]], 0
        while n > 1 and k < STEPS:
            nodes, n, k = parents(nodes), -(-n // ARITY), k + 1
            first = block * ARITY ** (STEPS - k)
            out += [(t, k, first + i, bytes.fromhex(d), n) for i, d in enumerate(nodes)]
    return pd.DataFrame(out, columns=["t", "level", "pos", "d", "n"])


def interior(base: DataFrame, most: int) -> DataFrame:
    """All nodes (t, level, pos, d) above ``base`` (t, pos, d, n), whose trees have at most ``most`` leaves."""
    out = base.limit(0).select("t", F.lit(0).alias("level"), "pos", "d")
    level = 0
    while most > 1:
        # Trees share a task's group, so that many small ones cost little; it holds at most 64 blocks.
        block = F.floor(F.col("pos") / BLOCK).alias("block")
        rows = base.filter("n > 1").select("t", "pos", "d", "n", block).groupBy(F.floor(F.col("t") / 64), "block")
        found = stage(rows.applyInPandas(_levels, "t long, level int, pos long, d binary, n long"), "levels")
        out = out.union(found.select("t", (F.col("level") + level).alias("level"), "pos", "d"))
        base = found.filter(F.col("level") == STEPS).select("t", "pos", "d", "n")
        level, most = level + STEPS, -(-most // BLOCK)
    return out


def lacking(first: int, end: int, n: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that leaves first..end-1 of a tree of ``n`` leaves lack: the least set giving its root."""
    out, level = [], 0
    while n > 1:
        low, high = first - first % ARITY, min(end + -end % ARITY, n)
        out += [(level, p) for p in (*range(low, first), *range(end, high))]
        first, end, n, level = low // ARITY, -(-high // ARITY), -(-n // ARITY), level + 1
    return out


def _lacking(batches):
    for rows in batches:
        out = [(r.part, r.t, *x) for r in rows.itertuples() for x in lacking(r.first, r.end, r.n)]
        yield pd.DataFrame(out, columns=["part", "t", "level", "pos"])


def shared_interior(known: list[str], first: int, n: int, fetched: dict) -> tuple[list[tuple[int, list[str]]], str]:
    """(per level its first place and the consecutive nodes known there; root), from a run of leaves and fetched nodes."""
    levels, level = [], 0
    while n > 1:
        end = first + len(known)
        low, high = first - first % ARITY, min(end + -end % ARITY, n)
        known = [fetched[level, p] for p in range(low, first)] + known + [fetched[level, p] for p in range(end, high)]
        levels.append((low, known))
        known = parents(known)
        first, n, level = low // ARITY, -(-n // ARITY), level + 1
    return levels, known[0]


def path(levels: list[tuple[int, list[str]]], pos: int) -> list[tuple[list[str], list[str]]]:
    """Siblings before and after the node on each level above a leaf."""
    out = []
    for low, nodes in levels:
        at = pos - low
        start = at - at % ARITY
        out.append((nodes[start:at], nodes[at + 1 : start + ARITY]))
        pos //= ARITY
    return out


def fold(node: str, siblings: list[tuple[list[str], list[str]]]) -> str:
    for before, after in siblings:
        node = digest("".join((*before, node, *after)))
    return node


def _prove(n_sources: int, root: str, with_proof: bool):
    def run(own: pd.DataFrame, lack: pd.DataFrame) -> pd.DataFrame:
        fetched: dict[int, dict] = {}
        for t, level, pos, d in zip(lack["t"], lack["level"], lack["pos"], lack["d"], strict=True):
            fetched.setdefault(t, {})[level, pos] = d.hex()
        own = own.sort_values(["t", "pos"])
        trees = {}
        for t, rows in own.groupby("t"):
            nodes = [d.hex() for d in rows["leaf"]]
            trees[t] = shared_interior(nodes, int(rows["pos"].iloc[0]), int(rows["n"].iloc[0]), fetched.get(t, {}))
        top, derived = shared_interior([sub for _, sub in trees.values()], min(trees), n_sources, fetched.get(TOP, {}))
        if derived != root:
            raise ValueError("the fetched nodes do not lead to the root")
        above = {t: path(top, t) for t in trees}
        out = []
        for t, pos, doc_id, leaf, changed in zip(own["t"], own["pos"], own["doc_id"], own["leaf"], own["changed"], strict=True):
            levels, sub = trees[t]
            siblings = path(levels, pos) + above[t]
            proof = [d for before, after in siblings for d in (*before, *after)]
            folded = fold((leaf if changed is None else changed).hex(), siblings)
            out.append((doc_id, leaf.hex(), sub, root, digest("".join(proof)), folded, folded == root, proof if with_proof else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PROOFS.split(", ")]).astype({"doc_id": "Int64"})

    return run


def prove(docs: DataFrame, tampered: Column | None = None, with_proof: bool = False) -> DataFrame:
    """One row per document: leaf, subroot, root, digest of its proof, the root that its (tampered) text folds to.

    ``proof`` holds the siblings themselves, from the leaf's level up, if ``with_proof`` is set.
    """
    placed = leaves(docs, tampered)
    runs = stage(placed.groupBy("part", "t", "n").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end")), "tree-runs")
    size = runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.max("t") + 1, F.lit(0)).alias("sources")).first()
    base = placed.select("t", "pos", F.col("leaf").alias("d"), "n")
    inner = stage(interior(base, size.most), "nodes")
    # The highest node of each tree; a lone leaf is its own.
    high = inner.groupBy("t").agg(F.max_by("d", "level").alias("d"))
    subroots = stage(high.union(base.filter("n = 1").select("t", "d")), "subroots")
    roots = subroots.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("pos"), "d", F.lit(size.sources).cast("long").alias("n"))
    upper = stage(interior(roots, size.sources), "upper")
    last = upper.agg(F.max_by("d", "level").alias("d")) if size.sources > 1 else subroots.select("d")
    last = last.first()
    root = last.d.hex() if last is not None and last.d is not None else ""
    tops = runs.groupBy("part").agg(F.min("t").alias("first"), (F.max("t") + 1).alias("end"))
    tops = tops.select("part", F.lit(TOP).cast("long").alias("t"), "first", "end", F.lit(size.sources).cast("long").alias("n"))
    needs = stage(runs.select("part", "t", "first", "end", "n").union(tops).mapInPandas(_lacking, NEEDS), "lacking")
    ground = base.union(roots).select("t", F.lit(0).alias("level"), "pos", "d")
    at = ["t", "level", "pos"]
    fetched = stage(ground.unionByName(inner).unionByName(upper).join(needs, at).select("part", *at, "d"), "fetched")
    done = _prove(size.sources, root, with_proof)
    return placed.groupBy("part").cogroup(fetched.groupBy("part")).applyInPandas(done, PROOFS)


def without_line_ends(docs: DataFrame) -> Column:
    """The text without line feeds where the CRC-32 of the decimal doc_id is even; null elsewhere, and for null ids and texts."""
    even = F.crc32(column(docs, "doc_id", "long").cast("string")) % 2 == 0
    return F.when(even, F.replace(column(docs, "text", "string"), F.lit("\n"), F.lit("")))


#: The whole tree by recursion over levels; proofs by walking each leaf up, level by level.
ORACLE = """
WITH RECURSIVE f AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rid, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text,
  (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))) & 1) = 1 AS even
  FROM documents),
l AS (SELECT doc_id, rid, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
  sha256(head || CASE WHEN text IS NULL THEN '-' WHEN even THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
    ELSE strlen(text) || ':' || text END) AS changed FROM f),
s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS t FROM (SELECT DISTINCT source FROM l)),
p AS (SELECT l.*, s.t, row_number() OVER (PARTITION BY s.t ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY s.t) AS n
  FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source),
low AS (SELECT t, 0 AS level, pos, leaf AS d, n FROM p
  UNION ALL SELECT t, level + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM low WHERE n > 1 GROUP BY t, level, pos // 3),
sub AS (SELECT t, d FROM low WHERE n = 1),
high AS (SELECT 0 AS level, t AS pos, d, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3),
g1 AS (SELECT t, level, pos // 3 AS up, list(d ORDER BY pos) AS ds FROM low WHERE n > 1 GROUP BY ALL),
g2 AS (SELECT level, pos // 3 AS up, list(d ORDER BY pos) AS ds FROM high WHERE n > 1 GROUP BY ALL),
w1 AS (SELECT rid, t, pos, 0 AS level, changed AS d, n, '' AS proof FROM p
  UNION ALL SELECT rid, w.t, w.pos // 3, w.level + 1, sha256(array_to_string(list_transform(ds, lambda x, i: CASE WHEN i = w.pos % 3 + 1 THEN w.d ELSE x END), '')), (n + 2) // 3,
    proof || array_to_string(list_filter(ds, lambda x, i: i <> w.pos % 3 + 1), '') FROM w1 w JOIN g1 g ON n > 1 AND g.t = w.t AND g.level = w.level AND g.up = w.pos // 3),
w2 AS (SELECT rid, t AS pos, 0 AS level, d, (SELECT count(*) FROM sub) AS n, proof FROM w1 WHERE n = 1
  UNION ALL SELECT rid, w.pos // 3, w.level + 1, sha256(array_to_string(list_transform(ds, lambda x, i: CASE WHEN i = w.pos % 3 + 1 THEN w.d ELSE x END), '')), (n + 2) // 3,
    proof || array_to_string(list_filter(ds, lambda x, i: i <> w.pos % 3 + 1), '') FROM w2 w JOIN g2 g ON n > 1 AND g.level = w.level AND g.up = w.pos // 3)
SELECT p.doc_id, p.leaf, sub.d AS subroot, r.d AS root, sha256(w2.proof) AS proof_sha256, w2.d AS folded_root, w2.d = r.d AS verified
FROM p JOIN sub ON p.t = sub.t JOIN w2 ON w2.rid = p.rid AND w2.n = 1 CROSS JOIN (SELECT d FROM high WHERE n = 1) r"""

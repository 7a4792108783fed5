"""Log files as ordered lines: discovery, attribution to a root, line numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import NOT_BLANK
from ..operators.scan import CHUNK, COLD, Order
from ..params import SOURCE_A, Root
from ..session import hot_bytes, if_found, stage

#: Files opened by their names; a longer list of changed files is a scan of the folders.
NAMED_FILES = 10_000
#: Splits whose line counts are broadcast, some 100 bytes each.
NAMED_SPLITS = 1_000_000
SUBAGENT_FILE = "^[^/]+/subagents/[^/]+$"


@dataclass(frozen=True)
class Lines:
    """Lines and the order they form; ``order.chunk`` is set when some file is huge."""

    df: DataFrame
    order: Order


def qualified(spark: SparkSession, roots: list[Root]) -> list[Root]:
    """Roots by the full paths that file listings give: with the file system's name, local ones without.

    A directory gives the same ids however it was written (relative, plain, with a scheme).
    """
    out = []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root.path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        full = files.makeQualified(path).toString()
        out.append(replace(root, directory=re.sub("^file:/+", "/", full)))
    return out


def _globs(root: Root) -> list[str]:
    # Family A keeps sessions at the top and child transcripts one level down; family B is a tree.
    if root.recursive:
        return [root.path]
    return [f"{root.path}/*{root.suffix}", f"{root.path}/*/subagents/*{root.suffix}"]


def plain_path(uri: Column) -> Column:
    """File URI to path."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def _relative(path: Column, root: Root) -> Column:
    prefix = root.path.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30))


def _owned(path: Column, root: Root) -> Column:
    """Whether discovery from this root reaches the file."""
    rel = _relative(path, root)
    shape = F.lit(True) if root.recursive else ~rel.contains("/") | rel.rlike(SUBAGENT_FILE)
    return F.coalesce(rel.isNotNull() & shape & path.endswith(root.suffix), F.lit(False))


def _attributes(path: Column, root: Root, rank: int) -> dict[str, Column]:
    rel = _relative(path, root)
    space = "/".join([root.source, root.origin, root.root_key])
    return {
        "source": F.lit(root.source),
        "file_path": path,
        "rel_path": rel,
        "file_id": F.concat(F.lit(space + "/"), rel),
        "extra_root": F.lit(root.origin == "extra"),
        "root_dir": F.lit(root.path),
        "root_rank": F.lit(rank),
        "subagent_dir": F.lit(root.source == SOURCE_A) & rel.rlike(SUBAGENT_FILE),
    }


def _per_root(spark: SparkSession, roots: list[Root], read, columns, globs=_globs) -> DataFrame | None:
    """Union over roots; a file reachable from several roots of one source goes to the first."""
    parts = []
    for i, root in enumerate(roots):
        earlier = [r for r in roots[:i] if r.source == root.source]
        for glob in globs(root):
            df = if_found(lambda glob=glob, suffix=root.suffix: read(glob, suffix))
            if df is None:
                continue
            path = plain_path(F.col("_metadata.file_path"))
            mine = reduce(lambda c, r: c & ~_owned(path, r), earlier, _owned(path, root))
            parts.append(df.where(mine).select(*columns(path, root, i)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def check_root_keys(roots: list[Root]) -> None:
    """Two directories must not share one id namespace."""
    seen: dict[tuple, str] = {}
    for r in roots:
        space = (r.source, r.origin, r.root_key)
        if r.origin == "extra" and seen.setdefault(space, r.path) != r.path:
            raise ValueError(f"root key {r.root_key!r} names two directories")


def manifest(spark: SparkSession, roots: list[Root]) -> DataFrame | None:
    """One row per log file: attributes, size and modification time. Contents are not read."""
    roots = qualified(spark, roots)
    check_root_keys(roots)

    def read(glob: str, suffix: str) -> DataFrame:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        return reader.option("pathGlobFilter", "*" + suffix).load(glob)

    def columns(path: Column, root: Root, rank: int) -> list[Column]:
        attrs = [c.alias(n) for n, c in _attributes(path, root, rank).items()]
        return [*attrs, F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")]

    # Folders are listed whole: a glob would name every file, and each name costs a task of the listing.
    return _per_root(spark, roots, read, columns, lambda root: [root.path])


def _chosen(spark: SparkSession, only: DataFrame) -> dict[str, list[str]] | None:
    """Paths of the files in ``only`` by root, or None if they are too many to name one by one."""
    rows = only.select("root_dir", "file_path").limit(NAMED_FILES + 1).collect()
    if len(rows) > NAMED_FILES:
        return None
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r.root_dir, []).append(re.sub(r"([*?\[\]{}\\])", r"\\\1", r.file_path))
    return out


def _raw_lines(spark: SparkSession, roots: list[Root], only: DataFrame | None) -> DataFrame | None:
    """Lines as the scan gives them: attributes, value, size of the file, offset of the split, running id."""
    named = None if only is None else _chosen(spark, only)

    def read(path, suffix: str) -> DataFrame:
        reader = spark.read.option("lineSep", "\n")
        if named is None:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*" + suffix)
        return reader.text(path)

    def columns(path: Column, root: Root, rank: int) -> list[Column]:
        attrs = [c.alias(n) for n, c in _attributes(path, root, rank).items()]
        meta = F.col("_metadata")
        return [
            *attrs,
            "value",
            meta.file_size.alias("_size"),
            meta.file_block_start.alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        ]

    if named is not None:
        parts = []
        for i, root in enumerate(roots):
            if root.path in named:
                # A file that is gone by now: look for what is left as if there were no list.
                df = if_found(lambda root=root: read(named[root.path], root.suffix))
                if df is None:
                    named = None
                    break
                parts.append(df.select(*columns(plain_path(F.col("_metadata.file_path")), root, i)))
        else:
            return reduce(DataFrame.unionByName, parts) if parts else None
    raw = _per_root(spark, roots, read, columns)
    return raw if raw is None or only is None else raw.join(only.select("file_id"), "file_id", "left_semi")


def read_lines(spark: SparkSession, roots: list[Root], only: DataFrame | None = None) -> Lines | None:
    """Numbered lines of every file under ``roots`` (of the files in ``only``, a part of the manifest, if given).

    Columns: file attributes, ``line_no``, ``value``. Blank lines are dropped after numbering. Up to ``NAMED_FILES``
    files of ``only`` are opened by name, so that a cycle with few changes lists and opens nothing else.

    A file's splits are read in parallel, and lines stay where they were read: a first scan counts the lines of
    each split, the counts are summed per file, and a line's number is its place in its split plus the lines of the splits
    before. That is one row per split, broadcast up to ``NAMED_SPLITS`` of them; the scan's running ids are the same both
    times, as they depend on the files listed when the scan was planned.
    """
    roots = qualified(spark, roots)
    check_root_keys(roots)
    raw = _raw_lines(spark, roots, only)
    if raw is None:
        return None
    key = ["file_id", "_block"]
    counts = raw.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"), F.max("_size").alias("_most"))
    counts = stage(counts, "splits")
    size = counts.agg(F.count(F.lit(1)).alias("splits"), F.max("_most").alias("most")).first()
    limit = hot_bytes(spark)
    huge = size.most is not None and size.most > limit
    before = F.sum("_n").over(Window.partitionBy("file_id").orderBy("_block")) - F.col("_n")
    shifts = counts.select(*key, (before - F.col("_first")).alias("_shift"))
    if size.splits <= NAMED_SPLITS:
        shifts = F.broadcast(shifts)
    raw = raw.withColumn(CHUNK, F.when(F.col("_size") > limit, F.col("_block")).otherwise(F.lit(COLD)))
    numbered = raw.join(shifts, key).withColumn("line_no", F.col("_mid") + F.col("_shift"))
    filled = numbered.where(F.col("value").rlike(NOT_BLANK)).drop("_block", "_mid", "_size", "_shift")
    return Lines(filled, Order(("file_id",), ("line_no",), CHUNK if huge else None))


def bad_lines(parsed: DataFrame) -> DataFrame:
    """Lines per file that are not JSON objects."""
    return parsed.groupBy("source", "file_id").agg(
        F.count_if(~F.col("ok")).alias("bad_lines"), F.count(F.lit(1)).alias("lines")
    )

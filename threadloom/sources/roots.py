"""Where a project's logs lie: candidate directories, nested projects, session-name indexes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belonging, names
from ..params import SOURCE_A, SOURCE_B, Params, Root
from ..session import stage
from .lines import qualified, read_lines


def encoded(cwd: str) -> str:
    """Directory name of a working directory; several directories may share one."""
    return re.sub("[^a-zA-Z0-9]", "-", cwd)


def project_roots(projects_dir: str, params: Params) -> list[Root]:
    """Family-A directories of the project and its extra directories."""
    dirs = dict.fromkeys(f"{projects_dir.rstrip('/')}/{encoded(c)}" for c in params.wanted_cwds)
    return [Root(d, SOURCE_A) for d in dirs]


def nested_roots(spark: SparkSession, projects_dir: str, params: Params) -> list[Root]:
    """Family-A directories of projects nested below, confirmed by their first logged directory.

    Only directories with the project's name as prefix are read, and of those only the directory
    field. The result is a list of parameters, as long as the project has nested directories.
    """
    base = qualified(spark, [Root(projects_dir, SOURCE_A)])[0].path
    lines = read_lines(spark, [Root(base, SOURCE_A, tree=True)])
    if lines is None:
        return []
    top = F.element_at(F.split("rel_path", "/"), 1)
    prefix = encoded(params.project) + "-"
    rows = lines.df.where((F.size(F.split("rel_path", "/")) == 2) & top.startswith(prefix))
    rows = rows.withColumn("dir", F.concat(F.lit(base + "/"), top))
    cwd = F.from_json("value", "cwd STRING")["cwd"]
    first = rows.select("dir", "file_id", "line_no", cwd.alias("cwd")).groupBy("dir", "file_id").agg(
        F.coalesce(F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))), F.lit(""))
        .alias("first_cwd")
    )
    dirs = belonging.nested_dirs(first, params).orderBy("dir")
    return [Root(r.dir, SOURCE_A) for r in dirs.toLocalIterator()]


def _index_paths(root: Root) -> list[str]:
    parent = root.path.rsplit("/", 1)[0]
    above = f"{parent}/session_index.jsonl"
    return [above] if root.origin == "standard" else [f"{root.path}/session_index.jsonl", above]


def index_names(spark: SparkSession, roots: list[Root]) -> DataFrame | None:
    """Renamed family-B threads per root: root_dir, id, name ('' where the name was cleared)."""
    parts = []
    for root in qualified(spark, [r for r in roots if r.source == SOURCE_B]):
        found = [names.read_index(spark, p) for p in _index_paths(root)]
        latest = [names.latest_names(f) for f in found if f is not None]
        if latest:
            merged = reduce(names.merge_indexes, latest)
            parts.append(merged.select(F.lit(root.path).alias("root_dir"), "id", "name"))
    return stage(reduce(DataFrame.unionByName, parts), "index-names") if parts else None

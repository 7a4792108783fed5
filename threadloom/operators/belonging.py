"""Which files, sessions and units belong to the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import str_at, text_at
from ..functions.text import encode_cwd, within
from ..params import SOURCE_A, SOURCE_B, Params


def wanted(cwd: Column, params: Params) -> Column:
    hit = cwd.isin(list(params.wanted_cwds))
    if params.include_subdirectories:
        hit = hit | within(cwd, params.project)
    return F.coalesce(hit & (cwd != ""), F.lit(False))


def cwd_verdicts(lines: DataFrame, params: Params) -> DataFrame:
    """Per family-B file: can it belong? Looks only at lines that mention a directory.

    A file is dropped only on proof: directories were seen, none belongs, and no unknown record
    type carries one. Files of extra roots are always kept.
    """
    gated = lines.where(F.col("value").contains('"cwd"'))
    gated = gated.select("file_id", "extra_root", F.try_parse_json("value").alias("v"))
    v = F.col("v")
    known = str_at(v, "$.type").isin("session_meta", "turn_context")
    cwd = F.when(known, str_at(v, "$.payload.cwd"))
    seen = gated.groupBy("file_id", "extra_root").agg(
        F.bool_or(wanted(cwd, params)).alias("belongs"),
        F.count_if(cwd != "").alias("cwds"),
        F.bool_or(~known & text_at(v, "$.payload.cwd").isNotNull()).alias("unknown_format"),
    )
    keep = (
        F.col("extra_root")
        | F.coalesce("belongs", F.lit(False))
        | F.coalesce("unknown_format", F.lit(False))
        | (F.col("cwds") == 0)
    )
    return seen.withColumn("keep", keep)


def drop_foreign(lines: DataFrame, params: Params) -> DataFrame:
    """Lines without the files that provably belong elsewhere."""
    foreign = cwd_verdicts(lines.where(F.col("source") == SOURCE_B), params).where(~F.col("keep"))
    return lines.join(foreign.select("file_id"), "file_id", "left_anti")


def nested_dirs(first_cwds: DataFrame, params: Params) -> DataFrame:
    """Family-A directories nested below the project: the encoded name has the project's prefix,
    and the first logged directory confirms it (the encoding is lossy).

    ``first_cwds``: dir, file_id, first_cwd.
    """
    name = F.regexp_replace("dir", "^.*/", "")
    prefix = F.concat(encode_cwd(F.lit(params.project)), F.lit("-"))
    first = (
        first_cwds.where(name.startswith(prefix))
        .groupBy("dir")
        .agg(F.min_by("first_cwd", F.when(F.col("first_cwd") != "", F.col("file_id"))).alias("cwd"))
    )
    return first.where(within(F.col("cwd"), params.project)).select("dir")


def own_units(units: DataFrame, sessions: DataFrame, params: Params) -> DataFrame:
    """Family A belongs as a whole file; family B unit by unit, unless its root is trusted."""
    trusted = sessions.where(F.col("recognised")).select("file_id", "extra_root")
    joined = units.join(trusted, "file_id")
    keep = (
        (F.col("source") == SOURCE_A) | F.col("extra_root") | wanted(F.col("cwd"), params)
    )
    return joined.where(keep).drop("extra_root")


def own_sessions(sessions: DataFrame, units: DataFrame, params: Params) -> DataFrame:
    """Sessions that stay, also without units when their own directory belongs. Adds ``units``."""
    counts = units.groupBy("file_id").agg(F.count(F.lit(1)).alias("units"))
    joined = sessions.where(F.col("recognised")).join(counts, "file_id", "left")
    joined = joined.withColumn("units", F.coalesce("units", F.lit(0).cast("bigint")))
    keep = (
        (F.col("source") == SOURCE_A)
        | F.col("extra_root")
        | (F.col("units") > 0)
        | wanted(F.col("session_cwd"), params)
    )
    return joined.where(keep)


def display_filter(units: DataFrame, params: Params) -> DataFrame:
    """Adds ``hidden``: a subagent unit of a source that does not show them."""
    hidden = F.lit(False)
    if not params.include_subagents_a:
        hidden = hidden | ((F.col("source") == SOURCE_A) & F.col("is_subagent"))
    if not params.include_subagents_b:
        hidden = hidden | ((F.col("source") == SOURCE_B) & F.col("is_subagent"))
    return units.withColumn("hidden", hidden)

"""Keeping a copy of the raw logs of the project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha, within
from ..params import SOURCE_A


def archive_files(files: DataFrame, sessions: DataFrame, archive: str) -> DataFrame:
    """Which logs to keep, and under which relative path.

    Recognised logs of belonging sessions, and family-A child transcripts always; nothing that
    already lies in the archive. Where two files of one source share a relative path, all but the
    first carry a hash of their full path.

    ``files``: source, file_id, file_path, rel_path, root_rank, subagent_dir.
    """
    own = sessions.select("file_id", F.lit(True).alias("_own"))
    child = (F.col("source") == SOURCE_A) & F.col("subagent_dir")
    kept = files.join(own, "file_id", "left").where(F.coalesce("_own", F.lit(False)) | child)
    kept = kept.where(~within(F.col("file_path"), archive)).drop("_own")
    first = kept.groupBy("source", "rel_path").agg(
        F.min(F.struct("root_rank", "file_path")).alias("_first")
    )
    kept = kept.join(first, ["source", "rel_path"])
    unique = F.struct("root_rank", "file_path") == F.col("_first")
    stem, end = F.regexp_replace("rel_path", r"\.[^./]*$", ""), F.regexp_extract("rel_path", r"(\.[^./]*)$", 1)
    named = F.concat(stem, F.lit("__"), sha(F.col("file_path"), 8), end)
    return kept.withColumn("archive_path", F.when(unique, F.col("rel_path")).otherwise(named)).drop("_first")


def write_archive(lines: DataFrame, files: DataFrame, archive: str, run: str) -> None:
    """Store the raw lines of ``files`` under a new run folder; existing data is never replaced.

    Rows are spread by (file, line range), so a huge log is written by many tasks. ``line_no``
    restores the order.
    """
    keep = files.select("file_id", "archive_path")
    out = lines.select("source", "file_id", "line_no", "value").join(keep, "file_id")
    (
        out.repartitionByRange("source", "archive_path", "line_no")
        .sortWithinPartitions("source", "archive_path", "line_no")
        .select("source", "archive_path", "line_no", "value")
        .write.partitionBy("source")
        .mode("errorifexists")
        .parquet(f"{archive.rstrip('/')}/{run}")
    )


def read_archive(spark, archive: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{archive.rstrip('/')}/{run}")

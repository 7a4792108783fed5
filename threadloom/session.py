"""Session plumbing shared by every job: shared scratch space and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "spark.threadloom.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
HOT_BYTES_CONF = "spark.threadloom.hotBytes"
HOT_BYTES_DEFAULT = 512 * 1024 * 1024


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def hot_rows(spark: SparkSession) -> int:
    """Rows one key may hold before its rows are cut into ordered chunks."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def hot_bytes(spark: SparkSession) -> int:
    """Size of a log file above which its splits become ordered chunks."""
    return int(spark.conf.get(HOT_BYTES_CONF, str(HOT_BYTES_DEFAULT)))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where a local session names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def if_found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None where its path does not exist. Any other failure is raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scratch_dir(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/threadloom/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Used where a result feeds several later jobs. Lost executors cost nothing: readers go back to
    the written files, not to lineage; later scans stay column-pruned.
    """
    path = scratch_dir(spark_of(df), label)
    df.write.parquet(path)
    return spark_of(df).read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table of this run that nothing reads any more, which makes room for those that follow."""
    spark = spark_of(df)
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getParent().getName() != "threadloom":
            raise ValueError(f"{path} is no staged table")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Stable block ids and the total order of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUL, nul_join, present, sha
from .scan import cut_hot, running, sum_before, total_rank

TOTAL_ORDER = [
    "_late", "_ms", "ts_raw", "source", "session_id", "_uuid", "file_id", "ordinal",
]


def session_key():
    """The session id, or the file where no session is named."""
    return F.coalesce(present(F.col("session_id")), F.col("file_id"))


def block_ids(units: DataFrame, prefix: str = "blockid") -> DataFrame:
    """Adds ``block_id``: a hash of what identifies a question, independent of its answer.

    Units of one session asked at the same instant are told apart by their rank. The subagent flag
    separates the ranking but is not hashed, so showing or hiding subagents moves no other id.
    """
    df = units.withColumns(
        {
            "_uuid": F.coalesce("q_uuid", F.lit("")),
            "_qhash": sha(F.col("question")),
            "_tie": F.concat("file_id", F.lit(NUL), F.col("ordinal").cast("string")),
        }
    )
    group = ["source", "session_id", "ts_raw", "is_subagent"]
    df, order = cut_hot(df, group, ["_uuid", "_qhash", "_tie"])
    df = running(df, order, collision=sum_before(F.lit(1).cast("bigint")))
    question = F.coalesce(present(F.col("_uuid")), F.col("_qhash"))
    material = nul_join(F.col("source"), session_key(), F.col("ts_raw"), question, F.col("collision"))
    block = F.concat(F.lit(prefix + ":"), sha(material, 24))
    return df.withColumn("block_id", block).drop("_uuid", "_qhash", "_tie", "_chunk", "collision")


def with_order_columns(units: DataFrame) -> DataFrame:
    """Sortable columns of the 8-key order: readable times first, then time, raw text, source,
    session, question id, file, place in the session."""
    return units.withColumns(
        {
            "_late": F.col("ts_ms").isNull(),
            "_ms": F.coalesce("ts_ms", F.lit(0).cast("bigint")),
            "_uuid": F.coalesce("q_uuid", F.lit("")),
        }
    )


def timeline(units: DataFrame, name: str = "ord") -> DataFrame:
    """Adds the 0-based position in the total order."""
    ranked = total_rank(with_order_columns(units), TOTAL_ORDER, name)
    return ranked.drop("_late", "_ms", "_uuid")


def ordinals(units: DataFrame) -> DataFrame:
    """Place of each unit in its session: the main conversation first, then the side one."""
    key, seq = ["source", "file_id"], ["side", "pair"]
    df, order = cut_hot(units, key, seq)
    return running(df, order, ordinal=sum_before(F.lit(1).cast("bigint"))).drop("_chunk")

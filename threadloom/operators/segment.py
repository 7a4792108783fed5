"""Cutting event streams into question units.

Each rule is a short chain of running values over one order, so every stream needs one exchange
and one sort. Rows get ``pair`` (1, 2, … within the stream; 0 before the first question) and
``opener``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Order, last_before, last_upto, next_after, running, sum_before, sum_upto

# Kinds of a family-A row.
QUEUED, HUMAN, META, TOOL, ANSWER = "K", "Q", "M", "T", "A"
# Kinds of a family-B row: asked, instruction received, reply from a delegate, activity.
ASKED, RECEIVED, REPLY, ACTIVITY = "U", "R", "D", "X"


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def segment_a(df: DataFrame, order: Order, kind: str = "kind", parent: str = "parent") -> DataFrame:
    """A question opens a unit when none is open or the open one is answered; a retyped question
    (same parent as the opener) opens one too. Adds ``answered``: the unit has an answer before
    the row."""
    k = F.col(kind)
    asks = k.isin(QUEUED, HUMAN)
    df = running(
        df,
        order,
        _prev=last_before(F.when(k.isin(QUEUED, HUMAN, ANSWER), k)),
        _asked=sum_before(_flag(asks)),
    )
    # Answers before the first question belong to nothing; the first question opens a unit anyway.
    fresh = asks & ((F.col("_asked") == 0) | (F.col("_prev") == ANSWER))
    df = df.withColumn("_fresh", F.coalesce(fresh, F.lit(False)))
    df = running(
        df,
        order,
        _head=last_upto(F.when(F.col("_fresh"), F.struct(F.col(parent).alias("parent")))),
    )
    retyped = (k == HUMAN) & (F.col(parent) != "") & (F.col(parent) == F.col("_head.parent"))
    opener = F.col("_fresh") | F.coalesce(asks & retyped, F.lit(False))
    df = df.withColumn("opener", opener)
    df = running(
        df,
        order,
        pair=sum_upto(_flag(F.col("opener"))),
        # Whether the unit is answered so far: the nearest opener or answer is an answer.
        _state=last_before(F.when(F.col("opener"), F.lit("open")).when(k == ANSWER, F.lit("done"))),
    )
    answered = (F.col("_state") == "done") & ~F.col("opener") & (F.col("pair") > 0)
    return df.withColumn("answered", F.coalesce(answered, F.lit(False))).drop(
        "_prev", "_asked", "_fresh", "_head", "_state"
    )


def segment_b(df: DataFrame, order: Order, kind: str = "kind") -> DataFrame:
    """A question opens a unit when none is open, when it was received from a parent session, or
    after any activity. A delegate's reply is activity, unless nothing is open yet."""
    k = F.col(kind)
    starts = k.isin(ASKED, RECEIVED, REPLY)
    df = running(df, order, _prev=last_before(k), _started=sum_before(_flag(starts)))
    first = starts & (F.col("_started") == 0)
    reply_opened = (F.col("_prev") == REPLY) & (F.col("_started") == 1)
    active = (F.col("_prev") == ACTIVITY) | ((F.col("_prev") == REPLY) & ~reply_opened)
    later = k.isin(ASKED, RECEIVED) & ((k == RECEIVED) | active)
    df = df.withColumn("opener", F.coalesce(first | later, F.lit(False)))
    df = running(df, order, pair=sum_upto(_flag(F.col("opener"))))
    return df.drop("_prev", "_started")


def progress_position(df: DataFrame, order: Order, is_answer: Column) -> DataFrame:
    """``final`` marks the last answer of a unit; ``place``/``place_tie`` order progress records.

    An earlier answer enters progress when the next answer arrives, that is after the records in
    between, so it is placed at the next answer's position.
    """
    seq = order.seq[-1]
    mark = F.when(is_answer, F.struct(F.col("pair").alias("pair"), F.col(seq).alias("seq")))
    df = running(df, order, _next=next_after(mark))
    passed = is_answer & (F.col("_next.pair") == F.col("pair"))
    passed = F.coalesce(passed, F.lit(False))
    return df.withColumns(
        {
            "final": is_answer & ~passed,
            "place": F.when(passed, F.col("_next.seq")).otherwise(F.col(seq)),
            "place_tie": F.when(passed, F.lit(0)).otherwise(F.lit(1)),
        }
    ).drop("_next")

"""Watching log folders: every trigger runs one incremental cycle."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..params import Params
from ..plans.incremental import Cycle, Store, run_cycle

log = logging.getLogger(__name__)


def watch(
    spark: SparkSession,
    params: Params,
    store: Store,
    every: str = "5 seconds",
    on_cycle: Callable[[Cycle], None] | None = None,
):
    """Start a query that re-evaluates the logs at a fixed pace; stop it like any query.

    A clock stream drives it, because a file that grew is not delivered again by a file stream.
    A failing cycle is reported and the next one runs.
    """

    def tick(batch: DataFrame, _: int) -> None:
        try:
            cycle = run_cycle(batch.sparkSession, params, store)
        except Exception:  # the logs may simply not be there yet
            log.exception("cycle failed")
            return
        if on_cycle is not None and cycle.outcome != "noop":
            on_cycle(cycle)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=every).start()

"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import contextlib
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from threadloom.params import SOURCE_A, SOURCE_B, Params, Root
from threadloom.plans import catalog
from threadloom.plans.incremental import Store, run_cycle
from threadloom.plans.views import lines_a, lines_b
from threadloom.session import scratch_dir

HEADLINE = [
    "pairs_segment_a", "pairs_segment_b", "units_a", "context_fill", "units_b", "timeline_blocks",
    "fork_dedupe", "logical_dedupe", "ancestor_closure", "inherited_survivors", "block_diff",
    "render_blocks", "file_lines", "prefilter_files",
]


def timed(fn):
    start = time.perf_counter()
    fn()
    return round(time.perf_counter() - start, 3)


def cycles(spark, sf):
    """A first cycle over logs written from the tables, then one in which nothing changed."""
    roots = [
        Root(catalog.write_logs(spark, sf, make(spark, sf)), source, suffix=".txt", tree=True)
        for source, make in ((SOURCE_A, lines_a), (SOURCE_B, lines_b))
    ]
    params = Params(project="/w", roots=tuple(roots))
    store = Store(spark, scratch_dir(spark, "store"))
    return {
        "cycle_first": timed(lambda: run_cycle(spark, params, store)),
        "cycle_unchanged": timed(lambda: run_cycle(spark, params, store)),
    }


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="threadloom-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    only = set(sys.argv[1:])
    times = {}
    for name in HEADLINE:
        if not only or name in only:
            times[name] = timed(
                lambda n=name: catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            )
    if not only or "cycles" in only:
        with contextlib.redirect_stdout(io.StringIO()):
            times |= cycles(spark, sf)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

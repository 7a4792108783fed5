"""Compare registered queries with their SQL: python tests/check_queries.py SF_DIR [name …]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(repr(r[i]) for i in order))
    return sorted(cols), sorted(out)


def main(sf, only):
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            cols, got = normal(df.collect(), df.columns)
            took = time.time() - start
            if name not in sqls:
                print(f"{name}: {len(got)} rows, no SQL, {took:.1f}s", flush=True)
                continue
            rel = db.sql(sqls[name])
            want_cols, want = normal(rel.fetchall(), rel.columns)
            ok = (cols, got) == (want_cols, want)
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(got)}/{len(want)} rows {took:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                a, b = set(got), set(want)
                print("  columns", cols, want_cols, [str(t) for t in rel.types])
                for side, rows in (("only here", a - b), ("only SQL", b - a)):
                    print(f"  {side} {len(rows)}", [str(r)[:300] for r in sorted(rows)[:3]])
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], set(sys.argv[2:])))

"""Repeated runs: parse only files that changed, and write only what is new.

The store is a folder of append-only parquet tables. A cycle adds the results of the files it
parsed and a manifest naming, for every file, the cycle that holds its results; nothing is
rewritten, a lost cycle leaves the previous one intact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import belonging, diff
from ..params import SOURCE_B, Params
from ..session import if_found, stage
from ..sources.lines import Lines, manifest, read_lines
from .run import Parsed, aggregate, attribute, parse_family

STAMP = ["file_id", "size", "mtime", "root_dir", "fingerprint"]


def changed_files(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Files whose size, time, root or parameters differ from the stored ones, or that are new."""
    return new if old is None else new.join(old.select(*STAMP), STAMP, "left_anti")


def vanished_files(new: DataFrame, old: DataFrame) -> DataFrame:
    return old.join(new.select("file_id"), "file_id", "left_anti")


@dataclass
class Cycle:
    number: int
    parsed: int
    reused: int
    outcome: str
    added: int
    preserved: bool


class Store:
    """Tables of one output folder (shared storage)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame | None:
        return if_found(lambda: self.spark.read.parquet(f"{self.path}/{name}"))

    def newest(self, name: str, by: str = "cycle") -> int | None:
        """Number of the newest cycle of a table, from the names of its folders: no job."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return max((int(n.split("=")[1]) for n in names if n.startswith(by + "=")), default=None)

    def latest(self, name: str) -> DataFrame | None:
        """Rows of the newest finished cycle of a table; no other cycle is listed or read."""
        top = self.newest(name)
        if top is None:
            return None
        rows = self.spark.read.parquet(f"{self.path}/{name}/cycle={top}")
        return rows.withColumn("cycle", F.lit(top))

    def append(self, df: DataFrame, name: str, value, by: str = "cycle") -> None:
        df.withColumn(by, F.lit(value)).write.mode("append").partitionBy(by).parquet(
            f"{self.path}/{name}"
        )


@dataclass
class Survey:
    """The log folders now, against the stored manifest."""

    now: DataFrame
    old: DataFrame | None
    last: int | None  # newest stored cycle
    files: int
    to_parse: int
    gone: bool


def survey(spark: SparkSession, params: Params, store: Store) -> Survey:
    """Lists the files and counts what changed, in one job; contents are not read, nothing is written."""
    now = manifest(spark, [r for r in params.roots if r.source in params.sources])
    if now is None:
        raise ValueError("no log files under the given roots")
    now = now.withColumn("fingerprint", F.lit(params.fingerprint()))
    last = store.newest("manifest")
    old = None if last is None else store.latest("manifest").drop("cycle")
    sides = now.select(*STAMP, F.lit(True).alias("here"))
    if old is not None:
        sides = sides.unionByName(old.select(*STAMP, F.lit(False).alias("here")))
    stamp = F.struct(*STAMP[1:])
    each = sides.groupBy("file_id").agg(
        F.max(F.when(F.col("here"), stamp)).alias("new"), F.max(F.when(~F.col("here"), stamp)).alias("was"))
    is_new = F.col("new").isNotNull()
    counts = each.agg(
        F.count_if(is_new).alias("files"),
        F.count_if(is_new & ~F.col("new").eqNullSafe(F.col("was"))).alias("changed"),
        F.count_if(~is_new).alias("gone")).first()
    return Survey(now, old, last, counts.files, counts.changed, counts.gone > 0)


def names_digest(*tables: DataFrame | None) -> str:
    """Changes when any session name given from outside does."""
    parts = []
    for t in tables:
        if t is not None:
            row = F.xxhash64("root_dir", "id", "name").cast("decimal(20,0)")
            parts.append(str(t.agg(F.count(F.lit(1)), F.sum(row)).first()))
    return "|".join(parts)


TABLES = ("sessions", "entries", "events", "bad", "content")


def refresh(
    spark: SparkSession, params: Params, store: Store, seen: Survey, dry_run: bool = False
) -> tuple[list[Parsed], int]:
    """Bring the stored per-file results up to date; (families, cycle).

    A dry run computes the same families without writing to the store: new results stay in scratch tables.
    """
    old = seen.old
    now = stage(seen.now, "manifest")
    cycle = 0 if seen.last is None else seen.last + 1
    changed = stage(changed_files(now, old), "changed")
    print_ = F.lit(params.fingerprint())
    # Results are filed under a run of their own, so what a crashed run left is never picked up.
    run = f"r{cycle}-{uuid.uuid4().hex[:12]}"
    fresh: dict[str, DataFrame] = {}
    for source in params.sources:
        todo = changed.where(F.col("source") == source)
        if not todo.isEmpty():
            roots = [r for r in params.roots if r.source == source]
            lines = read_lines(spark, roots, only=todo)
            if lines is not None:
                kept = lines
                if source == SOURCE_B:
                    kept = Lines(belonging.drop_foreign(lines.df, params), lines.order)
                fam = parse_family(kept, source, params)
                for name in TABLES:
                    if dry_run:
                        fresh[f"{name}-{source}"] = getattr(fam, name).withColumn("run", F.lit(run))
                    else:
                        store.append(getattr(fam, name), f"{name}-{source}", run, "run")
    home = now.join(changed.select("file_id", F.lit(run).alias("_new")), "file_id", "left")
    if old is None:
        home = home.withColumn("home", F.lit(run)).drop("_new")
    else:
        prior = old.select("file_id", F.col("home").alias("_old"))
        home = home.join(prior, "file_id", "left").withColumn("home", F.coalesce("_new", "_old"))
        home = home.drop("_new", "_old")
    # A file that changed while it was read is used now and parsed again next time.
    after = manifest(spark, [r for r in params.roots if r.source in params.sources])
    home = stage(home, "home")
    if after is not None:
        moved = home.join(
            after.withColumn("fingerprint", print_).select(*STAMP), STAMP, "left_anti"
        ).select("file_id", F.lit(True).alias("_moved"))
        home = home.join(moved, "file_id", "left").withColumn(
            "mtime", F.when(F.col("_moved"), F.lit(-1)).otherwise(F.col("mtime"))
        ).drop("_moved")
    if not dry_run:
        store.append(home, "manifest", cycle)
    current = home.select("file_id", F.col("home").alias("run"))
    families = []
    for source in params.sources:

        def live(name: str, source: str = source) -> DataFrame:
            # Results of vanished files and of superseded parses find no partner here.
            parts = [store.read(f"{name}-{source}"), fresh.get(f"{name}-{source}")]
            rows = reduce(DataFrame.unionByName, [p for p in parts if p is not None])
            return rows.join(current, ["file_id", "run"], "left_semi").drop("run")

        if store.read(f"sessions-{source}") is None and f"sessions-{source}" not in fresh:
            continue
        families.append(Parsed(source, *[live(n) for n in TABLES]))
    return families, cycle


class NotPreserved(RuntimeError):
    """The kept copy of a snapshot does not equal it, so the snapshot was left in place."""


def keep(store: Store, snapshot: DataFrame, number: int) -> None:
    """Write a copy of a snapshot aside and prove that it reads back as the same rows in the same places."""
    store.append(snapshot, "preserved", number)
    copy = store.spark.read.schema(snapshot.schema).parquet(f"{store.path}/preserved/cycle={number}")
    if diff.snapshot_digest(copy) != diff.snapshot_digest(snapshot):
        raise NotPreserved(f"the copy of cycle {number} differs from the snapshot; nothing was rewritten")


def run_cycle(
    spark: SparkSession,
    params: Params,
    store: Store,
    index_names: DataFrame | None = None,
    titles: DataFrame | None = None,
    dry_run: bool = False,
) -> Cycle:
    """One complete cycle: refresh, attribute, lay out, compare, write what changed.

    Names and project membership are applied after the stored stage, so they are always current.
    The previous snapshot is kept aside before a rewrite that would lose a block; the copy is read back and compared
    first, and nothing is rewritten if it differs. ``dry_run`` tells the outcome and writes
    nothing to the store.
    """
    seen = survey(spark, params, store)
    digest = names_digest(index_names, titles)
    done = store.latest("state")
    done = None if done is None else done.first()
    same = done is not None and (done.manifest, done.digest) == (seen.last, digest)
    if same and not seen.to_parse and not seen.gone:
        # Same files, parameters and names give the same blocks.
        return Cycle(seen.last, 0, seen.files, "noop", 0, False)
    families, number = refresh(spark, params, store, seen, dry_run)
    found = attribute(families, params, index_names, titles)
    blocks = stage(
        aggregate(found, params).blocks.select("ord", "block_id", "source", "session_id", "md"), "new"
    )
    top = store.newest("blocks")
    old = None if top is None else store.latest("blocks").drop("cycle")
    result = diff.outcome(old, blocks).first()
    preserve = result.outcome == "rewrite" and diff.destructive(old, blocks)
    if not dry_run:
        if preserve:
            keep(store, old, number)
        if result.outcome in ("create", "rewrite"):
            store.append(blocks, "blocks", number)
        elif result.outcome == "append":
            # The tail joins the snapshot it extends.
            store.append(diff.append_tail(old, blocks), "blocks", top)
        state = spark.createDataFrame([(number, digest)], "manifest int, digest string")
        store.append(state, "state", number)
    parsed = seen.to_parse
    return Cycle(number, parsed, seen.files - parsed, result.outcome, result.added, preserve)

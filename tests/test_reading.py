"""Reading logs: which files are opened, how lines are numbered, and what a cycle writes."""

import json
import os

import pytest

from threadloom.params import SOURCE_A, SOURCE_B, Params, Root
from threadloom.plans import incremental, run
from threadloom.plans.incremental import Store, run_cycle, survey
from threadloom.sources import lines as L


def user(n, cwd="/w/p"):
    return {"type": "user", "uuid": f"u{n}", "parentUuid": None, "timestamp": f"2026-05-27T10:{n % 60:02d}:00.000Z", "cwd": cwd,
            "message": {"role": "user", "content": f"question {n}"}}


@pytest.fixture
def many(write_log):
    for n in range(240):
        folder = write_log(f"logs/s{n}.jsonl", [user(n)])
    return folder / "logs"


def numbers(lines):
    return sorted((r.file_id.rsplit("/", 1)[1], r.line_no, r.value) for r in lines.df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_changed_file_opens_one_file(spark, many, tmp_path):
    params = Params(project="/w/p", roots=(Root(str(many), SOURCE_A),))
    store = Store(spark, str(tmp_path / "store"))
    assert run_cycle(spark, params, store).parsed == 240
    with open(many / "s7.jsonl", "a") as f:
        f.write(json.dumps(user(500) | {"parentUuid": "u7", "timestamp": "2026-06-01T00:00:00.000Z"}) + "\n")
    seen = survey(spark, params, store)
    assert (seen.files, seen.to_parse, seen.gone) == (240, 1, False)
    changed = incremental.changed_files(seen.now, seen.old)
    opened = L.read_lines(spark, list(params.roots), only=changed).df.inputFiles()
    assert [os.path.basename(p) for p in opened if p.endswith(".jsonl")] == ["s7.jsonl"]
    done = run_cycle(spark, params, store)
    assert (done.parsed, done.reused) == (1, 239) and store.latest("blocks").where("md LIKE '%question 500%'").count() == 1
    assert run_cycle(spark, params, store).outcome == "noop"


def test_a_long_list_of_changed_files_is_a_scan(spark, many, monkeypatch):
    roots = [Root(str(many), SOURCE_A)]
    only = L.manifest(spark, roots).where("file_id LIKE '%s1_.jsonl'")
    named = numbers(L.read_lines(spark, roots, only=only))
    monkeypatch.setattr(L, "NAMED_FILES", 3)
    assert numbers(L.read_lines(spark, roots, only=only)) == named and len(named) == 10


def test_named_files_with_odd_names_and_vanished_ones(spark, write_log):
    names = ["a[1].jsonl", "b{2}.jsonl", "c d+%25.jsonl", "e'ü.jsonl"]
    for n, name in enumerate(names):
        folder = write_log(f"odd/{name}", [user(n)])
    roots = [Root(str(folder / "odd"), SOURCE_A)]
    only = spark.createDataFrame(L.manifest(spark, roots).toPandas())
    assert [x[0] for x in numbers(L.read_lines(spark, roots, only=only))] == sorted(names)
    os.remove(folder / "odd" / names[0])
    assert [x[0] for x in numbers(L.read_lines(spark, roots, only=only))] == sorted(names[1:])


@pytest.mark.parametrize("broadcast", [True, False])
def test_numbers_over_many_splits_and_blank_lines(spark, write_log, monkeypatch, broadcast):
    """Lines keep their numbers however a file is split; no exchange carries their text."""
    if not broadcast:
        monkeypatch.setattr(L, "NAMED_SPLITS", 0)
    texts = {f"f{i}.jsonl": [("" if n % 7 == 3 else f'{{"n": {n}, "x": "{"y" * (n % 90)}"}}' if n % 5 else "{broken") for n in range(200 * i)] for i in range(4)}
    for name, rows in texts.items():
        folder = write_log(f"split/{name}", rows)
    expected = sorted((f, n, t) for f, rows in texts.items() for n, t in enumerate(rows) if t)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("900", "7000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = L.read_lines(spark, [Root(str(folder / "split"), SOURCE_A)])
            assert numbers(read) == expected
            above = plan_of(read.df).split("FileScan text")[0]
            assert not broadcast or "hashpartitioning" not in above
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_no_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert L.read_lines(spark, [Root(str(tmp_path / "missing"), SOURCE_A)]) is None
    assert L.manifest(spark, [Root(str(tmp_path / "missing"), SOURCE_A)]) is None


def test_roots_by_relative_and_full_names_give_one_id(spark, write_log, monkeypatch):
    folder = write_log("roots/b/2026/x.jsonl", [{"type": "session_meta", "payload": {"id": "P", "cwd": "/w/p"}}])
    monkeypatch.chdir(folder)
    given = [str(folder / "roots/b"), f"file://{folder}/roots/b", f"file:{folder}/roots/b/"]
    for directory in given:
        found = L.manifest(spark, [Root(directory, SOURCE_B)]).collect()
        assert [(r.rel_path, r.root_dir) for r in found] == [("2026/x.jsonl", given[0])]


def files_below(path):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(path) for f in fs)


def test_dry_run_tells_the_outcome_and_writes_nothing(spark, write_log, tmp_path):
    folder = write_log("dry/one.jsonl", [user(1)])
    params = Params(project="/w/p", roots=(Root(str(folder / "dry"), SOURCE_A),))
    store = Store(spark, str(tmp_path / "store"))
    told = run_cycle(spark, params, store, dry_run=True)
    assert (told.outcome, told.added, told.parsed) == ("create", 1, 1) and not os.path.exists(store.path)
    run_cycle(spark, params, store)
    write_log("dry/two.jsonl", [user(2)])
    held = files_below(store.path)
    told = run_cycle(spark, params, store, dry_run=True)
    assert (told.outcome, told.added, told.parsed, told.reused) == ("append", 1, 1, 1) and files_below(store.path) == held
    done = run_cycle(spark, params, store)
    assert (done.outcome, done.added, done.parsed) == (told.outcome, told.added, told.parsed)
    blocks = store.read("blocks")
    assert blocks.count() == 2
    whole = run.aggregate(run.analyse(spark, params), params).blocks
    assert {r.block_id for r in blocks.collect()} == {r.block_id for r in whole.collect()}

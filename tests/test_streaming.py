"""Online segmentation: lines out of order, gaps that are given up, late and repeated lines, silent sessions."""

import random
from pathlib import Path

import pandas as pd

from threadloom.operators.scan import Order
from threadloom.operators.segment import segment_a
from threadloom.plans import catalog
from threadloom.session import scratch_root
from threadloom.streaming import online


class State:
    """Stands in for a session's state between micro-batches."""

    def __init__(self):
        self.held, self.hasTimedOut, self.waits = None, False, []

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, new):
        self.held = new

    def setTimeoutDuration(self, wait):
        self.waits.append(wait)


def send(state, seqs, kinds="QAQTMQAPQQ", first=0, wait=None, most=100, timed_out=False):
    state.hasTimedOut = timed_out
    rows = pd.DataFrame({"seq": seqs, "kind": [kinds[s % len(kinds)] for s in seqs], "parent": ["ab"[s % 2] if s % 3 else "" for s in seqs]})
    found = list(online._advance(("s",), iter([rows] if len(seqs) else []), state, first, wait, most))
    return [r for df in found for r in df.to_dict("records")]


def plain(n):
    return send(State(), list(range(n)))


def test_any_order_gives_the_units_of_file_order():
    rnd = random.Random(2)
    for _ in range(40):
        order, state, got = list(range(60)), State(), []
        rnd.shuffle(order)
        while order:
            take = rnd.randint(1, 9)
            got += send(state, order[:take])
            order = order[take:]
        assert got == plain(60)


def test_a_gap_is_given_up_by_time_or_number_and_late_lines_are_told():
    state = State()
    assert [r["seq"] for r in send(state, [0, 1, 5, 6], wait=50)] == [0, 1] and state.waits == [50]
    assert [r["seq"] for r in send(state, [], wait=50, timed_out=True)] == [5, 6]
    late = send(state, [3, 6, 7], wait=50)
    assert [(r["seq"], r["late"]) for r in late] == [(3, True), (6, True), (7, False)] and pd.isna(late[0]["pair"])
    full = State()
    assert send(full, [1, 2, 3], most=3) == [] and [r["seq"] for r in send(full, [9], most=3)] == [1, 2, 3, 9]
    assert [r["late"] for r in send(full, [0, 2], most=3)] == [True, True]


def test_repeated_lines_count_once_and_a_woken_session_goes_on():
    state = State()
    got = send(state, [0, 1, 1, 3, 3])
    assert [(r["seq"], r["late"]) for r in got] == [(1, True), (3, True), (0, False), (1, False)]
    rest = send(state, [2], timed_out=False) + send(state, [], timed_out=True) + send(state, list(range(4, 60)))
    assert [r for r in got + rest if not r["late"]] == plain(60)


def test_without_numbers_nothing_waits():
    state = State()
    assert [r["seq"] for r in send(state, [7, 3], first=None)] == [3, 7]
    assert [(r["seq"], r["late"]) for r in send(state, [5, 20], first=None)] == [(5, True), (20, False)]


def test_a_stream_out_of_order_equals_the_batch(spark, tmp_path):
    rows = [(f"s{i % 3}", i // 3, "QAQTMQAPQQ"[i * 7 % 10], "ab"[i * 3 % 2] if i % 3 else None) for i in range(150)]
    cols = "session string, seq bigint, kind string, parent string"
    for part in (2, 0, 1):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[:4], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (online.segment_stream(src, first=0, wait=60_000).writeStream.format("memory").queryName("disordered")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.table("disordered")
    names = ["session", "seq", "pair", "opener", "answered"]
    want = segment_a(spark.createDataFrame(rows, cols).fillna("", ["parent"]), Order(("session",), ("seq",))).select(*names)
    assert sorted(got.where("NOT late").select(*names).collect()) == sorted(want.collect())
    assert got.where("late").count() == 4


def test_micro_batches_do_not_grow_with_the_files_of_a_slice(spark, tmp_path):
    kinds = ["click", "view", "purchase", "error", "signup"]
    rows = [(i, i * 7 % 400, i % 40, kinds[i * i % 5], float(i), f'{{"k": {i % 11}}}') for i in range(400)]
    cols = "event_id bigint, ts bigint, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "events.parquet"))
    folder = Path(scratch_root(spark)) / "threadloom"
    before = set(folder.glob("stream-*"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no files are merged
    try:
        got = catalog.QUERIES["stream_segment"](spark, str(tmp_path)).collect()
        want = catalog.QUERIES["pairs_segment_a"](spark, str(tmp_path)).select("session", "event_id", "pair", "opener").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    (base,) = set(folder.glob("stream-*")) - before
    assert len(list((base / "in").glob("*.parquet"))) > 4
    assert len([p for p in (base / "state" / "commits").iterdir() if p.name.isdigit()]) == 4
    assert sorted(got) == sorted(want) and len(got) == 400

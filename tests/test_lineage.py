"""Ancestors of subagent sessions: deep chains, cycles, missing parents, files that share a thread id."""

import random

import pytest

from threadloom.operators import lineage

COLS = "file_id string, root_rank int, thread_id string, parent_thread string, lineage_id string, is_sub boolean"


def walk(rows):
    """The closure, one session and one step at a time."""
    first = {}
    for f, rank, t, up, root, sub in rows:
        if t:
            first[t] = min(first.get(t, (rank, f, up)), (rank, f, up))
    out = set()
    for f, _, t, up, root, sub in rows:
        if not sub:
            continue
        seen, step, nxt = {t} if t else set(), 0, up
        while nxt and nxt not in seen and nxt in first:
            seen.add(nxt)
            out.add((f, step, first[nxt][1], False))
            nxt, step = first[nxt][2], step + 1
        if root and root not in seen and root in first:
            out.add((f, step, first[root][1], True))
    return out


def found(spark, rows):
    return {tuple(r) for r in lineage.ancestor_closure(spark.createDataFrame(rows, COLS)).select("file_id", "step", "ancestor", "is_root").collect()}


def test_a_chain_of_200_in_few_jobs(spark):
    rows = [(f"f{i:03}", 0, f"t{i:03}", f"t{i - 1:03}" if i else "", "t000", i > 0) for i in range(201)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        assert found(spark, rows) == walk(rows)
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 60  # writes, their shuffles and broadcasts; 200 rounds before


@pytest.mark.parametrize("seed", range(4))
def test_random_forests_with_cycles_and_shared_ids(spark, seed):
    rnd = random.Random(seed)
    ids = [f"t{i}" for i in range(25)]
    rows = []
    for n in range(60):
        t = rnd.choice([*ids, "", None])
        rows.append((f"f{n}", rnd.randint(0, 2), t, rnd.choice([*ids, "gone", "", None, t]), rnd.choice([*ids, "gone", "", None]), rnd.random() < 0.8))
    assert found(spark, rows) == walk(rows)


def test_loops_and_no_sessions(spark):
    rows = [("a", 0, "A", "A", "A", True), ("b", 0, "B", "C", "D", True), ("c", 0, "C", "B", "", True), ("d", 0, "D", "", "", False), ("e", 1, "B", "B", "C", True)]
    assert found(spark, rows) == walk(rows)
    assert found(spark, rows[:0]) == set()

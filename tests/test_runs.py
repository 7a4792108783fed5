"""Whole runs over small log folders: batch, repeated, streamed, archived."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import belonging, diff
from threadloom.operators.render import template_warnings
from threadloom.operators.scan import Order
from threadloom.operators.segment import segment_a
from threadloom.params import Params, Root
from threadloom.plans import run
from threadloom.plans.incremental import NotPreserved, Store, run_cycle, survey
from threadloom.sources import archive, lines, roots
from threadloom.streaming import cycle
from threadloom.streaming.online import segment_stream

TS = "2026-05-27T10:00:{:02d}.000Z"


def ask(uuid, text, sec, **kw):
    return dict(type="user", uuid=uuid, timestamp=TS.format(sec), cwd="/w/p", message=dict(content=text), **kw)


def tell(uuid, text, sec, **kw):
    return dict(type="assistant", uuid=uuid, timestamp=TS.format(sec),
                message=dict(content=[dict(type="text", text=text)], model="m",
                             usage=dict(input_tokens=3)), **kw)


def rec(kind, sec, **payload):
    return dict(timestamp=TS.format(sec), type=kind, payload=payload)


def rollout(thread, turns, start, parent=None, answer=True):
    meta = dict(id=thread, session_id=parent or thread, cwd="/w/p/sub")
    if parent:
        meta |= dict(thread_source="subagent", parent_thread_id=parent, agent_nickname="helper")
    out = [rec("session_meta", start, **meta)]
    for t in turns:
        out += [rec("turn_context", start, turn_id=t, model="m"),
                rec("event_msg", start, type="task_started", turn_id=t),
                rec("event_msg", start, type="user_message", message=f"ask {t}")]
        if answer or t != turns[-1]:
            out.append(rec("event_msg", start, type="agent_message", message=f"done {t}"))
    return out


@pytest.fixture
def logs(write_log):
    chat = [ask("u1", "Hello", 1), tell("a1", "Hi", 2), ask("u2", "More --> %Answer%", 3), "{broken",
            ask("s1", "side", 4, isSidechain=True), tell("s2", "side done", 5, isSidechain=True)]
    write_log("a/one.jsonl", chat)
    write_log("a/fork.jsonl", [ask("u1", "Hello", 1), tell("a1", "Hi", 2), ask("u9", "Own", 9)])
    write_log("a/note.jsonl", [dict(type="other")])
    write_log("a/one/subagents/agent-1.jsonl", [ask("c1", "child", 6), tell("c2", "ok", 7)])
    write_log("a/one/subagents/deeper/x.jsonl", [ask("d1", "never read", 6)])
    write_log("b/2026/01/p.jsonl", rollout("P", ["t1", "t2"], 10, answer=False))
    write_log("b/2026/01/c.jsonl", rollout("C", ["t1", "t2", "own"], 20, parent="P"))
    return write_log("b/2026/02/else.jsonl", [rec("session_meta", 1, id="Z", session_id="Z", cwd="/w/pp"),
                                               rec("event_msg", 2, type="user_message", message="no")])


def params(root, **kw):
    return Params(project="/w/p", roots=(Root(f"{root}/a", "claude"), Root(f"{root}/b", "codex")), **kw)


def test_whole_run(spark, logs):
    p = params(logs)
    found = run.analyse(spark, p)
    timeline = run.aggregate(found, p)
    rows = timeline.blocks.orderBy("ord").collect()
    # The forked "Hello" goes with the later session; the child's copies went into the parent.
    assert [(r.source, r.session_id, r.question, r.answer) for r in rows] == [
        ("claude", "fork", "Hello", "Hi"),
        ("claude", "one", "More --> %Answer%", ""),
        ("claude", "one", "side", "side done"),
        ("claude", "one__subagents__agent-1", "child", "ok"),
        ("claude", "fork", "Own", ""),
        ("codex", "P", "ask t1", "done t1"),
        ("codex", "P", "ask t2", "done t2"),
        ("codex", "C", "ask own", "done own"),
    ]
    by = {r.question: r for r in rows}
    assert by["ask own"].session_name == "helper" and by["ask own"].is_subagent
    assert "More -- > %Answer%" in by["More --> %Answer%"].md
    assert by["Hello"].md.startswith(f"<!-- {by['Hello'].block_id} -->\n### ClaudeCode, 2026/05/27 Wed 10:00:01\n\nHello\n")
    assert "tokens in 3, out 0, cache read 0, cache write 0)" in by["Hello"].md
    m = {(r.metric, r.key): r.value for r in run.metrics(found, timeline).collect()}
    assert m["inherited_removed", ""] == 2 and m["inherited_merged", ""] == 1
    assert m["forks_removed", ""] == 1 and m["bad_lines", "claude/standard/std/one.jsonl"] == 1
    assert m["format_skipped", "claude/standard/std/note.jsonl"] == 1
    assert (m["source_units", "claude"], m["source_units", "codex"]) == (6, 3)
    assert ("units", "codex/standard/std/2026/02/else.jsonl") not in m

    # Hiding subagents changes no other block.
    q = params(logs, include_subagents_a=False, include_subagents_b=False)
    hidden = run.attribute(found.families, q)
    ids = {r.question: r.block_id for r in hidden.units.collect()}
    assert {r.source: r.hidden for r in hidden.hidden.collect()} == {"claude": 2, "codex": 1}
    assert set(ids) == {"Hello", "More --> %Answer%", "Own", "ask t1", "ask t2"}
    assert all(by[k].block_id == v for k, v in ids.items() if k != "Hello")

    # The template decides nothing about what survives.
    r = params(logs, template="%Progress% %BlockId%")
    again = run.aggregate(run.analyse(spark, r), r).blocks
    assert [b.block_id for b in again.orderBy("ord").collect()] == [x.block_id for x in rows]

    # Per session nothing is de-duplicated across sessions.
    out = f"{logs}/sessions"
    run.write_sessions(run.per_session(found, p), out)
    back = spark.read.parquet(out)
    assert back.where("session_id = 'one'").count() == 3
    assert set(os.listdir(f"{out}/source=codex")) == {"session_id=C", "session_id=P"}


def test_cycles(spark, write_log):
    write_log("a/fork.jsonl", [ask("u1", "Hello", 1), tell("a1", "Hi", 2)])
    write_log("a/one/subagents/agent-1.jsonl", [ask("c1", "child", 6), tell("c2", "ok", 7)])
    logs = write_log("b/2026/01/p.jsonl", rollout("P", ["t1", "t2"], 10))
    p, store = params(logs), Store(spark, f"{logs}/store")
    one = run_cycle(spark, p, store)
    assert (one.outcome, one.parsed, one.reused) == ("create", 3, 0)
    two = run_cycle(spark, p, store)
    assert (two.outcome, two.parsed, two.reused, two.added) == ("noop", 0, 3, 0)
    with open(f"{logs}/b/2026/01/p.jsonl", "a", encoding="utf-8") as f:
        for r in rollout("P", ["late"], 40)[1:]:
            f.write(json.dumps(r) + "\n")
    three = run_cycle(spark, p, store)
    assert (three.outcome, three.parsed, three.reused, three.added) == ("append", 1, 2, 1)
    write_log("a/fork.jsonl", [ask("u7", "Another", 8)])
    os.remove(f"{logs}/a/one/subagents/agent-1.jsonl")
    dry = run_cycle(spark, p, store, dry_run=True)
    four = run_cycle(spark, p, store)
    assert dry.outcome == four.outcome == "rewrite" and four.preserved and four.parsed == dry.parsed == 1
    now = store.latest("blocks").orderBy("ord").collect()
    cold = run.aggregate(run.analyse(spark, p), p).blocks.orderBy("ord").collect()
    assert [(r.ord, r.block_id, r.md) for r in now] == [(r.ord, r.block_id, r.md) for r in cold]
    # The snapshot that lost a block was kept.
    assert store.latest("preserved").count() == 5
    # Other parameters drop every stored result.
    assert survey(spark, params(logs, include_subagents_a=False), store).to_parse == 2


def test_damaged_copy_stops_the_rewrite(spark, write_log, monkeypatch):
    logs = write_log("a/s.jsonl", [ask("u1", "one", 1), tell("a1", "1", 2), ask("u2", "two", 3), tell("a2", "2", 4)])
    p = Params(project="/w/p", roots=(Root(f"{logs}/a", "claude"),))
    store = Store(spark, f"{logs}/store")
    run_cycle(spark, p, store)
    before = [(r.ord, r.block_id) for r in store.latest("blocks").orderBy("ord").collect()]
    write_log("a/s.jsonl", [ask("u9", "other", 9)])
    append = Store.append
    swapped = F.when(F.col("ord") == 0, 1).when(F.col("ord") == 1, 0).otherwise(F.col("ord")).cast("long")

    def damaged(self, df, name, value, by="cycle"):
        append(self, df.withColumn("ord", swapped) if name == "preserved" else df, name, value, by)

    with monkeypatch.context() as m:
        m.setattr(Store, "append", damaged)
        with pytest.raises(NotPreserved):
            run_cycle(spark, p, store)
    assert [(r.ord, r.block_id) for r in store.latest("blocks").orderBy("ord").collect()] == before
    again = run_cycle(spark, p, store)
    assert again.outcome == "rewrite" and again.preserved
    kept = store.latest("preserved").orderBy("ord").collect()
    assert [(r.ord, r.block_id) for r in kept] == before and store.latest("blocks").count() == 1


def test_archive(spark, logs):
    p = params(logs)
    files = lines.manifest(spark, list(p.roots))
    found = run.analyse(spark, p)
    target = f"{logs}/kept"
    chosen = archive.archive_files(files, found.sessions, target)
    names = {r.archive_path for r in chosen.collect()}
    assert names == {"one.jsonl", "fork.jsonl", "one/subagents/agent-1.jsonl",
                     "2026/01/p.jsonl", "2026/01/c.jsonl"}
    for fam in found.families:
        archive.write_archive(fam.lines.df, chosen, target, f"run1-{fam.source}")
    back = archive.read_archive(spark, target, "run1-claude").where("archive_path = 'one.jsonl'")
    text = "".join(r.value + "\n" for r in back.orderBy("line_no").collect())
    with open(f"{logs}/a/one.jsonl", encoding="utf-8") as f:
        assert text == f.read()


def test_same_file_once_and_keys(spark, logs):
    twice = [Root(f"{logs}/b/2026/01", "codex"), Root(f"{logs}/b", "codex", "extra")]
    rows = lines.manifest(spark, twice).collect()
    assert {(r.rel_path, r.extra_root) for r in rows} == {
        ("p.jsonl", False), ("c.jsonl", False), ("2026/02/else.jsonl", True)}
    clash = [Root("/x", "codex", "extra", "k"), Root("/y", "codex", "extra", "k")]
    with pytest.raises(ValueError):
        lines.check_root_keys(clash)


def test_nested_dirs(spark):
    rows = [("/p/-w-p-sub", "f1", ""), ("/p/-w-p-sub", "f2", "/w/p/sub"), ("/p/-w-p-backup", "f3", "/w/p-backup"),
            ("/p/-w-other", "f4", "/w/p/x")]
    df = spark.createDataFrame(rows, "dir string, file_id string, first_cwd string")
    got = [r.dir for r in belonging.nested_dirs(df, Params(project="/w/p")).collect()]
    assert got == ["/p/-w-p-sub"]


def test_streamed_segments_equal_batch(spark, tmp_path):
    rows = [(f"s{i % 5}", i, "QAQTMQAPQQ"[i * 7 % 10], "ab"[i * 3 % 2] if i % 3 else "") for i in range(200)]
    cols = "session string, seq bigint, kind string, parent string"
    for part in range(4):
        batch = spark.createDataFrame(rows[part * 50 : part * 50 + 50], cols)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (segment_stream(src).writeStream.format("memory").queryName("segments")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.table("segments").select("session", "seq", "pair", "opener", "answered").collect()
    df = spark.createDataFrame(rows, cols)
    want = segment_a(df, Order(("session",), ("seq",)))
    assert sorted(got) == sorted(want.select("session", "seq", "pair", "opener", "answered").collect())


def test_project_roots_and_indexes(spark, write_log):
    write_log("projects/-w-p/s.jsonl", [ask("u", "q", 1)])
    write_log("projects/-w-p-sub/s.jsonl", [dict(type="x"), dict(type="user", cwd="/w/p/sub")])
    write_log("projects/-w-p-backup/s.jsonl", [dict(type="user", cwd="/w/p-backup")])
    write_log("home/sessions/r.jsonl", [rec("session_meta", 1, id="P", session_id="P", cwd="/w/p")])
    base = write_log("home/session_index.jsonl", [dict(id="P", thread_name="Renamed")])
    p = Params(project="/w/p", extra_cwds=("/w/x y",))
    top = f"{base}/projects"
    assert [r.path for r in roots.project_roots(top, p)] == [f"{top}/-w-p", f"{top}/-w-x-y"]
    assert [r.path for r in roots.nested_roots(spark, top, p)] == [f"{top}/-w-p-sub"]
    home = Root(f"{base}/home/sessions", "codex")
    assert [tuple(r) for r in roots.index_names(spark, [home]).collect()] == [(home.path, "P", "Renamed")]


def test_tool_input_keeps_its_key_order(spark, write_log):
    call = dict(type="tool_use", name="Run", input=dict(z=1, command="ls", a=[2]))
    root = write_log("a/s.jsonl", [
        ask("q", "go", 1),
        dict(type="assistant", uuid="x", message=dict(content=[call])), tell("a", "done", 3)])
    write_log("b/r.jsonl", [
        rec("session_meta", 1, id="P", session_id="P", cwd="/w/p"),
        rec("event_msg", 2, type="user_message", message="go"),
        rec("response_item", 3, type="function_call", name="sh", call_id="c", arguments='{"z": 1, "a": 2}'),
        rec("response_item", 4, type="custom_tool_call", name="ap", call_id="d", input="raw text")])
    found = run.analyse(spark, params(root, template="%ProgressFull%"))
    assert {r.source: r.progress_full for r in found.units.collect()} == {
        "claude": '- [Tool: Run] {"z":1,"command":"ls","a":[2]}',
        "codex": '- [Tool: sh] {"z":1,"a":2}\n- [Tool: ap] "raw text"'}


def test_watch_runs_cycles(spark, write_log):
    logs = write_log("a/s.jsonl", [ask("u1", "Hello", 1), tell("a1", "Hi", 2)])
    p, store, seen = params(logs), Store(spark, f"{logs}/store"), []
    query = cycle.watch(spark, p, store, every="1 second", on_cycle=seen.append)
    try:
        for _ in range(90):
            if seen:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert seen and seen[0].outcome == "create" and seen[0].added == 1


def test_destructive(spark):
    cols = "block_id string"
    a, b = (f"blockid:{c * 24}" for c in "ab")
    both, one = spark.createDataFrame([(a,), (b,)], cols), spark.createDataFrame([(a,)], cols)
    assert not diff.destructive(one, both) and diff.destructive(both, one)
    assert diff.destructive(one.unionByName(one), both)
    text = spark.createDataFrame([(f"<!-- {a} -->",), ("<!-- blockid:zz -->",), ("plain",)], "value string")
    got = diff.ids_in_text(text).select("block_id", "malformed").collect()
    assert sorted((r.block_id, r.malformed) for r in got) == [("", True), (a, False)]


def test_template_warnings():
    p = Params(project="/w", template="%Progress%%ProgressFull%%What%")
    assert len(template_warnings(p)) == 3
    assert template_warnings(Params(project="/w")) == []


def test_injected_and_restored_messages(spark, write_log):
    full = "Do the thing.\nThen more.\n"
    root = write_log("a/s.jsonl", [
        ask("q", "<command-name>/do:it</command-name>", 1),
        ask("m1", "Do the", 2, isMeta=True, parentUuid="q"),
        ask("m2", "chained", 3, isMeta=True, parentUuid="m1"),
        ask("m3", "stray", 4, isMeta=True, parentUuid="zz"),
        ask("m4", " <system-reminder> noise", 5, isMeta=True, parentUuid="q"),
        dict(type="user", uuid="t", timestamp=TS.format(6), message=dict(content=[dict(type="tool_result", content="x")]),
             toolUseResult=dict(file=dict(filePath="/h/.x/commands/IT.md", content=full))),
        tell("a", "done", 7)])
    p = Params(project="/w/p", roots=(Root(f"{root}/a", "claude"),))
    unit = run.analyse(spark, p).units.collect()
    assert len(unit) == 1
    assert unit[0].question == "<command-name>/do:it</command-name>\n\nDo the thing.\nThen more.\n\nchained"
    assert unit[0].fork_keys == ["q", "m1", "m2", "a"]


def test_event_order_column_survives_cut(spark):
    df = spark.range(10).select(F.lit("s").alias("k"), F.col("id").alias("n"))
    from threadloom.operators.scan import cut_dense, running, sum_before

    cut, order = cut_dense(df, ["k"], "n", limit=3)
    rows = running(cut, order, s=sum_before(F.col("n"))).orderBy("n").collect()
    assert order.chunk and [r.s for r in rows] == [sum(range(i)) for i in range(10)]

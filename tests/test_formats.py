"""Window jobs against plain loops on random logs, with and without cutting streams into chunks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import format_a, format_b, pairs
from threadloom.params import Params, Root
from threadloom.session import stage
from threadloom.sources.lines import read_lines

from . import sequential

TS = "2026-05-27T10:00:{:02d}.000Z"


def random_a(rng, n):
    out, ids = [], [None]
    for i in range(n):
        ts, uuid = TS.format(i % 60), f"x{rng.random()}-{i}"
        parent = rng.choice(ids[-4:])
        kind = rng.choice("QQAATMMK")
        rec = dict(uuid=uuid, parentUuid=parent, timestamp=ts)
        if kind == "A":
            msg = dict(role="assistant", content=rng.choice(["", f"a{i}", "same"]))
            if rng.random() < 0.6:
                msg["usage"] = dict(input_tokens=rng.randint(0, 9))
            if rng.random() < 0.6:
                msg["model"] = rng.choice(["m1", "m2"])
            rec |= dict(type="assistant", message=msg)
        elif kind == "K":
            rec |= dict(type="attachment", attachment=dict(type="queued_command", prompt=f"k{i} "))
        elif kind == "T":
            rec |= dict(type="user", message=dict(content=[dict(type="tool_result", content="r")]))
        else:
            text = rng.choice([f"q{i}", "  <system-reminder> x", f"q{i}\n"])
            rec |= dict(type="user", message=dict(content=text))
            if kind == "M":
                rec["isMeta"] = True
        ids.append(uuid)
        out.append(rec)
    return out


def random_b(rng, n, sub):
    meta = dict(id="C", session_id="S", cwd="/w/p")
    if sub:
        meta["thread_source"] = "subagent"
    out = [("session_meta", meta)] if rng.random() < 0.9 else []
    total = dict(input_tokens=0, output_tokens=0)
    for i in range(n):
        turn = rng.choice(["t1", "t2", "t3"])
        text = rng.choice(["same", f"w{i}", "other"])
        ev = rng.choice(
            ["user", "user", "agent", "agent", "usage", "usage", "usage", "start", "turn", "done",
             "fb", "fb", "fb", "reason", "call", "out", "instr", "meta"])
        if ev == "user":
            out.append(("event_msg", dict(type="user_message", message=rng.choice([text, ""]))))
        elif ev == "agent":
            out.append(("event_msg", dict(type="agent_message", message=rng.choice([text, ""]))))
        elif ev == "usage":
            info = {}
            if rng.random() < 0.8:
                if rng.random() < 0.2:
                    total = dict(input_tokens=rng.randint(0, 5), output_tokens=0)
                else:
                    total = {k: v + rng.randint(0, 3) for k, v in total.items()}
                info["total_token_usage"] = dict(total)
            if rng.random() < 0.6:
                info["last_token_usage"] = dict(input_tokens=rng.randint(0, 9))
            out.append(("event_msg", dict(type="token_count", info=info)))
        elif ev == "start":
            out.append(("event_msg", dict(type="task_started", turn_id=rng.choice([turn, ""]))))
        elif ev == "turn":
            out.append(("turn_context", dict(
                turn_id=turn, cwd=rng.choice(["", "/w/q"]), model=rng.choice(["", "m1", "m2"]))))
        elif ev == "done":
            out.append(("event_msg", dict(type="task_complete", last_agent_message=text)))
        elif ev == "fb":
            item = dict(type="message", role="user",
                        content=[dict(type="input_text", text=rng.choice([text, "<system-x>"]))])
            if rng.random() < 0.5:
                item["id"] = rng.choice(["msg_1", "msg_2", f"msg_{i}"])
            out.append(("response_item", item))
        elif ev == "reason":
            out.append(("response_item", dict(
                type="reasoning", id=f"rs{i}", summary=[dict(text=text)] if i % 3 else [])))
        elif ev == "call":
            out.append(("response_item", dict(type="function_call", call_id=f"c{i}", name="sh",
                                              arguments=json.dumps(dict(command="ls")))))
        elif ev == "out":
            out.append(("response_item", dict(
                type="function_call_output", call_id=f"c{i}", output=text)))
        elif ev == "instr":
            out.append(("inter_agent_communication_metadata", dict(trigger_turn=True)))
            up = rng.random() < 0.5
            item = dict(type="agent_message", author="/root/x" if up else "/root",
                        recipient="/root" if up else "/root/x",
                        content=[dict(type="input_text", text=text)])
            if rng.random() < 0.5:
                item["id"] = f"amsg_{i}"
            if rng.random() < 0.5:
                item["own_turn"] = turn
                item["internal_chat_message_metadata_passthrough"] = dict(turn_id=turn)
            out.append(("response_item", item))
        elif ev == "meta":
            out.append(("session_meta", dict(id="Z", session_id=rng.choice(["S", "S2"]),
                                             cwd=rng.choice(["", "/w/z"]))))
    return [dict(timestamp=TS.format(i % 60), type=t, payload=p) for i, (t, p) in enumerate(out)]


def by_file(rows, fields):
    got = {}
    for r in sorted(rows, key=lambda r: (r.file_id, r.side, r.pair)):
        got.setdefault(r.file_id.split("/")[-1], []).append({f: r[f] for f in fields})
    return got


@pytest.fixture(params=["whole", "cut"])
def cut(request, spark):
    if request.param == "cut":
        spark.conf.set("spark.threadloom.hotBytes", "1500")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k in ("spark.threadloom.hotBytes", "spark.sql.files.maxPartitionBytes",
              "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_family_a(spark, write_log, cut):
    rng = random.Random(7)
    want = {}
    for i in range(12):
        records = random_a(rng, rng.randint(1, 40))
        root = write_log(f"s{i}.jsonl", records)
        units = sequential.units_a(records)
        if units:
            want[f"s{i}.jsonl"] = units
    params = Params(project="/w/p", roots=(Root(str(root), "claude"),))
    lines = read_lines(spark, list(params.roots))
    assert (lines.order.chunk is not None) == (cut == "cut")
    parsed = stage(format_a.parse_a(lines.df, params), "a")
    entries = format_a.entries_a(parsed, lines.order).select(*format_a.ENTRY_COLUMNS)
    rows = pairs.roll_up(entries).collect()
    fields = ["q_uuid", "question", "answer", "tok_in", "model", "progress_count", "fork_keys"]
    assert by_file(rows, fields) == want


def test_family_b(spark, write_log, cut):
    rng = random.Random(11)
    want, sessions = {}, {}
    for i in range(14):
        records = random_b(rng, rng.randint(5, 60), sub=i % 3 == 0)
        root = write_log(f"2026/05/rollout-{i}.jsonl", records)
        state = sequential.RolloutB()
        for r in records:
            state.feed(r)
        units = state.units()
        if units:
            want[f"rollout-{i}.jsonl"] = units
        sessions[f"rollout-{i}.jsonl"] = state.session or f"rollout-{i}"
    params = Params(project="/w/p", roots=(Root(str(root), "codex"),))
    lines = read_lines(spark, list(params.roots))
    ctx = format_b.context(stage(format_b.parse_b(lines.df), "b"), lines.order, params)
    entries = format_b.entries_b(ctx, lines.order, params)
    rows = pairs.roll_up(entries).collect()
    fields = ["q_uuid", "ts_raw", "question", "answer", "tok_in", "model", "cwd",
              "progress_count", "replay_key"]
    got = by_file(rows, fields)
    assert got == want
    names = format_b.sessions_b(ctx).select("file_id", "session_id").collect()
    assert {r.file_id.split("/")[-1]: r.session_id for r in names} == sessions

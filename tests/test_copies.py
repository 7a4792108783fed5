"""Dedupe, lineage, names and diff against plain loops on many small random groups at once."""

import hashlib
import random

from pyspark.sql import functions as F

from threadloom.functions.tokens import FIELDS
from threadloom.operators import dedupe, diff, ids, lineage, names
from threadloom.operators.scan import Order, cut_hot
from threadloom.session import stage


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fork_dedupe(spark):
    rng = random.Random(3)
    rows = [(i, sorted({f"g{i % 9}-{rng.randint(0, 14)}" for _ in range(rng.randint(0, 3))}))
            for i in range(180)]
    seen, want = set(), {}
    for ord_, keys in rows:
        want[ord_] = bool(keys) and any(k in seen for k in keys)
        if not want[ord_]:
            seen.update(keys)
    df = spark.createDataFrame(rows, "ord bigint, fork_keys array<string>")
    assert {r.ord: r.removed for r in dedupe.fork_dedupe(df).collect()} == want


def forks_in_turn(rows):
    """One unit after the other: it goes when a kept one before it showed one of its ids."""
    seen, out = set(), {}
    for at, keys in sorted(rows):
        out[at] = bool(seen & set(keys))
        if not out[at]:
            seen |= set(keys)
    return out


def test_fork_dedupe_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(1000)]
    rows += [(2000 + i, ["k400", f"x{i}"]) for i in range(50)] + [(5000, []), (5001, None), (5002, ["k999", "k999"])]
    tables = []
    monkeypatch.setattr(dedupe, "stage", lambda df, label: (tables.append(label), stage(df, label))[1])
    df = spark.createDataFrame(rows, "ord long, fork_keys array<string>")
    got = {r.ord: r.removed for r in dedupe.fork_dedupe(df).collect()}
    assert got == forks_in_turn([(i, k or []) for i, k in rows])
    assert tables.count("fork-chain") <= 20 and tables.count("fork-rivals") <= 3


def test_fork_dedupe_of_random_units(spark):
    rnd = random.Random(11)
    for ids in (15, 60, 300):
        rows = [(i, [f"k{rnd.randrange(ids)}" for _ in range(rnd.randrange(4))]) for i in range(200)]
        df = spark.createDataFrame(rows, "ord long, fork_keys array<string>")
        assert {r.ord: r.removed for r in dedupe.fork_dedupe(df).collect()} == forks_in_turn(rows)


def test_logical_dedupe(spark):
    rng = random.Random(5)
    streams, hashes, units = {}, {}, []
    for g in range(25):
        base = [f"g{g}e{i}" for i in range(8)]
        for f in range(rng.randint(1, 6)):
            file = f"g{g}f{f}"
            cut = base[: rng.randint(0, 8)]
            streams[file] = cut if rng.random() < 0.6 else cut + [f"x{file}"]
            hashes[file] = sha(rng.choice(["a", "b", file]) + str(g)) if rng.random() < 0.9 else ""
            for _ in range(rng.randint(1, 2)):
                units.append(dict(
                    file_id=file, source="claude", session_id=f"s{g}", ts_raw="t", question="q",
                    q_uuid=rng.choice(["", "u1", "u2", f"u{file}"]), answer=rng.choice(["", "yes"])))
    rng.shuffle(units)
    for i, u in enumerate(units):
        u["ord"] = i

    def prefix(a, b):
        return 0 < len(a) < len(b) and b[: len(a)] == a

    def same(p, q):
        a, b = streams[p["file_id"]], streams[q["file_id"]]
        return bool((p["q_uuid"] and p["q_uuid"] == q["q_uuid"]) or prefix(a, b) or prefix(b, a)
                    or (hashes[p["file_id"]] and hashes[p["file_id"]] == hashes[q["file_id"]]))

    groups, want = {}, {}
    for u in units:
        members = groups.setdefault(u["session_id"], [])
        hit = next((i for i, (m, _) in enumerate(members) if same(u, m)), None)
        if hit is None:
            want[u["ord"]] = ("possible" if members else "kept", u["ord"])
            members.append((u, u["ord"]))
            continue
        old, place = members[hit]
        if not old["answer"] and u["answer"]:
            want[u["ord"]] = (want[old["ord"]][0], place)
            want[old["ord"]] = ("removed", None)
            members[hit] = (u, place)
        else:
            want[u["ord"]] = ("removed", None)
    df = spark.createDataFrame(units).withColumnRenamed("ord", "o").withColumns(
        {"ord": F.col("o"), "mark": F.col("o")}).drop("o")
    files = spark.createDataFrame(list(hashes.items()), "file_id string, file_hash string")
    events = spark.createDataFrame(
        [(f, i, e) for f, s in streams.items() for i, e in enumerate(s)],
        "file_id string, line_no bigint, event string")
    prefixes = dedupe.stream_prefixes(events, Order(("file_id",), ("line_no",)))
    got = {r.mark: (r.verdict, None if r.verdict == "removed" else r.ord)
           for r in dedupe.logical_dedupe(df, files, prefixes.cache()).collect()}
    assert got == want


def test_prefix_hash_is_the_same_when_cut(spark):
    rows = [(f"f{i % 3}", i // 3, f"e{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "file_id string, line_no bigint, event string")
    plain = dedupe.stream_prefixes(df, Order(("file_id",), ("line_no",)))
    cut, order = cut_hot(df, ["file_id"], ["line_no"], limit=5)
    assert order.chunk and sorted(plain.collect()) == sorted(dedupe.stream_prefixes(cut, order).collect())


def subseq(a, b):
    it = iter(b)
    return all(x in it for x in a)


def reduce_lineage(sessions, units):
    """Child by child, unit by unit."""
    by_thread = {}
    for s in sessions:
        if s["thread_id"]:
            by_thread.setdefault(s["thread_id"], s)

    def ancestors(s):
        out, seen, cur = [], {s["thread_id"]}, s
        for _ in range(64):
            up = cur["parent_thread"]
            if not up or up in seen:
                break
            seen.add(up)
            if up not in by_thread:
                break
            cur = by_thread[up]
            out.append(cur)
        root = s["lineage_id"]
        if root and root not in seen and root in by_thread:
            out.append(by_thread[root])
        return out

    own = {s["file_id"]: [u for u in units if u["file_id"] == s["file_id"]] for s in sessions}
    subs = sorted((s for s in sessions if s["is_sub"]),
                  key=lambda s: (len(ancestors(s)), s["thread_id"]))
    removed, merged, conflict = set(), set(), {}

    def uid(u):
        return u["file_id"], u["pair"]

    def raise_tokens(t, u):
        up = False
        for f in FIELDS:
            if u[f] is not None and (t[f] is None or u[f] > t[f]):
                t[f], up = u[f], True
        return up

    for s in subs:
        kept = []
        for u in own[s["file_id"]]:
            old = next((o for a in ancestors(s) for o in own[a["file_id"]]
                        if u["replay_key"] and o["replay_key"] == u["replay_key"]
                        and o["replay_hash"] == u["replay_hash"]), None)
            if old is None:
                kept.append(u)
                continue
            ok = (not u["answer"] or u["answer"] == old["answer"] or not old["answer"]
                  or sha(u["answer"]) in old["answer_hashes"])
            if u["progress_count"] == 0:
                verdict = "t"
            elif old["progress_count"] == 0:
                verdict = "s"
            else:
                verdict = ("t" if subseq(u["sig"], old["sig"]) else
                           "s" if subseq(old["sig"], u["sig"]) else "d")
            if not ok or verdict == "d":
                conflict[uid(u)] = "progress" if ok else "answer"
                kept.append(u)
                continue
            removed.add(uid(u))
            gained = raise_tokens(old, u)
            if not old["answer"] and u["answer"]:
                old["answer"], gained = u["answer"], True
            if verdict == "s":
                old["sig"], old["progress_count"], gained = u["sig"], u["progress_count"], True
            if gained:
                merged.add(uid(u))
        own[s["file_id"]] = kept
    seen = {}
    for s in subs:
        kept = []
        for u in own[s["file_id"]]:
            line = s["lineage_id"] or s["parent_thread"]
            if uid(u) not in conflict or not line:
                kept.append(u)
                continue
            key = (line, u["replay_key"], u["replay_hash"], u["answer"], tuple(u["sig"]))
            if key not in seen:
                seen[key] = u
                kept.append(u)
                continue
            if raise_tokens(seen[key], u):
                merged.add(uid(u))
            removed.add(uid(u))
            del conflict[uid(u)]
        own[s["file_id"]] = kept
    final = {uid(u): (u["answer"], u["progress_count"], [u[f] for f in FIELDS])
             for us in own.values() for u in us}
    return final, removed, merged, conflict


def test_lineage(spark):
    rng = random.Random(17)
    sessions, units = [], []
    for g in range(30):
        n = rng.randint(2, 6)
        for i in range(n):
            sub = i > 0
            up = rng.choice([f"g{g}t{rng.randint(0, n)}", f"g{g}t{max(0, i - 1)}", f"g{g}t0"])
            sessions.append(dict(
                file_id=f"g{g}f{i}", root_rank=0, thread_id=f"g{g}t{i}", is_sub=sub,
                parent_thread=up if sub else "",
                lineage_id=rng.choice(["", f"g{g}t0", f"g{g}t1"]) if sub else f"g{g}t0"))
            for p in range(rng.randint(1, 4)):
                sig = [x for x in "abcd" if rng.random() < 0.5]
                answer = rng.choice(["", "x", "x", "y"])
                q = rng.randint(0, 2)
                units.append(dict(
                    file_id=f"g{g}f{i}", pair=p + 1, ordinal=p, source="codex",
                    replay_key=rng.choice([f"k{q}", f"k{q}", ""]), replay_hash=f"h{q % 2}",
                    answer=answer, sig=sig, progress_count=len(sig) + rng.randint(0, 1),
                    answer_hashes=[sha(a) for a in {answer, rng.choice(["x", "y", answer])} if a],
                    **{f: rng.choice([None, 1, 2, 3]) for f in FIELDS}))
    schema = ("file_id string, pair bigint, ordinal bigint, source string, replay_key string, "
              "replay_hash string, answer string, sig array<string>, progress_count bigint, "
              "answer_hashes array<string>, " + ", ".join(f"{f} bigint" for f in FIELDS))
    cols = [c.split()[0] for c in schema.split(", ")]
    udf = spark.createDataFrame([tuple(u[c] for c in cols) for u in units], schema)
    sdf = spark.createDataFrame(sessions)
    sigs = udf.select("file_id", "pair", F.col("sig").alias("signature")).cache()

    def signatures(wanted):
        return sigs.join(wanted.select("file_id", "pair"), ["file_id", "pair"], "left_semi")

    given = udf.select("file_id", "pair", F.explode("answer_hashes").alias("hash"))
    got = lineage.remove_inherited(udf.drop("sig", "answer_hashes"), sdf, signatures, given)
    final, removed, merged, conflict = reduce_lineage(sessions, units)
    gone = got.removed.collect()
    assert {(r.file_id, r.pair) for r in gone} == removed
    assert {(r.file_id, r.pair): r.reason for r in got.conflicts.collect()} == conflict
    assert {(r.file_id, r.pair): (r.answer, r.progress_count, [r[f] for f in FIELDS])
            for r in got.units.collect()} == final
    assert {(r.file_id, r.pair) for r in gone if r.enriched} == merged


def test_latest_names(spark):
    rng = random.Random(23)
    rows, want = [], {}
    for i in range(60):
        cur = None
        for seq in range(rng.randint(1, 7)):
            at = rng.choice([None, 1, 2, 3])
            rows.append((f"id{i}", f"n{seq}", at, seq))
            if cur is None or at is None or cur[1] is None or at >= cur[1]:
                cur = (f"n{seq}", at)
        want[f"id{i}"] = cur[0]
    df = spark.createDataFrame(rows, "id string, name string, at bigint, seq bigint")
    assert {r.id: r.name for r in names.latest_names(df).collect()} == want


def test_merge_indexes_and_titles(spark):
    schema = "id string, name string, at bigint, seq bigint"
    own = spark.createDataFrame([("a", "own", 5, 9), ("b", "own", None, 1), ("c", "own", 5, 3)], schema)
    up = spark.createDataFrame([("a", "up", 4, 1), ("b", "up", 7, 2), ("d", "up", 1, 1)], schema)
    got = {r.id: r.name for r in names.merge_indexes(own, up).collect()}
    assert got == {"a": "own", "b": "up", "c": "own", "d": "up"}
    titles = spark.createDataFrame(
        [("a", " n ", "t"), ("b", " ", "t"), ("c", None, ""), ("", "x", "y")], "id string, name string, title string")
    assert {r.id: r.name for r in names.title_names(titles).collect()} == {"a": "n", "b": "t"}


def test_read_index(spark, tmp_path):
    path = tmp_path / "session_index.jsonl"
    path.write_text('{"id":"a","thread_name":"one","updated_at":"2026-01-01T00:00:00Z"}\n{bad\n'
                    '{"id":"a","thread_name":null}\n{"id":"b"}\n{"id":"","thread_name":"x"}\n')
    rows = names.read_index(spark, str(path)).orderBy("seq").collect()
    assert [(r.id, r.name, r.seq) for r in rows] == [("a", "one", 0), ("a", "", 1)]
    assert rows[0].at == 1767225600000 and rows[1].at is None


def block(i, question="Q1", answer="A1", progress=(), tok_out=20, **kw):
    row = dict(block_id=f"blockid:{i * 24}", ord=ord(i), question=question, answer=answer,
               session_id="s", session_name="n", ts_raw="t", model="m", version="v", branch="b",
               cwd="/p", progress=list(progress), **{f: None for f in FIELDS})
    row["tok_out"] = tok_out
    return row | kw


def classes(spark, old, new):
    schema = ("block_id string, ord bigint, question string, answer string, session_id string, "
              "session_name string, ts_raw string, model string, version string, branch string, "
              "cwd string, progress array<string>, " + ", ".join(f"{f} bigint" for f in FIELDS))
    cols = [c.split()[0] for c in schema.split(", ")]
    o, n = (spark.createDataFrame([tuple(b[c] for c in cols) for b in side], schema) for side in (old, new))
    return {r.block_id[8]: r["class"] for r in diff.classify_blocks(o, n).collect()}


def test_block_classes(spark):
    old = [block("a"), block("b", answer=""), block("c", progress=["one"]), block("d", progress=["one"]),
           block("e"), block("f", question="Q2", answer="A2"), block("9", question="Q3", answer="A3"),
           block("8", answer="x"), block("7", tok_out=9)]
    new = [block("a"), block("b"), block("c", progress=["one", "two"], tok_out=99),
           block("d", progress=["other"]), block("1", question="Q2", answer="A2"),
           block("2", question="Message Type: NEW"), block("3", question="new"),
           block("8", answer="y"), block("7", tok_out=5)]
    assert classes(spark, old, new) == {
        "a": "unchanged", "b": "enriched", "c": "enriched", "d": "mutated", "e": "duplicate-removed",
        "f": "id-changed", "9": "unexplained", "2": "instruction", "3": "new-content",
        "8": "mutated", "7": "mutated"}


def test_block_ids_do_not_move_when_subagents_hide(spark):
    rows = [("claude", "s", "t", sub, f"f/{i}", i, f"q{i % 3}", ["", "u1"][i % 2])
            for i, sub in enumerate([False, True] * 6)]
    df = spark.createDataFrame(rows, "source string, session_id string, ts_raw string, "
                               "is_subagent boolean, file_id string, ordinal bigint, question string, q_uuid string")
    every = {r.ordinal: r.block_id for r in ids.block_ids(df).collect()}
    shown = {r.ordinal: r.block_id for r in ids.block_ids(df.where("not is_subagent")).collect()}
    assert all(every[k] == v for k, v in shown.items())
    spark.conf.set("spark.threadloom.hotRows", "2")
    try:
        assert {r.ordinal: r.block_id for r in ids.block_ids(df).collect()} == every
    finally:
        spark.conf.unset("spark.threadloom.hotRows")

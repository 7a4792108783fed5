"""The training-data operators on small, awkward tables, against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import fingerprint, kneser_ney, license_scan, line_dedup, mixing, ngram_join, packing, quotes, topk, warc
from threadloom.llm.common import NULL_ID, numbered
from threadloom.session import drop_staged, scratch_root

DOCS = "doc_id long, text string, source string, d string, h int, copy string"


def docs_of(spark, rows):
    """Rows (doc_id, text) with a source and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, f"s{n % 3}", "x", 7, "y") for n, (i, t) in enumerate(rows)], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c d e f g"), (5, "word " * 4000), (6, "a b c d e f g"), (7, "\n\n\n")]


def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    assert license_scan.scan(none).count() == 0
    assert ngram_join.join(none).count() == 0
    assert packing.pack(none).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert fingerprint.edited(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert kneser_ney.score(none, labels).count() == 0


def test_awkward_rows_keep_their_rows(spark):
    docs = docs_of(spark, AWKWARD)
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1), (99, 0)], "doc_id long, toxic int")
    assert license_scan.scan(docs).count() == len(AWKWARD)
    assert ngram_join.join(docs).count() == len(AWKWARD)
    assert line_dedup.dedup(docs).count() == len(AWKWARD)
    scores = kneser_ney.score(docs, labels).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scores)
    assert fingerprint.edited(docs).count() == len(AWKWARD)
    assert mixing.mix(docs, whole=True).filter("epoch = 0").count() == len(AWKWARD)


def test_license_places_and_templates(spark):
    rows = [(1, "x MIT-License y\nReleased under the mit license. cc by"), (2, "all rights of mine are reserved"), (3, "smit license"),
            (4, "GNU  General/Public license" + " w" * 200)]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert (got[1]["n_words"], got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (11, 3, 1, 9)
    assert got[1]["base_labels"] == "cc-by,mit" and got[1]["labels"] == "cc-by,mit,mit-notice"
    assert got[2]["labels"] == "all-rights-reserved" and got[3]["labels"] == "" and got[3]["first_word"] is None
    assert got[4]["base_labels"] == "gpl" and got[4]["n_words"] == 204


def test_license_notices_wrapped_over_lines(spark):
    rows = []
    for n, (notice, _) in enumerate(license_scan.TEMPLATES):
        words = ["zz"] * (n * 7) + notice.split() + ["yy"] * 50
        rows += [(n * 100 + w, "\n".join(" ".join(words[i : i + w]) for i in range(0, len(words), w))) for w in (1, 2, 5, 7, 10)]
    rows.append((5000, "Redistribution and use in source and binary forms, with or without\n * modification, are permitted"))
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    for i, _ in rows[:-1]:
        assert license_scan.TEMPLATES[i // 100][1] in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert got[5000]["labels"] == "bsd" and got[5000]["score"] == 1.0


def test_license_templates_of_any_length(spark):
    words = [f"t{i}" for i in range(150)]
    rows = [(n, "\n".join(["zz " * n + " ".join(words[:75]), " ".join(words[75:130])])) for n in (0, 31, 64, 100, 333)]
    rows.append((5000, " ".join(words[:119])))
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows), [(" ".join(words), "long")]).collect()}
    for i, _ in rows[:-1]:
        assert got[i]["labels"] == "long" and got[i]["score"] == pytest.approx(130 / 150)
    assert got[5000]["labels"] == ""


def test_rows_of_one_id_with_equal_short_hashes(spark):
    same = spark.range(200000).select(F.col("id").cast("string").alias("t")).groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts"))
    one, two = sorted(same.filter("size(ts) = 2").orderBy("ts").first()["ts"])
    docs = docs_of(spark, [(None, one), (None, two), (None, two), (4, "x y z")])
    got = [r for r in fingerprint.edited(docs).collect() if r["doc_id"] is None]
    assert len(got) == 3 and len({r["fingerprint"] for r in got}) == 2
    assert sorted(r["n_chars"] for r in got) == sorted([len(one), len(two), len(two)])
    license_rows = license_scan.scan(docs_of(spark, [(None, one), (None, two)])).collect()
    assert len(license_rows) == 2


def brute_components(rows, width, percent):
    def shingles(text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ") if w]
        k = min(width, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (3, 55)])
def test_ngram_join_against_brute_force(spark, width, percent):
    rnd = random.Random(5)
    rows = []
    for n in (3, 6, 7, 8, 9, 12, 20, 40, 80, 200, 700):
        base = [f"w{rnd.randrange(60)}" for _ in range(n)]
        for _ in range(12):
            text = base.copy()
            for _ in range(rnd.randrange(0, max(2, n // 25 + 2))):
                text[rnd.randrange(n)] = f"v{rnd.randrange(1000)}"
            cut = rnd.choice([0, n * 2 // 5]) if percent < 80 else 0
            rows.append((len(rows), " ".join(text[cut + rnd.randrange(2):])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs_of(spark, rows), width, percent).collect()}
    assert got == brute_components(rows, width, percent)


def test_tree_bound_loses_no_pair():
    rnd = np.random.default_rng(3)
    n = rnd.integers(40, 80, 300)
    points = np.vstack([np.bincount(rnd.integers(0, ngram_join.COORDINATES, k), minlength=ngram_join.COORDINATES) for k in n]).astype(np.int32)
    points[1::2] = points[::2]
    n[1::2] = n[::2]
    i, j = ngram_join.tree_pairs(n, points, np.arange(300), 85)
    found = {tuple(sorted(p)) for p in zip(i, j, strict=True)}
    for a in range(300):
        for b in range(a + 1, 300):
            fits = np.minimum(points[a], points[b]).sum() >= ngram_join.needed(n[a], n[b], 85) and 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b])
            assert fits == ((a, b) in found)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["The", "ab.", "é,", "x%%", "q" * 9]) for _ in range(rnd.choice([1, 50, 900, 3000])))) for i in range(60)] + AWKWARD
    got = packing.pack(docs_of(spark, rows), with_ids=True).collect()
    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[(i, n, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_packing_keeps_the_words_that_come_again(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    monkeypatch.setattr(packing, "CACHE_WORDS", 200)
    encode, rnd = packing.Encoder(packing.tokenizer_path()), random.Random(2)
    signs = [*"ab cdößéÉÀÿñıİK\n\t.,:%*'|<>0 9", "'s", "e\u0301", "<|endoftext|>", "<|ENDOFTEXT|>", "日", "Σ", "\x00"]
    for k in range(30):
        texts = ["common wörds, again***", "", *("".join(rnd.choices(signs, k=rnd.choice([1, 9, 80]))) for _ in range(20))]
        ids, ends = encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, ends)[:-1]]
        assert got == [[*whole.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert len(encode.known) < 200 + 600
    assert "common" in encode.known.to_pylist()


def test_workers_keep_no_vocabulary_between_tasks(spark):
    def loaded(batches):
        import sys

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["_packing_cache" in sys.modules])], ["kept"])

    packing.pieces(docs_of(spark, [(i, f"a{i} b") for i in range(50)]).repartition(8), packing.tokenizer_path()).collect()
    assert not any(r["kept"] for r in spark.range(8, numPartitions=8).mapInArrow(loaded, "kept boolean").collect())


def test_toxicity_slices_of_long_texts_hold_few_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * (6 << 20), "y" * (6 << 20), "z"])], ["text"])
    assert [b.num_rows for b in kneser_ney._slices([batch])] == [2, 2]


def test_packing_solver_is_close_to_the_bound():
    rnd = random.Random(2)
    for _ in range(20):
        counts = Counter(rnd.randrange(1, 2049) for _ in range(400))
        plan = packing.solve(counts)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 2048
            for x in pattern:
                used[x] += times
        assert used == counts
        bound = max(-(-sum(k * v for k, v in counts.items()) // 2048), sum(v for k, v in counts.items() if k > 1024))
        assert sum(t for _, t in plan) <= bound * 1.06  # the bound may lie below the best packing


def prose(rnd, n):
    """About n words in sentences of three to fifteen."""
    out = []
    while len(out) < n:
        out += [f"w{rnd.randrange(10**6)}" for _ in range(rnd.randint(3, 15))]
        out[-1] += rnd.choice(".,;!")
    return out


def planted(rnd):
    """Rows, and per later row the words of its own that must stay."""
    rows, own = [], {}
    for i in range(0, 200, 2):
        passage, left, right = prose(rnd, rnd.randint(60, 150)), prose(rnd, 8)[:7], prose(rnd, 9)[1:]
        breaks = " " if i % 4 else "\n"
        rows.append((i, " ".join(prose(rnd, 6) + passage + prose(rnd, 6))))
        rows.append((i + 1, " ".join(left) + breaks + " ".join(passage) + breaks + " ".join(right)))
        own[i + 1] = left + right
    return rows, own


def brute_matches(rows):
    """(row, start, end) of each repeated chunk, grown within whole texts, by dictionaries."""
    own = {n: line_dedup.chunks(t) if t else [] for n, (_, t) in enumerate(rows)}
    order = sorted(own, key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, n))
    first, out = {}, []
    for n in order:
        for no, (at, end, _) in enumerate(own[n]):
            body = rows[n][1][at:end].rstrip()
            if end - at < line_dedup.CHUNK_CHARS:
                continue
            m, k = first.setdefault(body, (n, no))
            if (m, k) == (n, no):
                continue
            stop = at + len(rows[n][1][at:end].rstrip())
            if m == n:
                out.append((n, at, stop))
                continue
            low, high = own[n][max(0, no - line_dedup.REACH)][0], own[n][min(len(own[n]) - 1, no + line_dedup.REACH)][1]
            low0, high0 = own[m][max(0, k - line_dedup.REACH)][0], own[m][min(len(own[m]) - 1, k + line_dedup.REACH)][1]
            grown = line_dedup.same_end(rows[n][1][low:at], rows[m][1][low0 : own[m][k][0]])
            after = line_dedup.same_start(rows[n][1][end:high], rows[m][1][own[m][k][1] : high0])
            out.append((n, at - grown, end + after if after else stop))
    return out


def test_line_dedup_equals_dictionaries_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 2)
    rnd = random.Random(4)
    rows, _ = planted(rnd)
    common = " ".join(prose(rnd, 80))
    rows += [(300 + i, f"{' '.join(prose(rnd, 5))}\n{common}\n{' '.join(prose(rnd, 5))}") for i in range(12)]
    rows += [(400, rows[0][1]), (None, rows[2][1]), (None, rows[2][1]), (401, None), (402, ""), (403, " \n\n "), (404, "}\n}\n" * 50), (405, f"{common}\n{common}")]
    spans = {}
    for n, at, end in brute_matches(rows):
        spans.setdefault(n, []).append((at, end))
    want = Counter((i, line_dedup.cut(t, spans[n])[0] if n in spans else t) for n, (i, t) in enumerate(rows))
    found = line_dedup.dedup(docs_of(spark, rows).coalesce(1)).collect()
    assert Counter((r["doc"]["doc_id"], r["clean"]) for r in found) == want
    assert all((r["clean"] == r["text"]) == (r["n_removed"] == 0) for r in found)


def test_line_dedup_finds_passages_and_keeps_the_rest(spark):
    rnd = random.Random(14)
    rows, own = planted(rnd)
    rows += [(500 + i, "\n".join(["def f():", "    return 1", "}", "}", " ".join(prose(rnd, 40))])) for i in range(5)]
    got = {r["d"]: r["clean"] for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert all(got[i] == t for i, t in rows if i not in own)  # first places, and repeated short lines, stay
    gone = [i for i in own if got[i].split() == own[i]]
    assert len(gone) >= 0.9 * len(own)
    for i, t in rows:
        if i in own and i not in gone:
            assert not Counter(own[i]) - Counter(got[i].split())


def test_line_dedup_deletes_what_it_no_longer_reads(spark, tmp_path):
    folder = Path(scratch_root(spark)) / "threadloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    long = " ".join(f"word{i}, it says." for i in range(60))
    rows = [(1, f"a b\n{long}\nc"), (2, f"x\n{long}\ny")]
    got = {r["d"]: r["clean"] for r in line_dedup.dedup(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "x\ny"}
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["gone", "numbered"]
    spark.range(1).write.parquet(str(tmp_path / "given"))
    with pytest.raises(ValueError, match="no staged table"):
        drop_staged(spark.read.parquet(str(tmp_path / "given")))
    assert (tmp_path / "given").exists()


def test_rows_of_parquet_files_are_numbered_without_a_copy(spark, tmp_path):
    rows, _ = planted(random.Random(8))
    rows += [(None, rows[0][1]), (3, None), (3, rows[2][1]), (3, rows[2][1])]
    docs = docs_of(spark, rows)
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    folder = Path(scratch_root(spark)) / "threadloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    got = Counter((r["d"], r["clean"]) for r in line_dedup.dedup(files).collect())
    assert "numbered" not in {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert Counter(i for i, _ in got.elements()) == Counter(NULL_ID if i is None else i for i, _ in rows)
    assert got == Counter((r["d"], r["clean"]) for r in line_dedup.dedup(files.filter("true OR doc_id > 0").repartition(1)).collect())


def test_points_hold_any_count():
    few, many = np.arange(1000, dtype=np.uint64) << np.uint64(20), np.zeros(300, np.uint64)
    points = [ngram_join.point_of(h) for h in (few, many, few[:0])]
    assert [len(p) for p in points] == [ngram_join.COORDINATES, 4 * ngram_join.COORDINATES, ngram_join.COORDINATES]
    assert ngram_join.counts_of(points).sum(1).tolist() == [1000, 300, 0] and ngram_join.counts_of(points)[1, 0] == 300
    assert ngram_join.counts_of(points[::2]).dtype == np.uint8 and ngram_join.counts_of(points[::2]).sum(1).tolist() == [1000, 0]


def test_finer_counts_part_long_sets_and_lose_no_link():
    rnd = np.random.default_rng(7)
    for na, nb, both in ((9000, 9000, 40), (9000, 8000, 7600), (1100, 5000, 900), (20000, 19000, 18600)):
        every = np.unique(rnd.integers(0, 2**63, na + nb, np.int64)).astype(np.uint64)
        a, b = every[:na], every[na - both : na - both + nb]
        bound = ngram_join.fine_bound(ngram_join.fine_of(a), ngram_join.fine_of(b), na, nb)
        assert bound >= len(np.intersect1d(a, b))
        points = ngram_join.counts_of([ngram_join.point_of(a), ngram_join.point_of(b)]).astype(int)
        need = ngram_join.needed(na, nb, 80)
        if both == 40:  # unrelated: the point's groups do not tell, the finer ones do
            assert bound < need <= points.min(0).sum()
    heavy = np.full(3000, 1 << 20, np.uint64)
    assert ngram_join.fine_of(heavy[:1024]) is None and ngram_join.fine_bound(*[ngram_join.fine_of(heavy)] * 2, 3000, 3000) == 3000


def test_long_near_copies_link(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(6):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(3000 + 900 * i)]
        rows += [(10 * i, " ".join(own)), (10 * i + 1, " ".join(own[:-200] + [f"v{rnd.randrange(10**6)}" for _ in range(150)])), (10 * i + 2, " ".join(own[: len(own) // 2]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs_of(spark, rows)).collect()}
    assert got == {i: i - i % 10 if i % 10 < 2 else i for i, _ in rows}


def test_near_copies_leave_no_texts_behind(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(i, " ".join(prose(rnd, 120))) for i in range(12)]
    rows += [(100 + 20 * i + k, f"{t} {' '.join(prose(rnd, k))}") for i, t in rows for k in (1, 5, 9, 13)] + [(None, rows[0][1]), (0, None)]
    docs_of(spark, rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    folder = Path(scratch_root(spark)) / "threadloom"
    before = set(folder.iterdir()) if folder.exists() else set()
    kept = corpus_pipeline.one_of_near_copies(spark, files, "").collect()
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before}
    assert not left & {"numbered", "rows", "texts", "buckets", "rated", "pivots", "members", "placed"}
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([*rows[:12], (0, None)])


def test_row_numbers_differ_and_stay(spark, tmp_path):
    spark.range(50).repartition(4).write.parquet(str(tmp_path / "n"))
    path = str(tmp_path / "n")
    one = spark.read.parquet(path)
    for docs in (one, one.join(spark.range(2).withColumnRenamed("id", "copy")), spark.read.parquet(path, path), one.union(one), spark.range(9)):
        rows = numbered(docs, [F.col("id")])
        first = [tuple(r) for r in rows.orderBy("rid").collect()]
        assert len({r[1] for r in first}) == len(first) == docs.count()
        assert [tuple(r) for r in rows.orderBy("rid").collect()] == first
        assert Counter(r[0] for r in first) == Counter(r["id"] for r in docs.collect())


def test_units_end_as_written_out():
    rnd = random.Random(3)
    plain = re.compile(r"(?:\n|[.!?,;:]+(?=\s))\s*")
    for _ in range(3000):
        text = "".join(rnd.choice("ab .,!?;:\n\t\u2003\x85") for _ in range(rnd.randrange(30)))
        at = rnd.randrange(len(text) + 1)
        assert [m.span() for m in line_dedup.UNIT_END.finditer(text, at)] == [m.span() for m in plain.finditer(text, at)]


def test_slices_of_long_texts_hold_few_bytes():
    texts = pa.array(["x" * 3_000_000, None, "y" * 3_000_000, "z" * 9_000_000] + ["short"] * 2500)
    parts = list(ngram_join._slices([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, texts], ["a", "ta", "tb"])]))
    assert pa.Table.from_batches(parts).column("ta").to_pylist() == texts.to_pylist()
    assert [p.num_rows for p in parts] == [1, 1, 1, 1, 1000, 1000, 500]
    assert list(ngram_join._slices([parts[0].slice(0, 0)])) == []


def test_line_dedup_growth_and_cut():
    assert line_dedup.same_end("x aa bb ", "y aa bb ") == 6 and line_dedup.same_end("xaa bb ", "yaa bb ") == 3
    assert line_dedup.same_start(" aa bbx", " aa bby") == 3 and line_dedup.same_start("aa", "aa") == 2 and line_dedup.same_start("ab", "a") == 0
    long = " ".join(f"p{i}" for i in range(60))
    assert line_dedup.cut(f"a b {long} c\nd", [(4, 4 + len(long))]) == ("a b c\nd", 1, 0)
    assert line_dedup.cut(f"a\n{long}\n\n{long}\nb", [(2, 2 + len(long)), (4 + len(long), 4 + 2 * len(long))]) == ("a\nb", 1, 3)
    assert line_dedup.cut("a. b. c.", [(0, 8)]) == ("a. b. c.", 0, 0)


def test_fingerprint_likeness(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(500)}" for _ in range(300))) for i in range(20)] + [(20, None), (21, "")]
    got = sorted(fingerprint.edited(docs_of(spark, rows)).collect(), key=lambda r: r["doc_id"])
    for n, r in enumerate(got):
        text, after = rows[n][1] or "", rows[(n + 1) % len(rows)][1] or ""
        take = len(text) // 4
        new = text[: len(text) - take] + after[:take]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and r["n_chars"] == len(text)
        a, b = Counter(text.split()), Counter(new.split())
        if a:
            assert abs(r["near_edited"] - sum((a & b).values()) / sum((a | b).values())) < 0.25
    assert got[20]["fingerprint"] == got[21]["fingerprint"] and got[20]["near_next"] == 1.0


def test_topk_against_brute_force(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rnd.normal(0, 0.3, 8), 1)]) for i in range(400)]
    rows += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (None, [1.0] * 8), (403, []), (404, [2.0] * 3), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = Counter(map(tuple, topk.search(table, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_topk([(i, [float(np.float32(x)) for x in v]) for i, v in rows if takes_part(i, v)])


def takes_part(i, v):
    return i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_topk(rows):
    """Each row whose id is divisible by 50 against all other rows; integers end where longs do."""
    def long(x):
        return min(max(x, -(2**63)), 2**63 - 1)

    good = [(i, [long(int(np.floor(256 * x))) if abs(x) < 1e300 else long(int(np.sign(x)) * 2**64) for x in v]) for i, v in rows]
    want = Counter()
    for at, (q, v) in enumerate(good):
        if q % 50 == 0:
            scores = ((-long(sum(a * b for a, b in zip(v, w, strict=False))), i) for n, (i, w) in enumerate(good) if n != at)
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5]))
    return want


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e9, 1e14, 1e40])
def test_topk_with_large_components(spark, scale):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) * (scale if i % 3 else 1) for x in rnd.normal(0, 1, 12)]) for i in range(120)]
    rows += [(150, rows[7][1]), (150, rows[8][1]), (50, rows[50][1])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, row string, block int")
    got = Counter(map(tuple, topk.search(table, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_topk(rows)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a\r\nb", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50000), (5, "u", "é" * 50000), (None, "n", "z")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, sha string")
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["has_request"]) for r in warc.captures(pages).collect())
    want = Counter()
    last = {1: 2, 3: 4}
    for n, (i, _, html) in enumerate(rows):
        body = (html or "").encode()
        to = last.get(i) or (5 if n == 5 else None)
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if to else "response", to, True)] += 1
    assert got == want


def test_mixing_weights_and_streams(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 10 else "small") for i in range(500)] + [(1000, "", None), (1001, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, target=0.9, limit=3.0).collect()
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    weights = {r["source"]: r["weight"] for r in got}
    share = {s: n for s, n in Counter({s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in weights}).items()}
    total = sum(tokens.values())
    for s, w in weights.items():
        assert abs(share[s] - w * total) <= 8 and w * total / tokens[s] <= 3.0 + 1e-6
        own = sorted((r["start"], r["n_tokens"]) for r in got if r["source"] == s)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    whole = mixing.mix(docs, limit=1.5, whole=True).collect()
    assert {r["doc_id"] for r in whole} == {i for i, _, _ in rows}


def test_quotes_link_and_order(spark):
    rows = [(1, 0, "u", "First point.\nSecond line."), (1, 1, "a", "Other start"), (1, 2, "b", "> second LINE.\nI agree"),
            (1, 3, "c", "> > Second line.\n> I agree\nme too"), (1, 4, "d", "> Other  start\nyes"), (2, 0, "u", "> First point.\nfrom elsewhere"),
            (2, None, "u", None), (None, 0, "u", "> me too"), (1, 0, "u", "First point.\nSecond line.")]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    one = {r["turn"]: r for r in got if r["conv_id"] == 1 and r["copy"] == 0}
    assert (one[2]["parent_turn"], one[3]["parent_turn"], one[4]["parent_turn"]) == (0, 2, 1)
    assert one[3]["own"] == "me too" and one[3]["depth"] == 2 and one[3]["root_turn"] == 0 and one[3]["n_linked"] == 2
    assert one[0]["position"] < one[2]["position"] < one[3]["position"] and one[1]["position"] < one[4]["position"]
    far = next(r for r in got if r["conv_id"] == 2 and r["turn"] == 0)
    assert (far["source_conv"], far["source_turn"], far["parent_turn"]) == (1, 0, None)
    lost = next(r for r in got if r["conv_id"] is None)
    assert (lost["n_quotes"], lost["n_linked"], lost["source_turn"], lost["parent_turn"]) == (1, 1, 3, None)
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string, key string, at int")).count() == 0


def test_quotes_of_parts_link(spark):
    rows = [(1, 0, "u", "Line one.\nLine two.\nLine three."), (1, 1, "a", "> Line one.\n> line TWO.\nyes"),
            (1, 2, "u", "First par.\n\nSecond par.\n\nThird par."), (1, 3, "a", "> First par.\n>\n> Second par.\nok"),
            (1, 4, "a", "> Line three.\nfrag a\nfrag b\n> Third par.\nfrag c"), (1, 5, "u", "> frag a\n> frag b\nsure"),
            (2, 0, "u", "> Said later.\nhm"), (2, 1, "a", "Said later."), (3, 0, "u", "Said later."),
            (4, 0, "u", "a\nlonger line here"), (4, 1, "a", "a"), (4, 2, "u", "> a\n> longer line here\n> foreign\nfine")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["parent_turn"] for k, r in got.items() if r["parent_turn"] is not None} == {
        (1, 1): 0, (1, 3): 2, (1, 4): 2, (1, 5): 4, (4, 2): 0}
    assert (got[1, 4]["n_quotes"], got[1, 4]["n_linked"]) == (2, 2) and got[1, 1]["n_linked"] == 1
    assert (got[2, 0]["source_conv"], got[2, 0]["source_turn"]) == (3, 0)


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(9)
    plain, rude = [f"w{rnd.choice('abcdef')}{i}" for i in range(200)], ["zorkish", "quaggy", "vexling"]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(rude)
            words[rnd.randrange(40)] = rnd.choice(rude)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = kneser_ney.score(docs_of(spark, rows), table, F.col("doc_id") % 3 != 1).collect()
    held = [(r["score"], r["doc_id"] % 4 == 0) for r in got if r["doc_id"] % 3 == 1]
    right = sum((s >= 0.7) == t for s, t in held)
    assert right >= 0.95 * len(held)


def test_whole_word_models_by_hand(spark):
    rows = [(1, "bad bad x"), (2, "bad y"), (3, "bad x"), (4, "x y"), (5, "x"), (6, "x z"), (7, "bad q"), (None, None)]
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(1, 7)], "doc_id long, toxic int")
    learning = labels.selectExpr("doc_id AS d", "toxic", "false AS calibrate")
    words = kneser_ney.vocabulary(docs_of(spark, rows), learning)
    got = {r["w"]: r for r in kneser_ney.words_apart(words).collect()}
    held = {w: [{i for i, t in rows if w in (t or "").split() and (i or 9) in ids} for ids in (range(10), (1, 2, 3), (4, 5, 6))] for w in "bad x y z q".split()}
    assert {w: (r["texts"], r["toxic_texts"], r["plain_texts"]) for w, r in got.items()} == {w: tuple(map(len, h)) for w, h in held.items()}
    assert got["bad"]["n"] == 5 and got["bad"]["toxic"] == 4

    def p(w, c):
        own, every = {v: len(h[c]) for v, h in held.items()}, sum(len(h[0]) for h in held.values())
        left = sum(min(kneser_ney.WORD_DISCOUNT, n) for n in own.values())
        return (max(own[w] - kneser_ney.WORD_DISCOUNT, 0) + left * len(held[w][0]) / every) / sum(own.values())

    assert all(abs(got[w]["apart"] - np.log(p(w, 1) / p(w, 2))) < 1e-12 for w in held)
    hot = np.array(sorted(kneser_ney.hashes(pa.array(["bad"]))))
    batch = pa.RecordBatch.from_pydict({"d": [1, 2], "h": [3, 4], "text": ["bad x bad", None]})
    near = next(kneser_ney._near(hot, np.array([-1.0]), np.array([-2.0]), np.array([0.5]))([batch])).to_pydict()
    r = np.exp(0.5 * kneser_ney.SHARPNESS)
    assert near["words"] == [3, 0] and near["t"] == [-2, 0] and np.allclose(near["r"], [2 * r, 0]) and np.allclose(near["rr"], [2 * r * r, 0])


def test_two_rude_words_in_long_texts_are_found(spark):
    rnd = random.Random(5)
    plain, rude = [f"w{i}" for i in range(3000)], [f"rude{c}" for c in "abcdef"]
    rows = []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.randrange(100, 400))]
        if i % 4 == 0:
            words[7], words[-7] = rnd.choice(rude), rnd.choice(rude)
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = kneser_ney.score(docs_of(spark, rows), labels, F.col("doc_id") % 3 != 1).collect()
    held = [(r["score"] >= 0.7, r["doc_id"] % 4 == 0) for r in got if r["doc_id"] % 3 == 1]
    assert sum(s for s, t in held if t) >= 0.9 * sum(t for _, t in held) and sum(s for s, t in held if not t) <= 3


def test_one_of_near_copies_with_null_and_repeated_ids(spark):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, words("a", 80) + x) for x in ("", " x", " y", " y")] + [(7, words("b", 80) + x) for x in ("", " x", " y")]
    rows += [(9, words("c", 80)), (None, words("c", 80) + " x"), (3, words("c", 80) + " y")] + [(5, ""), (5, ""), (None, None), (None, " ")]
    got = corpus_pipeline.one_of_near_copies(spark, docs_of(spark, rows), "").collect()
    kept = Counter((r["doc_id"], (r["text"] or " ").split(" ")[0]) for r in got)
    assert kept == {(None, "a0"): 1, (7, "b0"): 1, (3, "c0"): 1, (5, ""): 2, (None, ""): 2}
    assert set(got[0].asDict()) == {"doc_id", "text", "source", "d", "h", "copy"}

"""Cross-tokenizer alignment, page text and Merkle proofs against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.llm import crosstok, html_text, merkle

DOCS = "doc_id long, text string, source string, lang string, n_chars long, t long, pos long, pair string, rid int, d string, part int"


def docs_of(spark, rows):
    """Rows (doc_id, source, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, None if i == 3 else "en", None if t is None else len(t), 5, 6, "x", 7, "y", 8) for i, s, t in rows], DOCS)


TEXTS = [
    None, "", " ", "Hello  world\n\nfoo\tbar", "  lead and trail  ", "é ﬁ ▁ lost", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00a　b", "word " * 3000,
    "naïve café über Straße", "x" * 5000, "日本語のテキスト 😀😀", "same text", "same text", "don't can't I'll\r\n  - item", " leading\xa0space",
]


def side_tokens():
    return crosstok.load(*crosstok.tokenizer_paths())[:2]


def brute_alignment(texts):
    a, b = side_tokens()
    found, counts = [], Counter()
    for text in texts:
        ends = []
        for side in (a, b):
            at, own = 0, []
            for i in side.ids([text or ""])[0].tolist() if text else []:
                at += len(side.tokens[i])
                own.append((at, i))
            joined = b"".join(side.tokens[i] for _, i in own)
            ends.append(own if text and joined == b" " + text.encode() else None)
        if None in ends:
            found.append((0, 0, [], ""))
            continue
        cuts = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        by_a, by_b = dict(ends[0]), dict(ends[1])  # tokens are never empty, so an end has one token
        links = [(by_a[c], by_b[c]) for c in cuts]
        groups = ";".join(
            "|".join(",".join(str(i) for e, i in own if low < e <= high) for own in ends) for low, high in zip([0, *cuts], cuts, strict=False)
        ) if len(cuts) < 500 else None
        counts.update(links)
        found.append((len(ends[0]), len(ends[1]), links, groups))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for n_a, n_b, links, groups in found:
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((n_a, n_b, len(links), best, sum(counts[p] for p in links), groups))
    return out


@pytest.mark.parametrize("frequent", [crosstok.FREQUENT, 7])
def test_alignment_equals_plain_comparison_of_ends(spark, frequent):
    docs = docs_of(spark, [(None if n % 5 == 4 else n, "s", t) for n, t in enumerate(TEXTS)])
    got = Counter(tuple(r) for r in crosstok.link(docs, frequent=frequent).collect())
    rows, expected = sum(got.values()), brute_alignment(TEXTS)
    assert rows == len(TEXTS)
    for n, (n_a, n_b, links, best, total, groups) in enumerate(expected):
        ident = None if n % 5 == 4 else n
        match = [r for r in got if r[0] == ident and r[1:3] == (n_a, n_b) and r[4:7] == (links, best, total)]
        assert match, (n, TEXTS[n], got)
        if groups is not None:
            digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
            assert any(r[7] == digest and r[3] == links for r in match)


def test_memo_and_long_windows_give_the_same(spark):
    a, b = side_tokens()
    memo = crosstok.Memo(a, b)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "the", "ing", " of", "😀", "-"]) for _ in range(rng.randint(1, 60)))
        ids = a.ids([text])[0], b.ids([text])[0]
        once, again = memo.document(text, *ids), crosstok.Memo(a, b).document(text, *ids)
        assert once[:5] == again[:5]
        whole, pairs = crosstok.align(ids[0].tolist(), ids[1].tolist(), a.lengths.tolist(), b.lengths.tolist(), memo.names)
        assert once[4] == hashlib.sha256(whole.encode()).hexdigest() and once[3] == len(pairs)


def test_words_apart_give_what_whole_texts_give():
    a, b = side_tokens()
    assert a.apart and b.apart
    rng = random.Random(8)
    parts = ["ab", " ", " ", "  ", "\n", "\t", "é", "the", " of", "😀", "-", "▁", "\u3000", "\xa0", "\x1c", "\x85", "'s", "<unk>", "日本語", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)] + [t or "" for t in TEXTS]
    memo, whole = crosstok.Memo(a, b), crosstok.Memo(a, b)
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        for text, x, y, got in zip(some, a.ids(some), b.ids(some), memo.documents(some), strict=True):
            want = whole.document(text, x, y) if text else None
            assert (got is None) == (want is None), text
            assert got is None or got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all(), text
    assert all(len(w) <= crosstok.MEMO_CHARS for w in memo.words)


def test_words_seen_before_are_not_encoded_again(monkeypatch):
    a, b = side_tokens()
    sent = []

    def counting(side):
        def encode(texts):
            texts = list(texts)
            sent.extend(texts)
            return side.encode(texts)
        return crosstok.Side(encode, side.tokens, side.lossless, side.apart)

    memo = crosstok.Memo(counting(a), counting(b))
    words = [f"w{i}" for i in range(300)]
    first = memo.documents([" ".join(words), ""])
    assert sorted(" ".join(sent).split()) == sorted(words * 2)  # once by each tokenizer
    sent.clear()
    again = memo.documents([" ".join(words), " ".join(reversed(words))])
    assert not sent and again[0][:5] == first[0][:5]
    monkeypatch.setattr(crosstok, "MEMO_WINDOWS", 10)
    memo.documents(["new"])
    assert sent == ["new", "new"] and len(memo.words) == 1
    memo.documents(["w5 new w7"])
    assert sent == ["new", "new"] and set(memo.words) == {"new", "w5", "w7"}  # from those before


def test_every_text_is_encoded_by_both_also_when_its_words_were_seen(monkeypatch):
    paths, sent = crosstok.tokenizer_paths(), {}

    def counting(name, side):
        def encode(texts):
            texts = list(texts)
            sent.setdefault(name, []).extend(texts)
            return side.encode(texts)
        return crosstok.Side(encode, side.tokens, side.lossless, side.apart)

    a, b, aligner = crosstok.load(*paths)
    sides = counting("a", a), counting("b", b)
    monkeypatch.setattr(crosstok, "load", lambda *_: (*sides, type(aligner)(*sides)))
    texts = ["one two three", "three two one", "", "one two three", "two two  two", None, "one"]
    rows = pd.DataFrame({"doc_id": pd.array(range(len(texts)), "Int64"), "text": texts})
    got = pd.concat(crosstok._aligned(*paths)([rows, rows]))
    whole = [t for t in texts if t] * 2
    assert sent == {"a": whole, "b": whole}
    monkeypatch.undo()
    for row, (n_a, n_b, links, _, _, groups) in zip(got.itertuples(), brute_alignment(texts) * 2, strict=True):
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups_sha256) == (n_a, n_b, links, links, digest)
        assert len(row.pairs) == len(set(row.pairs)) and sum(row.times) == links


@pytest.mark.parametrize("chars, together", [(1, 1), (8, 60), (20, 10_000)])
def test_long_texts_in_parts_give_what_whole_texts_give(monkeypatch, chars, together):
    monkeypatch.setattr(crosstok, "PART_CHARS", chars)
    monkeypatch.setattr(crosstok, "CHARS_TOGETHER", together)
    a, b, aligner = crosstok.load(*crosstok.tokenizer_paths())
    rng = random.Random(chars)
    parts = ["ab", " ", " ", " ", "  ", "\n", "\t", "é", "the", " of", "😀", "-", "\u3000", "\xa0", "\x1c", "\x85", "\u200b", "\u0301", "ﬁ", "'s", "日本語"]
    texts = ["".join(rng.choice(parts[: rng.choice([9, 21])]) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [t or "" for t in TEXTS]
    assert any(len(aligner.parts(t)) > 2 for t in texts) and all(" ".join(aligner.parts(t)) == t for t in texts)
    kept = 0
    for text, x, y, got in zip(texts, a.ids(texts), b.ids(texts), aligner.whole(texts), strict=True):
        want = aligner.document(text, x, y) if text else None
        assert (got is None) == (want is None), text
        assert got is None or got[:5] == want[:5] and (got[5] == want[5]).all() and (got[6] == want[6]).all(), text
        kept += got is not None
    assert 50 < kept < len(texts)


def test_quick_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = crosstok.tokenizer_paths()[0]
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    a = side_tokens()[0]
    assert crosstok.quick_encoder(path, a.tokens) is not None
    rng = random.Random(5)
    parts = ["'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "é", "1", "23", "a", "the", "?!", "<|endoftext|>", "😀", "日本", "\u3000", "\xa0", "\x00", "İ", "²", "Ⅷ"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    assert [x.tolist() for x in a.ids(texts)] == [slow.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_every_byte_has_its_letter():
    letters = crosstok.byte_of_letter()
    assert sorted(letters.values()) == list(range(256)) and letters["Ġ"] == 32 and letters["Ċ"] == 10


PARAGRAPHS = ["A first paragraph with enough words in it to count as text &amp; more of <b>them</b>.", "Short.", "Another &eacute;t&#233; one\n  over lines, followed by nothing that matters to the reader."]
CLEAN = "A first paragraph with enough words in it to count as text & more of them. Short. Another été one over lines, followed by nothing that matters to the reader."
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>All the news of today and yesterday that is fit to print here</a></ul>"
NOISE = "Long sentences about how we use cookies, and what else we would like to tell you about that, at length."


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>{NOISE}</footer></body></html>",
    f"<body><header>{NOISE}</header><main>{BODY}</main><aside>{NOISE}</aside>",
    f"<body><div class='site-header'>{NOISE}</div><div id=top>{MENU}</div><div id=content>{BODY}</div><div class=comments><p>{NOISE}</p></div>",
    f"<body><form action=x><div>{NOISE}</div></form><div>{MENU}</div><div class='page with-sidebar'>{BODY}</div><script>var x = '<p>{NOISE}';</script>",
    f"<body><div class=ad>{NOISE}<article>{BODY}</article>",
    f"<body><div role=dialog>{NOISE}</div><div>{BODY}<div class='ad-box'>{NOISE}</div></div><style>p {{ }}</style><!-- {NOISE} --><div id='cookieNotice'>{NOISE}",
    f"<form id=all>{MENU}<main>{BODY}</main><input><button>{NOISE}</button></form>",
    f"<article>{BODY}<section class='comment-list'><article>{NOISE}</article></section></article>",
])
def test_page_text_between_surge_and_dive(page):
    assert html_text.main_text(page) == CLEAN


def test_page_text_of_awkward_pages(spark):
    pages = {1: None, 2: "", 3: "plain text", 4: "<p", 5: "<!-- open", 6: "<a href='x>", 7: MENU, 8: "1 < 2 &lt;b&gt;", 9: "<p>x</p>" * 30000, 10: "<div>" * 5000 + "deep"}
    rows = [(i, f"u{i}", p, "clash", 4) for i, p in pages.items()] + [(None, None, "twice", None, None)] * 2
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert [text[i] for i in (1, 2, 3, 4, 5, 6, 7)] == ["", "", "plain text", "", "", "", ""]
    assert text[8] == "1 < 2 <b>" and text[9] == " ".join("x" * 30000) and text[10] == "deep"
    assert all(r.n_chars == len(r.text) for r in got) and [r.url for r in got if r.page_id is None] == [None, None]


def brute_tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + 3]).encode()).hexdigest() for i in range(0, len(nodes), 3)]
        levels.append(nodes)
    return levels


def brute_proof(levels, pos):
    out = []
    for nodes in levels[:-1]:
        run = range(pos - pos % 3, min(pos - pos % 3 + 3, len(nodes)))
        out.append([(nodes[i], i == pos) for i in run])
        pos //= 3
    return out


def brute_leaf(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf([r[f] for f in merkle.FIELDS]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = brute_tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for pos, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = brute_proof(trees[s], pos) + brute_proof(top, at)
            proof = "".join(d for run in steps for d, own in run if not own)
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
            node = brute_leaf([text if f == "text" else r[f] for f in merkle.FIELDS])
            for run in steps:
                node = hashlib.sha256("".join(node if own else d for d, own in run).encode()).hexdigest()
            out.append((r["doc_id"], leaf, trees[s][-1][0], top[-1][0], hashlib.sha256(proof.encode()).hexdigest(), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("part", [7, 20_000])
def test_proofs_equal_a_tree_in_memory(spark, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART", part)
    rng = random.Random(part)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "é", "z", "hot", "hot", "hot"]), rng.choice([None, "", "a\nb", "\n", "long " * 500])) for _ in range(120)]
    rows += [(n, f"s{n}", "x") for n in range(20)] + [(n, "big", f"line {n}\n") for n in range(800)]
    docs = docs_of(spark, rows)
    expected = Counter(brute_manifest([r.asDict() for r in docs.select(*merkle.FIELDS).collect()]))
    found = merkle.prove(docs, merkle.without_line_ends(docs), with_proof=True).collect()
    assert Counter(tuple(r)[:7] for r in found) == expected
    assert all(hashlib.sha256("".join(r.proof).encode()).hexdigest() == r.proof_sha256 for r in found)
    assert {r.verified for r in found} == {True, False}


def test_one_leaf_and_no_leaf(spark):
    (one,) = merkle.prove(docs_of(spark, [(1, None, "a")])).collect()
    assert one.leaf == one.subroot == one.root and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.prove(docs_of(spark, []).limit(0)).count() == 0
    assert crosstok.link(docs_of(spark, []).limit(0)).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_what_a_run_lacks_is_least():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 9, 10, 27, 50, 100):
        sizes, m = [n], n
        while m > 1:
            m = -(-m // 3)
            sizes.append(m)
        for _ in range(20):
            first = rng.randrange(n)
            end = rng.randint(first + 1, n)
            own, need = set(range(first, end)), []
            for level, size in enumerate(sizes[:-1]):
                around = {s for p in own for s in range(p - p % 3, min(p - p % 3 + 3, size))}
                need += [(level, p) for p in sorted(around - own)]
                own = {p // 3 for p in around}
            assert sorted(merkle.lacking(first, end, n)) == sorted(need)

"""Cross-tokenizer alignment: which tokens of one tokenizer end where tokens of another end.

Every text is encoded by both tokenizers, and all its tokens are aligned, several texts together by arrays; nothing is
remembered from one text to another. Byte offsets at which tokens of both end cut a text into groups, and each such offset
links its two tokens.

If no token of either reaches over a single space between two words, what stands before and after such a space is encoded
independently. Then texts above ``PART_CHARS`` are cut at such spaces into parts, so that memory does not grow with them.

Links are counted per pair of ids over the whole corpus. Every document carries its distinct pairs, which meet
the counts in a join: pairs that hold at least 1/``FREQUENT`` of all links, at most that many, are
broadcast, the others are rare and join by shuffle.

Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and empty strings. Each row
gives a row, repeated rows and null ids too, and all rows count. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, ship
from threadloom.session import stage

ship(__name__)

#: Rows handed on together.
TEXTS = 128
#: Longer texts are cut into parts.
PART_CHARS = 1 << 16
#: Characters of texts or parts aligned together; one of them at least.
CHARS_TOGETHER = 1 << 18
#: Words that ``Memo`` remembers at a time, twice: those in use and, until looked up again, those before.
MEMO_WINDOWS = 1 << 16
#: Words that B encodes at once; its time for one grows with their number.
WORDS_TOGETHER = 32
#: Longer words are not remembered.
MEMO_CHARS = 64
#: A space between two words; ``\S`` holds nothing that is white space to a tokenizer.
BETWEEN_WORDS = re.compile(r" (?=\S)(?<=\S )")
#: Longer texts are encoded by the tokenizer's own library, which has no limit on a run of white space.
QUICK_CHARS = 200_000
# Fixed value: how byte-level BPE cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT = 1 << 19
ROWS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, times array<long>"
)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as they are and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Side:
    """One tokenizer: ids of texts and the bytes of each id.

    ``apart`` tells that what stands before and after a space between two words is encoded independently.
    """

    def __init__(self, encode, tokens: list[bytes], lossless: bool = False, apart: bool = False):
        self.encode, self.tokens, self.lossless, self.apart = encode, tokens, lossless, apart
        self.lengths = np.array([len(t) for t in tokens], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.encode(texts)]

    def gives(self, ids: np.ndarray, data: bytes) -> bool:
        """Whether the tokens' bytes are ``data``. A lossless tokenizer only splits bytes, so their number tells."""
        if self.lossless:
            return int(self.lengths[ids].sum()) == len(data)
        return b"".join(map(self.tokens.__getitem__, ids.tolist())) == data


def quick_encoder(path: str, tokens: list[bytes]):
    """The same ids by a quicker library, where the file is plain byte-level BPE whose ids follow its merges; else None."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    special = {t["id"] for t in told.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    order = [model["vocab"].get(m) for m in merged]
    base = len(model["vocab"]) - len(special & set(model["vocab"].values())) - len(merged)
    if model.get("type") != "BPE" or told.get("normalizer") or not plain or base != 256 or order != list(range(256, 256 + len(merged))):
        return None
    import tiktoken

    ranks = {t: i for i, t in enumerate(tokens) if i not in special}
    return tiktoken.Encoding("byte-level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load(path_a: str, path_b: str) -> tuple[Side, Side, Aligner]:
    """Both tokenizers and what aligns them, once per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    kept = sys.modules.setdefault("_crosstok_cache", types.ModuleType("_crosstok_cache")).__dict__
    if (path_a, path_b) not in kept:
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        letters = byte_of_letter()
        names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        whole = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        quick = quick_encoder(path_a, whole)
        b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [piece_bytes(b.id_to_piece(i)) for i in range(b.get_piece_size())]

        def encode_a(texts):
            for t in texts:
                if quick and len(t) < QUICK_CHARS:
                    yield quick(" " + t)
                else:
                    yield a.encode(" " + t, add_special_tokens=False).ids

        # WORDS never matches a space after something else, and merges only make pieces of the vocabulary
        reach = any(b" " in p.lstrip(b" ") for p in pieces)
        sides = (
            Side(encode_a, whole, quick is not None, quick is not None),
            Side(lambda texts: b.encode(texts, num_threads=1), pieces, apart=not reach),
        )
        kept[path_a, path_b] = *sides, Aligner(*sides)
    return kept[path_a, path_b]


def align(a: list[int], b: list[int], len_a: list[int], len_b: list[int], names: list[str]) -> tuple[str, list[int]]:
    """(groups as text, linked pairs as a * 2**32 + b) of a window whose two sides have the same bytes, token by token, for tests."""
    if len(a) == 1 or len(b) == 1:
        return ",".join([names[i] for i in a]) + "|" + ",".join([names[i] for i in b]), ((a[-1] << 32) + b[-1],)
    text, pairs, right, ahead, k = "", [], "", 0, 0
    for i in a:
        text += names[i]
        ahead += len_a[i]
        while ahead > 0:
            j = b[k]
            right += "," + names[j]
            ahead -= len_b[j]
            k += 1
        if ahead:
            text += ","
        else:
            text += "|" + right[1:] + ";"
            right = ""
            pairs.append((i << 32) + j)
    return text[:-1], pairs


class Aligner:
    """Alignments of texts by the ids of both tokenizers.

    An alignment is its groups as text, each with its end, the linked pairs as int64, and the numbers of tokens of both.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        most = max(len(a.tokens), len(b.tokens))
        self.names = [str(i) for i in range(most)]
        self.digits = np.array(self.names, "S").view(np.uint8).reshape(most, -1)

    def together(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> list[tuple]:
        """Alignments of texts, or parts of them, in a row that end at these bytes, where tokens of both end."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        end_a, end_b = self.a.lengths[a].cumsum(), self.b.lengths[b].cumsum()
        place = end_b.searchsorted(end_a)
        shared = end_b[place] == end_a
        last_a, last_b = shared.nonzero()[0], place[shared]
        pairs = ((a[last_a] << 32) + b[last_b]).tobytes()
        # a group is its tokens of A, then those of B
        closed = np.zeros(len(b), np.int64)
        closed[last_b] = 1
        to_a = np.arange(len(a)) + np.append(0, last_b[:-1] + 1)[shared.cumsum() - shared]
        to_b = np.arange(len(b)) + (last_a + 1)[closed.cumsum() - closed]
        row, end = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        row[to_a], row[to_b] = a, b
        end[to_a[last_a]], end[to_b[last_b]] = ord("|"), ord(";")
        written = np.column_stack([self.digits[row], end])
        text = written[written != 0].tobytes()
        n_a, n_b = end_a.searchsorted(until) + 1, end_b.searchsorted(until) + 1  # so far
        text_ends = (written != 0).sum(1).cumsum()[n_a + n_b - 1].tolist()
        pair_ends = (shared.cumsum()[n_a - 1] * 8).tolist()
        spans = zip([0, *text_ends], text_ends, [0, *pair_ends], pair_ends, strict=False)
        sizes = zip(np.diff(n_a, prepend=0).tolist(), np.diff(n_b, prepend=0).tolist(), strict=True)
        return [(text[i:j], pairs[k:m], x, y) for (i, j, k, m), (x, y) in zip(spans, sizes, strict=True)]

    def same(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both tokenizers keep the text's bytes."""
        data = b" " + text.encode()
        return self.a.gives(a, data) and self.b.gives(b, data)

    @staticmethod
    def summed(found: list[tuple]) -> tuple:
        """The counts, digest, distinct pairs and their times of a text from the alignments of its parts."""
        groups, linked, n_a, n_b = zip(*found, strict=True)
        digest = hashlib.sha256(b"".join(groups)[:-1]).hexdigest()
        links = np.frombuffer(b"".join(linked), np.int64)
        pairs, times = np.unique(links, return_counts=True)
        # A shared end closes one group and links one token of each side.
        return sum(n_a), sum(n_b), len(links), len(links), digest, pairs, times

    def document(self, text: str, a: np.ndarray, b: np.ndarray) -> tuple | None:
        """What ``summed`` gives for a text with these ids; None if bytes differ."""
        return self.summed(self.together(a, b, np.array([1 + len(text.encode())]))) if self.same(text, a, b) else None

    def parts(self, text: str) -> list[str]:
        """The text, cut at spaces between two words if it is long and such cuts change no token."""
        out, at = [], 0
        while self.a.apart and self.b.apart and len(text) - at > PART_CHARS and (cut := BETWEEN_WORDS.search(text, at + PART_CHARS)):
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def whole(self, texts: list[str]) -> list[tuple | None]:
        """What ``summed`` gives for each text, all of them encoded by both; None for empty ones and if bytes differ."""
        found: list[list | None] = [[] for _ in texts]
        runs, size = [], CHARS_TOGETHER
        for n, part in ((n, p) for n, t in enumerate(texts) if t for p in self.parts(t)):
            size += len(part)
            if size >= CHARS_TOGETHER:
                runs.append([])
                size = len(part)
            runs[-1].append((n, part))
        for run in runs:
            own, kept = [part for _, part in run], []
            for (n, part), a, b in zip(run, self.a.ids(own), self.b.ids(own), strict=True):
                if self.same(part, a, b):
                    kept.append((n, 1 + len(part.encode()), a, b))
                else:
                    found[n] = None
            if kept:
                place, sizes, a, b = zip(*kept, strict=True)
                for n, one in zip(place, self.together(np.concatenate(a), np.concatenate(b), np.cumsum(sizes)), strict=True):
                    if found[n] is not None:
                        found[n].append(one)
        return [self.summed(x) if x else None for x in found]


class Memo(Aligner):
    """The same alignments by words that are remembered, where only words not seen yet are encoded.

    Tests compare it with whole texts. No query uses it, since a query encodes every text.
    """

    def __init__(self, a: Side, b: Side):
        super().__init__(a, b)
        self.words: dict[str, tuple | None] = {}
        self.words_before: dict[str, tuple | None] = {}

    def learn_words(self, words: list[str]) -> None:
        """Remember the alignments of words; None where a tokenizer changes their bytes."""
        rows, size = [], QUICK_CHARS
        for w in words:
            if w.strip() != w:
                rows.insert(0, [w])  # the end of a text, no word beside others
                continue
            size += len(w) + 1
            if size >= QUICK_CHARS:
                rows.append([])
                size = len(w)
            rows[-1].append(w)
        for row in rows:
            text = " ".join(row)
            a = self.a.ids([text])[0]
            b = np.concatenate(self.b.ids([" ".join(row[i : i + WORDS_TOGETHER]) for i in range(0, len(row), WORDS_TOGETHER)]))
            if self.same(text, a, b):
                until = np.cumsum([1 + len(w.encode()) for w in row])
                self.words.update(zip(row, self.together(a, b, until), strict=True))
            elif len(row) == 1:
                self.words[row[0]] = None
            else:
                self.learn_words(row[: len(row) // 2])
                self.learn_words(row[len(row) // 2 :])

    def documents(self, texts: list[str]) -> list[tuple | None]:
        """What ``summed`` gives for each text; None for empty ones and if bytes differ."""
        whole = list(range(len(texts)))
        out: list[tuple | None] = [None] * len(texts)
        if self.a.apart and self.b.apart:
            words = [BETWEEN_WORDS.split(t) if t else [] for t in texts]
            if len(self.words) >= MEMO_WINDOWS:
                self.words_before, self.words = self.words, {}
            fresh = set().union(*words).difference(self.words)
            self.words.update({w: self.words_before[w] for w in fresh if w in self.words_before})
            fresh = [w for w in fresh if w not in self.words]
            self.learn_words(fresh)
            whole = []
            for n, own in enumerate(words):
                found = list(map(self.words.__getitem__, own))
                if None in found:
                    whole.append(n)
                elif found:
                    out[n] = self.summed(found)
            for w in fresh:
                if len(w) > MEMO_CHARS:
                    del self.words[w]
        whole = [n for n in whole if texts[n]]
        chosen = [texts[n] for n in whole]
        for n, text, a, b in zip(whole, chosen, self.a.ids(chosen), self.b.ids(chosen), strict=True):
            out[n] = self.document(text, a, b)
        return out


NOTHING = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))


def _aligned(path_a: str, path_b: str):
    def run(batches):
        aligner = load(path_a, path_b)[2]
        for rows in batches:
            for s in range(0, len(rows), TEXTS):
                part = rows.iloc[s : s + TEXTS]
                texts = ["" if t is None else t for t in part["text"]]
                found = [x or NOTHING for x in aligner.whole(texts)]
                out = pd.DataFrame(found, columns=[c.split()[0] for c in ROWS.split(", ")[1:]])
                out.insert(0, "doc_id", part["doc_id"].array)
                yield out.astype({"doc_id": "Int64"})

    return run


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Each row's counts, digest, and distinct linked pairs with their times."""
    if path_a is None or path_b is None:
        path_a, path_b = tokenizer_paths()
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return rows.mapInPandas(_aligned(path_a, path_b), ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair over all rows, and whether no other pair of its B id has more."""
    counts = stage(rows.selectExpr("inline(arrays_zip(pairs, times))").groupBy("pairs").agg(F.sum("times").alias("n")), "pairs")
    counts = counts.select(F.col("pairs").alias("pair"), "n", F.col("pairs").bitwiseAND((1 << 32) - 1).alias("b"))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    rows = stage(aligned(docs, path_a, path_b).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows), "counts")
    size = counts.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    least = 0 if size.pairs <= frequent else -(-size.links // frequent)  # at most `frequent` pairs reach it
    each = rows.select("rid", F.expr("inline(arrays_zip(pairs, times))").alias("pair", "times"))
    own = each.join(F.broadcast(counts.filter(F.col("n") >= least)), "pair", "left" if least else "inner")
    totals = [
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
    ]
    if least:
        rare = own.filter("n IS NULL").select("rid", "pair", "times").join(counts.filter(F.col("n") < least), "pair")
        own = own.filter("n IS NOT NULL").unionByName(rare)
    sums = own.groupBy("rid").agg(*totals)
    found = rows.drop("pairs", "times").join(sums, "rid", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")}
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero.values(), "groups_sha256")

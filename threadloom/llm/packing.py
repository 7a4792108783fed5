"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids plus an end mark; only those longer than a sequence are cut. The packing
problem depends on lengths alone, so the driver solves it on the histogram of lengths, at most
``MAX_TOKENS`` counts whatever the corpus: dominance fixes sets that some best packing holds (an item
with the largest partner that fits, if they fill the sequence, if no two others fit beside the item,
or if no pair of others is longer than the partner and no three fit), and the rest is packed best-fit
decreasing. Its answer is a list of patterns with multiplicities. Every piece then finds its sequence and offset from its
rank among the pieces of its length, counted per block of pieces, so no length gathers in one task.

Null and empty texts give the end mark alone; repeated rows are packed each; a null doc_id stays null.
Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import codecs
import os
import zlib
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, lean, ship, slices
from threadloom.session import stage

ship(__name__)

MAX_TOKENS = 2048
END = 0
CACHE_WORDS = 300_000
#: Rows, and bytes of texts, that are encoded at a time.
SLICE = 2000
SLICE_BYTES = 2 << 20
BLOCK_ROWS = 2000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, x long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# letters that stay letters when composed and lower-cased, before signs that end the word
LONE = r"([a-z0-9À-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~]+)( |\n|$)"
#: Words that are one part to the tokenizer, which it neither composes nor lower-cases any further.
LETTERS = "^[a-zß-öø-ÿ]+$"


def words(texts: pa.Array) -> pa.Array:
    """Lists of the parts of each text that the tokenizer encodes one by one.

    White space ends its words, letters and punctuation are split anyway and case does not matter, so capitals and
    signs after a word need no entries of their own. Texts that may name special tokens stay as they are.
    """
    plain = pc.replace_substring_regex(pc.ascii_lower(texts), LONE, r"\1 \2\3")
    kept = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
    return pc.split_pattern(pc.replace_substring(kept, "\n", " "), " ")


class Encoder:
    """Little-endian 32-bit ids of texts. Words are encoded once and kept, as arrays, while they come again, within a bound."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        level, self.bytes = ByteLevel(add_prefix_space=False, use_regex=False), [chr(b) for b in range(256)]
        for c in map(chr, range(0xDF, 0x100)):  # the model's letter for each byte of a letter
            for b, letter in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                self.bytes[b] = letter
        self.bytes = "".join(self.bytes)
        # the end mark comes first, with the number 0
        self.known, self.again = pa.array([], pa.string()), np.zeros(0, bool)
        self.ids, self.ends = np.array([END], "<u4"), np.array([1])

    def only(self, kept: np.ndarray) -> None:
        """Forget the other words."""
        every = np.r_[True, kept]
        sizes = np.diff(self.ends, prepend=0)
        self.ids, self.ends = self.ids[np.repeat(every, sizes)], sizes[every].cumsum()
        self.known, self.again = self.known.filter(pa.array(kept)), np.zeros(kept.sum(), bool)

    def add(self, new: pa.Array) -> None:
        plain = _numbers(pc.match_substring_regex(new, LETTERS))
        letters = " ".join(new.filter(pa.array(plain)).to_pylist()).encode()
        letters = codecs.charmap_decode(letters, "strict", self.bytes)[0].split(" ") if letters else []
        others = self.tokenizer.encode_batch_fast(new.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        tokenize, letters, others = self.tokenizer.model.tokenize, iter(letters), iter(others)
        out = [[t.id for t in tokenize(next(letters))] if p else next(others).ids for p in plain.tolist()]
        ends = self.ends[-1] + np.cumsum([len(ids) for ids in out])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(out), "<u4", int(ends[-1] - self.ends[-1]))])
        self.ends = np.concatenate([self.ends, ends])
        self.known, self.again = pa.concat_arrays([self.known, new]), np.r_[self.again, np.zeros(len(new), bool)]

    def places(self, distinct: pa.Array) -> np.ndarray:
        """The number of each word among those that are kept, from 1."""
        if len(self.known) > CACHE_WORDS:  # the slices are small, so that one goes little beyond
            self.only(self.again if 2 * self.again.sum() < CACHE_WORDS else np.zeros(len(self.known), bool))
        at = pc.index_in(distinct, self.known)
        unknown = _numbers(pc.is_null(at))
        place = _numbers(pc.fill_null(at, 0)).astype(np.int64)
        self.again[place[~unknown]] = True
        if unknown.any():
            place[unknown] = len(self.known) + np.arange(unknown.sum())
            self.add(distinct.filter(pa.array(unknown)))
        return place + 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end mark; where each text ends)."""
        lists = words(texts)
        coded = lists.flatten().dictionary_encode()
        word = self.places(coded.dictionary)[coded.indices.to_numpy()]
        last = np.cumsum(_numbers(lists.value_lengths()), dtype=np.int64)
        word = np.insert(word, last, 0)
        sizes = np.diff(self.ends, prepend=0)
        begin, size = (self.ends - sizes)[word], sizes[word]
        end = size.cumsum()
        at = np.arange(end[-1]) + np.repeat(begin - end + size, size)
        return self.ids[at], end[last + np.arange(len(last))]


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _pieces(path: str, most: int, with_ids: bool):
    def run(batches):
        encode = Encoder(path)  # goes with the task: Spark keeps its workers
        for part in slices(batches, SLICE, SLICE_BYTES):
            ids, ends = encode(pc.fill_null(part.column("text"), ""))
            begins = np.r_[0, ends[:-1]]
            times = -(-(ends - begins) // most)
            row = np.repeat(np.arange(part.num_rows), times)
            piece = np.arange(len(row)) - np.repeat(times.cumsum() - times, times)
            start = piece * most
            length = np.minimum((ends - begins)[row] - start, most)
            data = memoryview(ids.tobytes())
            cuts = list(zip((4 * (begins[row] + start)).tolist(), (4 * (begins[row] + start + length)).tolist(), strict=True))
            crc = [zlib.crc32(data[a:b]) for a, b in cuts]
            own = [bytes(data[a:b]) for a, b in cuts] if with_ids else [None] * len(cuts)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(of), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array(own, pa.binary()), part.column("x").take(of)], [c.split()[0] for c in PIECES.split(", ")])
    return run


def pieces(docs: DataFrame, path: str, most: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``x`` is a hash of the row that spreads pieces over blocks."""
    d, text = column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")
    rows = docs.select(d, text).withColumn("x", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(lean(_pieces(path, most, with_ids)), PIECES)


class Lengths:
    """Counts of item lengths with ordered look-up."""

    def __init__(self, counts: dict[int, int]):
        self.n = Counter({k: v for k, v in counts.items() if v > 0})
        self.keys = sorted(self.n)

    def take(self, length: int, times: int) -> None:
        self.n[length] -= times
        if not self.n[length]:
            del self.n[length]
            self.keys.pop(bisect.bisect_left(self.keys, length))

    def largest(self, most: int, but: int) -> int:
        """The largest length up to ``most``, one item of length ``but`` being in use; 0 if none."""
        at = bisect.bisect_right(self.keys, most) - 1
        if at >= 0 and self.keys[at] == but and self.n[but] < 2:
            at -= 1
        return self.keys[at] if at >= 0 else 0

    def smallest(self, count: int, but: int) -> list[int]:
        out: list[int] = []
        for k in self.keys:
            out += [k] * min(self.n[k] - (k == but), count - len(out))
            if len(out) == count:
                break
        return out


def dominated(items: Lengths, room: int) -> dict[tuple[int, ...], int]:
    """Fix sets that dominate all others with the same largest item; ``items`` loses them."""
    fixed: Counter = Counter()
    found = True
    while found:
        found = False
        for item in reversed(items.keys.copy()):
            while items.n.get(item):
                left = room - item
                partner = items.largest(left, item)
                if not partner:
                    fixed[(item,)] += items.n[item]
                    items.take(item, items.n[item])
                    found = True
                    break
                least = items.smallest(3, item)
                sure = partner == left or len(least) < 2 or least[0] + least[1] > left
                if not sure and (len(least) < 3 or sum(least) > left):
                    sure = partner >= best_pair(items, left, item)
                if not sure:
                    break
                times = items.n[item] // 2 if partner == item else min(items.n[item], items.n[partner])
                # what is sure stays so: taking items away only raises the least sums and lowers the best pair
                fixed[(item, partner)] += times
                if partner == item:
                    items.take(item, 2 * times)
                else:
                    items.take(item, times)
                    items.take(partner, times)
                found = True
    return fixed


def best_pair(items: Lengths, left: int, but: int) -> int:
    """The largest sum, up to ``left``, of two items other than one of length ``but``."""
    best, low, high = 0, 0, len(items.keys) - 1
    count = lambda k: items.n[k] - (k == but)
    while low <= high:
        a, b = items.keys[low], items.keys[high]
        if a + b > left:
            high -= 1
            continue
        if count(a) > 0 and count(b) > (a == b):
            best = max(best, a + b)
        elif count(b) < 1:
            high -= 1
            continue
        low += 1
    return best


def best_fit(items: Lengths, room: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts: equal open sequences are handled together."""
    open_: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []

    def put(left: int, pattern: tuple[int, ...], times: int) -> None:
        if times and not open_[left]:
            bisect.insort(rooms, left)
        if times:
            open_[left][pattern] += times

    for item in reversed(items.keys.copy()):
        n = items.n[item]
        while n:
            at = bisect.bisect_left(rooms, item)
            if at == len(rooms):
                left, pattern, times = room, (), n
            else:
                left = rooms[at]
                pattern, times = open_[left].popitem()
                if not open_[left]:
                    rooms.pop(at)
            each = left // item
            full = min(times, n // each)
            rest = n - full * each if full < times else 0
            put(left - each * item, pattern + (item,) * each, full)
            if 0 < rest:
                rest = min(rest, each)
                put(left - rest * item, pattern + (item,) * rest, 1)
            if pattern:
                put(left, pattern, times - full - (rest > 0))
            n -= full * each + rest
    out: Counter = Counter()
    for patterns in open_.values():
        out.update(patterns)
    return out


def solve(counts: dict[int, int], room: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with their multiplicities."""
    items = Lengths(counts)
    fixed = Counter(dominated(items, room))
    fixed.update(best_fit(items, room))
    return sorted(fixed.items(), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a sequence, first sequence, first offset), by first rank."""
    used: Counter = Counter()
    out = defaultdict(list)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out[length].append((used[length], each, sequence, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _assign(where: dict[int, np.ndarray]):
    def run(batches):
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            length, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                at = where[int(n)]
                p = at[np.searchsorted(at[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - p[:, 0]
                sequence[own] = p[:, 2] + nth // p[:, 1]
                offset[own] = p[:, 3] + nth % p[:, 1] * n
            yield rows.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)
    return run


def pack(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece and its place."""
    cut = stage(pieces(docs, path or tokenizer_path(), most, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``most`` rows
    where = places(solve(histogram, most))
    blocks = max(1, -(-sum(histogram.values()) // BLOCK_ROWS))
    placed = cut.withColumn("block", F.pmod(F.xxhash64("x", "piece"), F.lit(blocks)))
    sizes = placed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("x", "piece", "doc_id"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = placed.withColumn("r", within).join(starts, ["length", "block"])
    ranked = ranked.select(*columns, (F.col("before") + F.col("r") - 1).alias("rank"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * with_ids
    return ranked.mapInPandas(lean(_assign(where)), kinds + "sequence_id long, offset long")

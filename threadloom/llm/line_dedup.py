"""Line dedup by content-defined chunks of lines: passages that came earlier in the corpus are removed.

A text's units are its lines, and within lines the parts that punctuation ends. A hash of each unit feeds a rolling hash over ``WINDOW``
units; where that is 0 modulo ``DIVISOR`` a chunk of ``CHUNK_CHARS`` or more ends. Boundaries depend on the units nearby alone, so an insertion or
deletion shifts none beyond them. A chunk that occurs again in the corpus is matched with its first place (least
doc_id, then row and place): both carry their text into a join, which compares every byte. Where the neighbouring chunks do
not match too, the match grows to both sides, by up to ``REACH`` chunks, as far as the words agree, so a passage goes whole even where
it begins or ends inside a unit. Matches that meet or overlap are one run. A run of at least two units and ``RUN_WORDS``
words, or of ``LONG_WORDS`` words, is removed; shorter repetitions, like single closing brackets or short lines, stay. Lines
that keep no word go with their line ends, other lines keep the words around the run.

Of equal passages the first place stays; matches inside one row do not grow. A passage is found if it holds a whole
chunk; README tells how many of the words of long repeated passages that leaves.

Null and empty texts have no chunks; blank lines alone are none. Rows are numbered, so repeated and null ids (which come
first) are rows like others, and equal rows go but for the first. Only doc_id and text are read; other columns, whatever
their names, stay in ``doc``.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, lean, numbered, row_key, ship
from threadloom.llm.common import stage_packed as stage
from threadloom.session import drop_staged

ship(__name__)

WINDOW = 2
DIVISOR = 2
#: A chunk ends at the first boundary from here on; a text's end may leave a shorter one, which is not matched.
CHUNK_CHARS = 36
#: Chunks beside a match into which it may grow: boundaries there depend on what stands around the passage.
REACH = 2
RUN_WORDS = 30
LONG_WORDS = 50
#: Places of one chunk that meet its first text in one task.
SALT_ROWS = 4096
ROLL = 0x9E3779B97F4A7C15
#: A line end, or punctuation before white space, with the white space after it; one set of first characters makes the search fast.
UNIT_END = re.compile(r"[\n.!?,;:](?:(?<=\n)|[.!?,;:]*(?=\s))\s*")
WORD = re.compile(r"\S+")
#: Texts handed to Python that give their rows at a time.
TEXTS = 1000
CHUNKS = "d long, rid long, no int, key long"
SLICES = "key long, salt int, first boolean, rid long, at int, end int, whole int, pre string, body string, post string"


def chunks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, key) of each chunk of a text, in characters; white space after a unit belongs to it."""
    first = len(text) - len(text.lstrip())
    starts = [first, *[m.end() for m in UNIT_END.finditer(text, first)]]
    if starts[-1] == len(text):
        starts.pop()
    if not starts:
        return []
    starts.append(len(text))
    hashes = np.array([xxhash.xxh3_64_intdigest(text[i:j].rstrip()) for i, j in pairwise(starts)], np.uint64)
    rolling = hashes.copy()
    for back in range(1, WINDOW):
        rolling[back:] = rolling[back:] * np.uint64(ROLL) + hashes[:-back]
    rolling ^= rolling >> np.uint64(32)
    bounds = [first]
    for e in (rolling % np.uint64(DIVISOR) == 0).nonzero()[0].tolist():
        if starts[e + 1] - bounds[-1] >= CHUNK_CHARS:
            bounds.append(starts[e + 1])
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return [(i, j, xxhash.xxh3_64_intdigest(text[i:j].rstrip()) - (1 << 63)) for i, j in pairwise(bounds)]


def _some(batches):
    for rows in batches:
        for at in range(0, rows.num_rows, TEXTS):
            yield rows.slice(at, TEXTS)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


def _chunks(batches):
    for rows in _some(batches):
        times, places, keys = [], [], []
        for text in rows.column("text").to_pylist():
            before = len(keys)
            for no, (at, end, key) in enumerate(chunks(text)) if text else ():
                if end - at >= CHUNK_CHARS:
                    places.append(no)
                    keys.append(key)
            times.append(len(keys) - before)
        d, rid = (np.repeat(_numbers(rows.column(c)), times) for c in ("d", "rid"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(d), pa.array(rid), pa.array(places, pa.int32()), pa.array(keys, pa.int64())], ["d", "rid", "no", "key"])


def _slices(batches):
    """Text of the repeated chunks of each row, with the neighbours' where a match may grow."""
    for rows in _some(batches):
        lists, texts = rows.column("marks"), rows.column("text").to_pylist()
        row = np.repeat(np.arange(rows.num_rows), _numbers(lists.value_lengths()))
        marks = lists.flatten()
        no, salts, first, rid0, no0 = (_numbers(pc.struct_field(marks, c)) for c in ("no", "salts", "first", "rid0", "no0"))
        order = np.lexsort((no, row))
        row, no, salts, first, rid0, no0 = (x[order] for x in (row, no, salts, first, rid0, no0))
        rid = _numbers(rows.column("rid"))[row]
        on = (row[1:] == row[:-1]) & (no[1:] == no[:-1] + 1) & ~first[1:] & ~first[:-1] & (rid0[1:] == rid0[:-1]) & (no0[1:] == no0[:-1] + 1)
        grows = first | (rid0 != rid)  # where the match goes on in the next chunk, it needs no growing
        back, ahead = grows & ~np.r_[False, on][: len(row)], grows & ~np.r_[on, False][: len(row)]
        keys, starts, ends, whole, pre, body, post = [], [], [], [], [], [], []
        here, text, own = -1, "", []
        for r, n, b, a in zip(row.tolist(), no.tolist(), back.tolist(), ahead.tolist(), strict=True):
            if r != here:
                here, text = r, texts[r]
                own = chunks(text)
            at, end, key = own[n]
            own_text = text[at:end].rstrip()
            keys.append(key)
            starts.append(at)
            ends.append(at + len(own_text))
            whole.append(end - at)
            body.append(own_text)
            pre.append(text[own[max(n - REACH, 0)][0] : at] if b else None)
            post.append(text[end : own[min(n + REACH, len(own) - 1)][1]] if a else None)
        # a first place goes to every task that holds later ones
        times = np.where(first, salts, 1)
        copy = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
        salt = np.where(np.repeat(first, times), copy, np.repeat(rid % salts, times))
        every = [pa.array(keys, pa.int64()), pa.array(first), pa.array(rid), *(pa.array(x, pa.int32()) for x in (starts, ends, whole)), *(
            pa.array(x, pa.string()) for x in (pre, body, post))]
        every = [x.take(pa.array(np.repeat(np.arange(len(row)), times))) for x in every]
        every.insert(1, pa.array(salt.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(every, [c.split()[0] for c in SLICES.split(", ")])


def same_end(a: str, b: str) -> int:
    """Characters of the longest common end that starts with a word in both."""
    if a == b:
        return len(a)
    n, most = 0, min(len(a), len(b))
    while n < most and a[-1 - n] == b[-1 - n]:
        n += 1
    while n and not (a[-n:][0] != " " and (n == len(a) or a[-1 - n].isspace()) and (n == len(b) or b[-1 - n].isspace())):
        n -= 1
    return n


def same_start(a: str, b: str) -> int:
    """Characters of the longest common start that ends with a word in both."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    while n and not ((n == len(a) or a[n].isspace()) and (n == len(b) or b[n].isspace())):
        n -= 1
    return n


def _grown(pre: pd.Series, pre0: pd.Series, post: pd.Series, post0: pd.Series) -> pd.DataFrame:
    out = []
    for a, b, c, d in zip(pre, pre0, post, post0, strict=True):
        out.append((0 if a is None else same_end(a, b), 0 if c is None else same_start(c, d)))
    return pd.DataFrame(out, columns=["before", "after"])


def runs(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that meet or overlap as one, if they are long enough to go."""
    joined: list[list[int]] = []
    for at, end in sorted(spans):
        if joined and (at <= joined[-1][1] or text[joined[-1][1] : at].isspace()):
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([at, end])
    out = []
    for at, end in joined:
        own = text[at:end]
        words = len(own.split())
        if words >= LONG_WORDS or words >= RUN_WORDS and UNIT_END.search(own.strip()):
            out.append((at, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the runs of these spans, runs removed, whole lines removed)."""
    gone = runs(text, spans)
    out, at, dropped, here = [], 0, 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        while here < len(gone) and gone[here][1] <= at:
            here += 1
        parts, place, k = [], at, here
        while k < len(gone) and gone[k][0] < end:
            parts.append(text[place : max(place, gone[k][0])])
            place = min(end, gone[k][1])
            k += 1
        hit = k > here
        parts.append(text[place:end])
        left = "".join(parts) if not hit else " ".join(p.strip() for p in parts if p.strip())
        # a blank line goes with a run that goes on on both sides of it
        inside = not line.strip() and here < len(gone) and gone[here][0] < at and end < gone[here][1]
        if hit and not left or inside:
            dropped += 1
        else:
            out.append(left)
        at = end + 1
    return "\n".join(out), len(gone), dropped


def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    kept = []
    for whole, spans in zip(text, gone, strict=True):
        if whole is None or spans is None:
            kept.append((whole, 0, 0))
        else:
            kept.append(cut(whole, [(s["at"], s["end"]) for s in spans]))
    return pd.DataFrame(kept, columns=["clean", "n_removed", "lines_removed"])


def _numbered(docs: DataFrame) -> DataFrame:
    """(d, h, text, doc, rid): ``rid`` numbers the rows, ``doc`` holds the other columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    doc = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    return numbered(docs, [*row_key(docs), column(docs, "text", "string").alias("text"), doc.alias("doc")])


def repeated(rows: DataFrame) -> DataFrame:
    """(rid, gone) of numbered rows with matches: (at, end) of each match with an earlier place, in characters.

    A written table; those on the way to it are deleted as soon as the next one is there.
    """
    every = stage(rows.select("d", "rid", "text").mapInArrow(lean(_chunks), CHUNKS), "chunks")
    again = stage(every.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1"), "again")
    found = stage(every.join(again, "key"), "repeated")
    drop_staged(every)
    drop_staged(again)
    place = F.struct("d", "rid", "no")
    firsts = found.groupBy("key").agg(F.min(place).alias("f"))
    marks = found.join(firsts, "key").select(
        "rid", "no", F.ceil(F.col("times") / SALT_ROWS).cast("int").alias("salts"),
        (place == F.col("f")).alias("first"), F.col("f.rid").alias("rid0"), F.col("f.no").alias("no0"))
    marks = marks.groupBy("rid").agg(F.collect_list(F.struct("no", "salts", "first", "rid0", "no0")).alias("marks"))  # at most the text's chunks
    marks = stage(marks, "marks")
    drop_staged(found)
    # the few marks are hashed, so that no text is sorted
    slices = stage(rows.select("rid", "text").join(marks.hint("shuffle_hash"), "rid").mapInArrow(lean(_slices), SLICES), "slices")
    drop_staged(marks)
    origin = slices.filter("first").select("key", "salt", *[F.col(c).alias(c + "0") for c in ("pre", "body", "post")])
    later = slices.filter("NOT first").join(origin, ["key", "salt"]).filter("body = body0")
    grow = F.pandas_udf(_grown, "before int, after int")
    grown = later.withColumn("by", grow("pre", "pre0", "post", "post0"))
    after = F.col("by.after")  # the neighbour's text starts where the chunk, with its white space, ends
    end = F.when(after > 0, F.col("at") + F.col("whole") + after).otherwise(F.col("end"))
    spans = grown.select("rid", (F.col("at") - F.col("by.before")).alias("at"), end.alias("end"))
    gone = stage(spans.groupBy("rid").agg(F.collect_list(F.struct("at", "end")).alias("gone")), "gone")
    drop_staged(slices)
    return gone


def dedup(docs: DataFrame) -> DataFrame:
    """(rid, d, h, text, doc, clean, n_removed, lines_removed) of each row: its text with and without the removed passages.

    ``n_removed`` counts the runs removed, ``lines_removed`` the lines that went whole. ``doc`` holds the other columns of the row.
    """
    rows = _numbered(docs)
    gone = repeated(rows).hint("shuffle_hash")
    out_cut = F.pandas_udf(_cut, "clean string, n_removed int, lines_removed int")
    hit = F.col("gone").isNotNull()  # other texts need not go through Python
    found = rows.join(gone, "rid", "left").withColumn("cut", out_cut(F.when(hit, F.col("text")), "gone"))
    clean = F.when(hit, F.col("cut.clean")).otherwise(F.col("text"))
    return found.select("rid", "d", "h", "text", "doc", clean.alias("clean"), "cut.n_removed", "cut.lines_removed")

"""License scans: an exact set-similarity join between text blocks and license templates.

Blocks are the lines of a text and, as a notice may be wrapped, the text as a whole, both as overlapping
windows of ``BLOCK_WORDS`` words (four times the longest template's, if that is more) where they are longer; any run of half as
many words lies in a window whole. A
block meets a template when it holds at least ``CONTAINMENT`` of the template's distinct words.
Words are put in one global order, rarest in the corpus first. The least shared word of a pair
that meets the threshold lies in the template's prefix (all but ``need - 1`` of its words), the
block must hold ``need`` template words (length filter), and the words from the shared one on
must suffice (positional filter); pairs left over are counted exactly. No pair is lost.

Null texts are empty; rows without matches have no labels; repeated rows each get their own
result row; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, column, doc_id_of, row_key

#: Fixed values of the contract: phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices whose words a block must hold, with the label they give.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
]
CONTAINMENT = 0.8
BLOCK_WORDS = 64
STRETCH = 4
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
SPLIT = f"[{SEPARATORS}]+"


def _count(text: Column) -> Column:
    """Words of a text: parts between separators, without the empty ones at its ends."""
    parts = F.split(text, SPLIT)
    n = F.size(parts)
    ends = F.element_at(parts, 1).eqNullSafe("").cast("int") + ((n > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (n - ends).cast("long")


def _phrase(phrase: str) -> str:
    return f"(?<![^{SEPARATORS}])" + SPLIT.join(phrase.split()) + f"(?![^{SEPARATORS}])"


def _base(text: Column, total: Column) -> dict[str, Column]:
    places, firsts, lasts, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        first_word, size = phrase.split()[0], len(phrase.split())
        here = F.contains(text, F.lit(phrase.split()[-1])) & F.contains(text, F.lit(first_word)) & text.rlike(_phrase(phrase))
        places = places + F.when(here, F.size(F.regexp_extract_all(text, F.lit(_phrase(phrase)), F.lit(0)))).otherwise(0)
        firsts.append(F.when(here, _count(F.element_at(F.split(text, _phrase(phrase), 2), 1))))
        lasts.append(F.when(here, total - size - _count(F.element_at(F.split(text, _phrase(phrase)), -1))))
        labels.append(F.when(here, F.lit(label)))
    return {
        "n_base": places.cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches(docs: DataFrame, templates: list[tuple[str, str]], containment: float) -> DataFrame:
    """(d, h, label, containment) for every text block that meets a template."""
    sets = [(label, sorted(set(text.split()))) for text, label in templates]
    vocabulary = sorted({w for _, words in sets for w in words})
    text = ascii_lower(F.coalesce(column(docs, "text", "string"), F.lit("")))
    rows = docs.select(*row_key(docs), text.alias("t"))
    counted = (
        rows.select(F.explode(F.array_intersect(F.split("t", SPLIT), _strings(vocabulary))).alias("w"))
        .groupBy("w").count()
    )
    often = {r["w"]: r["count"] for r in counted.collect()}  # at most one row for each template word
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    index = []
    for n, (label, words) in enumerate(sets):
        words = sorted(words, key=place.get)
        need = math.ceil(containment * len(words) - 1e-9)
        index += [(w, n, label, p, len(words), need, words) for p, w in enumerate(words[: len(words) - need + 1])]
    spark = docs.sparkSession
    prefixes = spark.createDataFrame(index, "w string, template int, label string, p int, size int, need int, words array<string>")
    rare = sorted({x[0] for x in index})
    some = rows.filter(F.arrays_overlap(F.split("t", SPLIT), _strings(rare)))
    # lines, and the whole text if it has several, for what is wrapped over them
    parts = F.concat(F.split("t", "\n"), F.when(F.contains("t", F.lit("\n")), F.array("t")).otherwise(F.array().cast("array<string>")))
    lines = some.select("d", "h", F.explode(parts).alias("line"))
    lines = lines.select("d", "h", F.split("line", SPLIT).alias("ws")).filter(F.arrays_overlap("ws", _strings(rare)))
    lines = lines.withColumn("ws", F.filter("ws", lambda w: w != ""))
    size = max([BLOCK_WORDS, *[STRETCH * len(text.split()) for text, _ in templates]])
    half = size // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - half - 1), F.lit(half))
    blocks = lines.select("d", "h", F.explode(starts).alias("s"), "ws").select(
        "d", "h", F.array_intersect(_strings(order), F.slice("ws", F.col("s") + 1, F.lit(size))).alias("block")
    )
    pairs = blocks.select("d", "h", "block", F.posexplode("block").alias("q", "w")).join(F.broadcast(prefixes), "w")
    left = 1 + F.least(F.col("size") - F.col("p") - 1, F.size("block") - F.col("q") - 1)
    pairs = pairs.filter((F.size("block") >= F.col("need")) & (left >= F.col("need")))
    found = pairs.withColumn("overlap", F.size(F.array_intersect("block", "words"))).filter("overlap >= need")
    return found.select("d", "h", "label", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document: word counts, phrase places, the phrases' labels, all labels, the best containment."""
    text = ascii_lower(F.coalesce(column(docs, "text", "string"), F.lit("")))
    rows = docs.select(*row_key(docs), text.alias("t")).withColumn("n_words", _count(F.col("t")))
    base = rows.select("d", "h", "n_words", *[c.alias(n) for n, c in _base(F.col("t"), F.col("n_words")).items()])
    best = matches(docs, templates, containment).groupBy("d", "h").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    out = base.join(best, ["d", "h"], "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        doc_id_of().alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), (F.size("base") > 0).cast("double")).alias("score"),
    )


def oracle() -> str:
    """The same in SQL, by brute force over every block and template."""
    places, count = [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        test = " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(words))
        places.append(f"list_filter(range(len(ws) - {len(words) - 1}), lambda i: {test})")
        count.append((f"p{len(count)}", label))
    cols = ", ".join(f"{p} AS p{k}" for k, p in enumerate(places))
    every = "list_concat(list_concat(p0, p1), list_concat(p2, p3))"
    labels = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, label in count)
    values = ", ".join(
        "('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in sorted(set(text.split())))) for text, label in TEMPLATES
    )
    part = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    half = BLOCK_WORDS // 2
    return f"""
WITH docs AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_SQL}', '{UPPER_SQL.lower()}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{part}') AS ws FROM docs),
p AS (SELECT doc_id, len(ws) AS n_words, {cols} FROM w),
base AS (SELECT doc_id, n_words, {every} AS places,
  list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))) AS base FROM p),
lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(t, chr(10))), '{part}') AS ws FROM docs),
starts AS (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - {half + 1}) + 1, {half})) AS s FROM lines),
blocks AS (SELECT DISTINCT doc_id, list_distinct(ws[s + 1 : s + {BLOCK_WORDS}]) AS block FROM starts),
templates(label, words) AS (VALUES {values}),
found AS (SELECT doc_id, label, len(list_intersect(words, block)) / len(words) AS containment
  FROM blocks, templates WHERE len(list_intersect(words, block)) * 5 >= len(words) * 4),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(containment) AS best FROM found GROUP BY doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
  list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  greatest(coalesce(best, 0.0::DOUBLE), CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM base LEFT JOIN best USING (doc_id)"""


UPPER_SQL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

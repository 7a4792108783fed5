"""Toxicity by class-conditional Kneser-Ney models.

A model for each class predicts the characters of a word from up to ``ORDER - 1`` before it, with
``^`` before and ``$`` after the word. The highest order counts tokens of the class (absolute
discount ``DISCOUNT``); all lower orders are continuation counts (distinct characters before an
n-gram) over the words of the whole corpus and are shared by both classes, so a rare expression
backs off to what the corpus knows. A text's log-likelihood in each model is the sum over its
words; the difference is divided by the number of words and by its root.

A second pair of models predicts whole words. They count the texts of the class that hold a word, so
that one text which repeats a word does not make it typical, less a discount of ``WORD_DISCOUNT``,
and back off to the share of the word among the texts of the whole corpus. Rude texts are taken to
draw two of their words from the toxic model: the likelihood ratios of both words, raised to
``SHARPNESS``, are multiplied and added up over all pairs of places, so that two rude words in a long
ordinary text are not averaged away. Two words of ratio 1 are added to every text, for texts of less.
All three differences go through a logistic calibration.

The class counts come from at most ``CLASS_ROWS`` labelled documents of each class (least hash of
the id first) that the caller's filter admits; a quarter of them is set aside for calibration.
Everything else covers all rows. Words are looked up in two ways: the at most ``HOT_WORDS`` most
frequent words go to every task, the others are joined.

Null and empty texts have no words and get the calibrated score of differences of 0. Equal
words count at each of their places. Without
labels of both classes every score is 0.5. Labels that are null do not count; of several labels
of one document the largest counts. Repeated rows get a row each. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, doc_id_of, lean, row_key, ship, slices
from threadloom.session import stage

ship(__name__)

ORDER = 5
DISCOUNT = 0.75
WORD_DISCOUNT = 2.0
SHARPNESS = 4.0
CLASS_ROWS = 16384
HOT_WORDS = 65536
GRAMS_BROADCAST = 1_000_000
THRESHOLD = 0.7
FEATURES = ("per_word", "per_root", "pairs")
WORDS = r"[^\p{L}\p{N}]+"
SUMS = ("t", "p", "r", "rr")
COUNTS = ("n", "toxic", "plain", "texts", "toxic_texts", "plain_texts")
#: Rows, and bytes of texts, that Python works on at a time.
SLICE = 2000
SLICE_BYTES = 8 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, code of each word, words by code) for lower-cased words of letters and digits."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), WORDS)
    coded = lists.flatten().dictionary_encode()
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    code = coded.indices.to_numpy()
    blank = coded.dictionary.index("").as_py()
    if blank >= 0:
        text, code = text[code != blank], code[code != blank]
    return text, code, coded.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """The hashes that the SQL function xxhash64 gives."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)


def _slices(batches):
    yield from slices(batches, SLICE, SLICE_BYTES)


def _count(batches):
    for b in _slices(batches):
        text, code, words = tokens(b.column("text"))
        kind = b.column("class").fill_null(-1).to_numpy(zero_copy_only=False)
        once = np.unique(text.astype(np.int64) * max(1, len(words)) + code)  # each word of a text once
        places = [(code, kind[text]), (once % max(1, len(words)), kind[once // max(1, len(words))])]
        n = [np.bincount(x, minlength=len(words)) for c, k in places for x in (c, c[k == 1], c[k == 0])]
        used = pa.array(n[0] > 0)
        yield pa.RecordBatch.from_arrays([x.filter(used) for x in (words, *map(pa.array, n))], ["w", *COUNTS])


def _known(hot: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(hot, x), max(0, len(hot) - 1))
    return at, hot[at] == x if len(hot) else np.zeros(len(x), bool)


def _near(hot: np.ndarray, toxic: np.ndarray, plain: np.ndarray, apart: np.ndarray):
    """One row for each text: its words, and the sums over those that are hot."""
    ratio = np.exp(SHARPNESS * apart)

    def run(batches):
        for b in _slices(batches):
            text, code, words = tokens(b.column("text"))
            at, known = _known(hot, hashes(words))
            near, n = known[code], b.num_rows
            sums = [(np.bincount(text[near], v[at[code[near]]], n) if len(hot) else np.zeros(n)).astype(float) for v in (toxic, plain, ratio, ratio * ratio)]
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("h"), *map(pa.array, (np.bincount(text, minlength=n), *sums))], ["d", "h", "words", *SUMS])
    return run


def _far(hot: np.ndarray):
    """One row for each place of a word that is not hot."""
    def run(batches):
        for b in _slices(batches):
            text, code, words = tokens(b.column("text"))
            x = hashes(words)
            other = ~_known(hot, x)[1][code]
            at = pa.array(text[other])
            yield pa.RecordBatch.from_arrays([b.column("d").take(at), b.column("h").take(at), pa.array(x[code[other]])], ["d", "h", "x"])
    return run


def learning_rows(labels: DataFrame, admitted: Column) -> DataFrame:
    """(d, toxic, calibrate): at most CLASS_ROWS labelled ids of each class."""
    rows = labels.filter(admitted & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy(F.col("doc_id").alias("d")).agg(F.max("toxic").alias("toxic"))
    rows = rows.withColumn("x", F.xxhash64("d"))
    part = [rows.filter(F.col("toxic") == c).orderBy("x", "d").limit(CLASS_ROWS) for c in (0, 1)]
    return part[0].union(part[1]).select("d", "toxic", (F.pmod("x", F.lit(4)) == 0).alias("calibrate"))


def vocabulary(docs: DataFrame, learning: DataFrame) -> DataFrame:
    """(w, n, toxic, plain, and the same for texts): places and texts of each word, in all and in the learning texts of each class."""
    keyed = docs.withColumn("_d", column(docs, "doc_id", "long")).join(
        F.broadcast(learning.filter("NOT calibrate").select(F.col("d").alias("_d"), F.col("toxic").alias("_class"))), "_d", "left"
    )
    parts = keyed.select(F.col("_class").cast("int").alias("class"), column(docs, "text", "string").alias("text")).mapInArrow(
        lean(_count), "w string, " + ", ".join(f"{c} long" for c in COUNTS))
    return parts.groupBy("w").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _events(words: DataFrame, *keep: str) -> DataFrame:
    """One row for each character of each word (and its end): ``g`` is the character after its context."""
    whole = F.concat(F.lit("^"), "w", F.lit("$"))
    ends = words.select(*keep, whole.alias("s"), F.explode(F.sequence(F.lit(2), F.length("w") + 2)).alias("e"))
    start = F.greatest(F.col("e") - (ORDER - 1), F.lit(1))
    return ends.select(*keep, F.substring("s", start, F.col("e") - start + 1).alias("g"))


def _context(g: str = "g") -> Column:
    return F.substring(g, F.lit(1), F.length(g) - 1)


def _tail(g: str = "g") -> Column:
    return F.substring(g, F.lit(2), F.length(g) - 1)


def models(words: DataFrame) -> DataFrame:
    """(g, toxic, plain): log-probability of the last character of each n-gram in each class."""
    top = stage(_events(words, "toxic", "plain").groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "grams")
    levels, above = {}, top.filter(F.length("g") == ORDER).select("g")
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stage(above.groupBy(_tail().alias("g")).agg(F.count("*").alias("a")), "continuations")
        above = levels[k].select("g").union(top.filter(F.length("g") == k).select("g"))
    total = levels[1].agg(F.sum("a").alias("total"), F.count("*").alias("kinds"))
    sums = total.first()
    shared = levels[1].select("g", ((F.col("a") + 1) / F.lit((sums["total"] or 0) + sums["kinds"] + 1)).alias("p"))
    every = shared
    for k in range(2, ORDER):
        own = levels[k].withColumn("c", _context()).withColumn("t", _tail())
        sums = own.groupBy("c").agg(F.sum("a").alias("all"), F.count("*").alias("kinds"))
        low = shared.select(F.col("g").alias("t"), F.col("p").alias("low"))
        shared = own.join(sums, "c").join(low, "t").select("g", (
            (F.greatest(F.col("a") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("low")) / F.col("all")
        ).alias("p"))
        shared = stage(shared, "shared")
        every = every.union(shared)
    own = top.withColumn("c", _context()).withColumn("t", _tail())
    sums = own.groupBy("c").agg(*[
        x for n in ("toxic", "plain") for x in (F.sum(n).alias(f"{n}_all"), F.count_if(F.col(n) > 0).alias(f"{n}_kinds"))
    ])
    joined = own.join(sums, "c").join(every.select(F.col("g").alias("t"), F.col("p").alias("low")), "t")

    def logp(n: str) -> Column:
        high = F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{n}_kinds") * F.col("low")
        return F.log(F.when(F.col(f"{n}_all") > 0, high / F.col(f"{n}_all")).otherwise(F.col("low"))).alias(n)

    return stage(joined.select("g", logp("toxic"), logp("plain")), "model")


def words_apart(words: DataFrame) -> DataFrame:
    """``words`` with ``apart``: how much likelier the word is in a toxic text than in an ordinary one (natural logarithm)."""
    kept = [F.sum(F.least(F.col(f"{c}_texts").cast("double"), F.lit(WORD_DISCOUNT))).alias(c) for c in ("toxic", "plain")]
    all_of = words.agg(*[F.sum(c).alias(c) for c in ("texts", "toxic_texts", "plain_texts")], *kept).first()
    shared = F.col("texts") / F.lit(float(all_of["texts"] or 1))

    def logp(c: str) -> Column:
        n = float(all_of[f"{c}_texts"] or 0)
        own = F.greatest(F.col(f"{c}_texts") - WORD_DISCOUNT, F.lit(0.0))
        return F.log((own + float(all_of[c]) * shared) / n) if n else F.log(shared)

    return words.withColumn("apart", logp("toxic") - logp("plain"))


def word_scores(words: DataFrame, model: DataFrame) -> DataFrame:
    """(x, n, toxic, plain, apart): hash, log-likelihoods of the spelling and difference of the word models for every word."""
    small = model.count() <= GRAMS_BROADCAST
    keyed = words_apart(words).withColumn("x", F.xxhash64("w"))
    scored = _events(keyed, "x", "n", "apart").join(F.broadcast(model) if small else model, "g")
    return stage(scored.groupBy("x").agg(
        F.max("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"), F.max("apart").alias("apart")), "words")


def likelihoods(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(d, h, words, t, p, r, rr): log-likelihoods of each text, sums of its words' sharpened likelihood ratios and of their squares."""
    sizes = words.groupBy(F.ceil(F.log2("n")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # at most 64 rows
    bound, seen = 64, 0
    for r in sizes:
        seen += r["count"]
        if seen > HOT_WORDS:
            break
        bound = r["b"]
    hot = F.ceil(F.log2("n")).cast("int") >= bound
    known = words.select("x", F.col("toxic").alias("t"), F.col("plain").alias("p"), "apart", hot.alias("hot"))
    top = known.filter("hot").select("x", "t", "p", "apart").toPandas().sort_values("x")  # at most HOT_WORDS
    hot_x = top["x"].to_numpy()
    texts = docs.select(*row_key(docs), column(docs, "text", "string").alias("text"))
    near = texts.mapInArrow(
        lean(_near(hot_x, top["t"].to_numpy(), top["p"].to_numpy(), top["apart"].to_numpy())),
        "d long, h long, words long, " + ", ".join(f"{c} double" for c in SUMS))
    far = texts.mapInArrow(lean(_far(hot_x)), "d long, h long, x long").join(known.filter("NOT hot").select("x", "t", "p", F.exp(SHARPNESS * F.col("apart")).alias("r")), "x")
    far = far.withColumn("rr", F.col("r") * F.col("r")).groupBy("d", "h").agg(
        F.lit(0).cast("long").alias("words"), *[F.sum(c).alias(c) for c in SUMS])
    return near.union(far).groupBy("d", "h").agg(
        F.sum("words").alias("words"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SUMS]
    )


def _features() -> list[Column]:
    apart, n = F.col("toxic") - F.col("plain"), F.greatest(F.col("words"), F.lit(1))
    # Pairs of two words of the text, of one and an added one, and the pair of added ones.
    pairs = F.greatest(F.col("r") * F.col("r") - F.col("rr"), F.lit(0.0)) / 2 + 2 * F.col("r") + 1
    return [(apart / n).alias("per_word"), (apart / F.sqrt(n)).alias("per_root"), (F.log(pairs) / SHARPNESS).alias("pairs")]


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (a constant, then one for each column of ``x``) of a ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-3] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, admitted: Column | None = None) -> DataFrame:
    """(doc_id, d, h, words, per-word log-likelihoods, score) for every row of ``docs``."""
    learning = stage(learning_rows(labels, F.lit(True) if admitted is None else admitted), "learning")
    words = stage(vocabulary(docs, learning), "vocabulary")
    copies = docs.select(*row_key(docs)).groupBy("d", "h").agg(F.count("*").alias("times"))
    sums = likelihoods(docs, word_scores(words, models(words))).join(copies, ["d", "h"])
    named = {"t": "toxic", "p": "plain"}
    one = [(F.col(c) / F.col("times")).alias(named.get(c, c)) for c in ("words", *SUMS)]  # equal rows were added up
    found = stage(sums.select("d", "h", "times", *one).select("*", *_features()), "likelihoods")
    set_aside = found.join(F.broadcast(learning.filter("calibrate")).alias("y"), "d")
    rows = set_aside.groupBy("d").agg(*[F.avg(c).alias(c) for c in FEATURES], F.max("y.toxic").alias("y"))
    rows = rows.toPandas()  # one for each id, at most 2 * CLASS_ROWS
    both = rows["y"].nunique() == 2
    w = calibrate(rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(float)) if both else np.zeros(1 + len(FEATURES))
    z = sum((float(v) * F.col(c) for v, c in zip(w[1:], FEATURES, strict=True)), F.lit(float(w[0])))
    n = F.greatest(F.col("words"), F.lit(1))
    once = found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return once.select(
        doc_id_of().alias("doc_id"), "d", "h", F.col("words").cast("long").alias("words"), (F.col("toxic") / n).alias("toxic_per_word"),
        (F.col("plain") / n).alias("plain_per_word"), (1 / (1 + F.exp(-z))).alias("score"),
    )


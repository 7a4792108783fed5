"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words (lower case, letters and digits), a word's weight its count S. For each of
``SAMPLES`` samples and each word, r and c are Gamma(2, 1) and b uniform, drawn from hashes of the word:
t = floor(ln S / r + b), y = exp(r (t - b)), a = c / (y e^r). The word with the least a, with its t, is
the sample; two texts agree in a sample with the probability of their generalised Jaccard similarity.

With u1 and u2 uniform, -ln u1 - ln u2 is Gamma(2, 1) and the share of -ln u1 in it uniform and independent of it. Drawn as that
r and b, a is c u2 (u1 u2)^t, and t is 0 for words that occur once: these need one logarithm. The value of a is
as good as unique to a word and its t, so the least a is kept as a double and a hash of it stands in the fingerprint.

A null text is empty; a text without words has the fingerprint of one fixed mark, so such texts are
alike. Rows with equal ids and equal texts are one document in the order and get a result row each; of equal ids the
less hash of the text comes first; a null doc_id comes before all and is kept. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import column, doc_id_of, global_rank, row_key
from threadloom.session import stage

SAMPLES = 64
#: Samples of one row; more make generated code too long to be compiled soon.
GROUP = 8
#: Marks of HEX digits in a long.
PACK = 4
HEX = 4
NONE = 1e300
WORDS = r"[^\p{L}\p{N}]+"
SHA_PARTS = 5


def _uniform(h: Column, part: int) -> Column:
    """One of the uniform numbers of 21 bits in a hash."""
    return (F.shiftrightunsigned(h, 21 * part).bitwiseAND((1 << 21) - 1).cast("double") + 0.5) / float(1 << 21)


def sample(k: int) -> Column:
    """The value a of word ``x`` with count ``s`` (``log_s`` its logarithm) in sample ``k`` of group ``g``."""
    seed = F.col("g") * (2 * GROUP) + 2 * k
    one, two = F.xxhash64("x", seed), F.xxhash64("x", seed + 1)
    u1, u2 = _uniform(one, 0), _uniform(one, 1)
    c = -F.log(_uniform(two, 0) * _uniform(two, 1))
    t = F.floor((F.log(u1) - F.col("log_s")) / F.log(u1 * u2))
    return c * u2 * F.when(F.col("s") == 1, 1.0).otherwise(F.pow(u1 * u2, t))


def _minima(terms: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """For each key and group of samples ``g``, the least value of each sample among the key's terms ``x`` (null: none) with counts ``s``.

    Also the greatest of each ``carry`` column.
    """
    word = F.col("x").isNotNull()
    some = terms.withColumn("log_s", F.log("s")).withColumn("no", F.when(word, 0.0).otherwise(NONE))
    some = some.withColumn("g", F.explode(F.array(*[F.lit(g) for g in range(SAMPLES // GROUP)])))
    values = [F.min(sample(k) + F.col("no")).alias(f"m{k}") for k in range(GROUP)]
    return some.groupBy(*keys, "g").agg(*values, *[F.max(n).alias(n) for n in carry])


def _packed(prefix: str, first: int) -> Column:
    """``PACK`` marks (hashes of least values) in one long."""
    out = F.lit(0).cast("long")
    for k in range(first, first + PACK):
        mark = F.xxhash64(F.least(F.col(f"{prefix}{k}"), F.lit(NONE))).bitwiseAND((1 << 4 * HEX) - 1)
        out = F.shiftleft(out, 4 * HEX).bitwiseOR(mark)
    return out


def fingerprint_pairs(texts: DataFrame, keys: list[str], carry: dict[str, Column]) -> DataFrame:
    """``keys``, ``carry`` and the fingerprints (``fingerprint``, ``edited_fingerprint``) of two versions (``v`` 0 and 1) of a text ``t``.

    A term with the same count in both versions is sampled once for both; the least value of a version is
    the lesser of what its own terms and the common ones give. ``carry`` (longs) is taken of version 1.
    Needs no shuffle if ``texts`` is partitioned by some of the keys.
    """
    words = texts.select(*keys, "v", "t", F.posexplode(F.split(F.lower("t"), WORDS)).alias("at", "w"))
    first = [F.when((F.col("at") == 0) & (F.col("v") == 1), c).alias(n) for n, c in carry.items()]
    # a text without words has one null term; with words, the nulls come from its ends and do not count
    words = words.select(*keys, "v", F.when(F.col("w") != "", F.xxhash64("w")).alias("x"), *first)
    counted = words.groupBy(*keys, "x").agg(
        F.sum(1 - F.col("v")).alias("s0"), F.sum("v").alias("s1"), *[F.max(n).alias(n) for n in carry])
    own, new, both = (F.struct(F.lit(part).alias("part"), F.col(s).alias("s")) for part, s in ((0, "s0"), (1, "s1"), (2, "s0")))
    parts = (F.when(F.col("s0") == F.col("s1"), F.array(both)).when(F.col("s1") == 0, F.array(own))
             .when(F.col("s0") == 0, F.array(new)).otherwise(F.array(own, new)))
    terms = counted.select(*keys, "x", *carry, F.explode(parts).alias("p")).select(*keys, "p.part", "p.s", "x", *carry)
    least = _minima(terms, [*keys, "part"], list(carry))
    sides = [F.min(F.when(F.col("part") != other, F.col(f"m{k}"))).alias(f"{side}{k}")
             for side, other in (("a", 1), ("b", 0)) for k in range(GROUP)]
    least = least.groupBy(*keys, "g").agg(*sides, *[F.max(n).alias(n) for n in carry])
    packs = {f"{side}_{first}": _packed(side, first) for side in "ab" for first in range(0, GROUP, PACK)}
    least = least.select(*keys, "g", *carry, *[c.alias(n) for n, c in packs.items()])
    marks = [F.max(F.when(F.col("g") == g, F.col(n))).alias(f"{n}_{g}") for n in packs for g in range(SAMPLES // GROUP)]
    found = least.groupBy(*keys).agg(*marks, *[F.max(n).alias(n) for n in carry])

    def digits(side: str) -> Column:
        names = [f"{side}_{first}_{g}" for g in range(SAMPLES // GROUP) for first in range(0, GROUP, PACK)]
        return F.concat(*[F.lower(F.lpad(F.hex(n), PACK * HEX, "0")) for n in names])

    return found.select(*keys, *carry, digits("a").alias("fingerprint"), digits("b").alias("edited_fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = F.lit(0)
    for j in range(SAMPLES):
        same = same + (F.substring(a, 1 + HEX * j, HEX) == F.substring(b, 1 + HEX * j, HEX)).cast("int")
    return same / float(SAMPLES)


def _sha_carry(text: Column) -> dict[str, Column]:
    """The SHA-256 of a text as longs of 13 hex digits each, which hash aggregates can hold."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    return {f"sha{i}": F.conv(F.substring(digest, 1 + 13 * i, 13), 16, 10).cast("long") for i in range(SHA_PARTS)}


def _sha() -> Column:
    widths = [13, 13, 13, 13, 12]
    return F.concat(*[F.lower(F.lpad(F.hex(f"sha{i}"), w, "0")) for i, w in enumerate(widths)])


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text (its last quarter replaced by the start of the next document), and their likeness."""
    text = F.coalesce(column(docs, "text", "string"), F.lit(""))
    keyed = docs.select(*row_key(docs), F.char_length(text).cast("long").alias("n"))
    slim = keyed.groupBy("d", "h").agg(F.first("n").alias("n"), F.count("*").alias("times"))
    order = stage(global_rank(slim, ["d", "h"], "order"), "order")
    counts = order.agg(F.count("*").alias("n"), F.max("times").alias("most")).first()
    rows, repeated = counts["n"], (counts["most"] or 1) > 1
    after = order.select((F.pmod(F.col("rank") - 1, F.lit(max(1, rows)))).alias("rank"), F.col("d").alias("next_d"), F.col("h").alias("next_h"))
    plan = stage(order.join(after, "rank").select("d", "h", "n", "times", "next_d", "next_h"), "next")
    texts = docs.select(*row_key(docs), text.alias("t"))
    if repeated:
        texts = texts.groupBy("d", "h").agg(F.first("t").alias("t"))
    want = plan.select(F.col("next_d").alias("d"), F.col("next_h").alias("h"), F.col("d").alias("to_d"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = texts.join(want, ["d", "h"]).groupBy("d", "h").agg(
        F.first(F.struct("to_d", "to_h", "take", F.substring("t", F.lit(1), F.col("take")).alias("head"))).alias("x")
    ).select(F.col("x.to_d").alias("d"), F.col("x.to_h").alias("h"), "x.take", "x.head")
    both = texts.join(heads, ["d", "h"])
    n = F.char_length("t")
    new = F.concat(F.substring("t", F.lit(1), n - F.col("take")), F.col("head"))
    pair = both.select("d", "h", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("t").alias("t")), F.struct(F.lit(1).alias("v"), new.alias("t")))).alias("y"))
    prints = fingerprint_pairs(pair.select("d", "h", "y.v", "y.t"), ["d", "h"], _sha_carry(F.col("t")))
    own = prints.select("d", "h", "fingerprint", "edited_fingerprint", _sha().alias("edited_sha256"))
    own = stage(own.join(plan, ["d", "h"]), "prints")
    other = own.select(F.col("d").alias("next_d"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    out = own.join(other, ["next_d", "next_h"])
    if repeated:
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(
        doc_id_of().alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )

"""Corpus pipeline: toxicity, line dedup, near duplicates, source mixing, packing.

Each stage takes the documents that the one before kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm import kneser_ney, line_dedup, mixing, ngram_join, packing
from threadloom.llm.common import NULL_ID, numbered, row_key, table
from threadloom.session import scratch_dir

#: Near duplicates here: five words, similarity 0.8 or more.
SHINGLE_WORDS = 5
SHINGLE_PERCENT = 80
#: Sources may be repeated this often to come nearer to equal shares.
REPETITION = 1.5
TARGET_ENTROPY = 0.98


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; every label may be learnt from.

    All rows of a document share its score; documents without words stay if the score of a difference of 0 does.
    """
    found = kneser_ney.score(docs, table(spark, sf_dir, "labels"))
    bad = found.filter(F.col("score") >= kneser_ney.THRESHOLD).select("d", "h").distinct()
    return _keyed(docs).join(bad, ["d", "h"], "left_anti").select("doc.*")


def without_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line chunks that came earlier in the corpus; those of which nothing is left go."""
    rows = line_dedup.dedup(docs).filter("n_removed = 0 OR trim(clean) <> ''")
    changed = F.col("n_removed") > 0
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns if c != "text"}
    out = {c: out.get(c, F.col("clean")) for c in docs.columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.char_length("clean").cast("long")).otherwise(F.col("doc.n_chars"))
    return rows.select(*[c.alias(n) for n, c in out.items()])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null ids last.

    Rows are compared under numbers of their own, so null and repeated ids are like others. Rows without words stay.
    """
    rows = numbered(docs, [*row_key(docs), _whole(docs)])
    found = ngram_join.join(rows.select(F.col("rid").alias("doc_id"), F.col("doc.text").alias("text")), SHINGLE_WORDS, SHINGLE_PERCENT)
    found = found.select(F.col("doc_id").alias("rid"), "component_id").join(rows.select("rid", "d", "h"), "rid")
    least = F.min(F.struct((F.col("d") == NULL_ID).alias("no_id"), "d", "h", "rid"))
    kept = found.groupBy("component_id").agg(least.alias("first")).select(F.col("first.rid").alias("rid"))
    return rows.join(kept.hint("shuffle_hash"), "rid", "left_semi").select("doc.*")  # the few ids are hashed, no text is sorted


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again as far as the target weights ask for."""
    found = mixing.mix(docs, TARGET_ENTROPY, REPETITION, whole=True).select("d", "h", "copy", "epoch")
    rows = _keyed(docs).withColumn("copy", _copy()).join(found, ["d", "h", "copy"])
    return rows.select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All token pieces in as few sequences as the packing finds."""
    return packing.pack(docs)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*row_key(docs), _whole(docs))


def _whole(docs: DataFrame):
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def _copy():
    """Number of a row among those of its id and text."""
    return F.row_number().over(Window.partitionBy("d", "h").orderBy("d")) - 1


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", without_repeated_chunks),
    ("near_duplicates", one_of_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL expresses neither the language models nor the hashed blocks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


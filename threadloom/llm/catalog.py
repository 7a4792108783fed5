"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import crosstok, fingerprint, html_text, kneser_ney, license_scan, line_dedup, merkle, mixing, ngram_join, packing, quotes, topk, warc
from threadloom.llm.common import doc_id_of, table

THRESHOLD = kneser_ney.THRESHOLD


def _third(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents"))


def op2_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_quotation_linking(spark: SparkSession, sf: str) -> DataFrame:
    found = quotes.link(table(spark, sf, "conversations"))
    return found.withColumnRenamed("own", "text").drop("copy", "parent_copy")


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf, "documents"))


def op7_warc_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return warc.captures(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "has_request")


def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).drop("d", "h", "copy")


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    found = kneser_ney.score(table(spark, sf, "documents"), table(spark, sf, "labels"), _third() != 1)
    held_out = F.coalesce(_third() == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "words", "toxic_per_word", "plain_per_word")


def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf, "documents"))
    clean = F.coalesce("clean", F.lit(""))
    return found.select(
        doc_id_of().alias("doc_id"), F.col("n_removed").cast("long").alias("n_removed"), F.col("lines_removed").cast("long").alias("lines_removed"),
        F.char_length(clean).cast("long").alias("n_chars"), F.sha2(F.encode(clean, "UTF-8"), 256).alias("clean_sha256"))


def op11_crosstok_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return crosstok.link(table(spark, sf, "documents"))


def op12_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return merkle.prove(docs, merkle.without_line_ends(docs)).drop("proof")


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_exact_topk, op3_best_fit_packing, op4_ngram_jaccard, op5_quotation_linking,
    op6_fingerprints, op7_warc_transactions, op8_source_mixing, op9_toxicity, op10_line_dedup,
    op11_crosstok_alignment, op12_html_text, op13_merkle_manifest,
)}

OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
  coalesce(list_sum(list_transform(range(least(len(q.v), len(c.v))), lambda i: q.v[i + 1] * c.v[i + 1])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP7_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, (i * 5 + 1)::INTEGER, 5))::BIGINT) AS parts FROM d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (v >> 15) % 32)::INTEGER, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (v >> 10) % 32)::INTEGER, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (v >> 5) % 32)::INTEGER, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + v % 32)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, url, true AS has_request
FROM b"""

# Brute force over whole shingle lists; the recursion follows links by the least id.
OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE
  list_distinct(list_transform(range(len(ws) - 3), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * shared >= 85 * (na + nb - shared)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = s.doc_id)::BIGINT AS component_id FROM s"""


def oracles() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_exact_topk": OP2_SQL, "op4_ngram_jaccard": OP4_SQL, "op7_warc_transactions": OP7_SQL,
            "op13_merkle_manifest": merkle.ORACLE}

"""WARC: write transactions to archives, read them back, assemble one nested row per capture.

Every page becomes a request, a response (or revisit) and a metadata record; the request and the
metadata name the response in WARC-Concurrent-To. Archives are written with Spark's text writer,
one record per row and the record mark of the format as line end, so they lie where Spark can
read them again. Reading takes whole files (``FILE_RECORDS`` bounds them) and follows
Content-Length, so payloads may hold anything. Assembly joins the three records of a capture by
the identifier of its response.

A null html is an empty payload, a null url has no target. Of rows with equal payloads the one with
the largest page_id is the response, the others revisit it. A repeated page_id is captured each
time (``copy`` counts those of one page_id and payload from 0); a null page_id is kept as null. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import NULL_ID, column, ship
from threadloom.session import scratch_dir, stage

ship(__name__)

FILE_RECORDS = 3000
DATE = "2024-01-01T00:00:00Z"
MARK = "\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """Pages with their key (p, sha, copy), payload digest and, for revisits, the page that is the response."""
    p = F.coalesce(column(pages, "page_id", "long"), F.lit(NULL_ID)).alias("p")
    html = F.coalesce(column(pages, "html", "string"), F.lit("")).alias("html")
    rows = pages.select(p, column(pages, "url", "string").alias("url"), html)
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    copy = F.row_number().over(Window.partitionBy("p", "sha").orderBy("url")) - 1
    payloads = rows.groupBy("p", "sha").agg(F.count("*").alias("n"))
    first = payloads.groupBy("sha").agg(F.max("p").alias("to_p"), F.sum("n").alias("n")).filter("n > 1")
    refers = payloads.select("p", "sha").join(first.select("sha", "to_p"), "sha")
    keyed = rows.withColumn("copy", copy).join(refers, ["p", "sha"], "left")
    itself = (F.col("p") == F.col("to_p")) & (F.col("copy") == 0)
    return keyed.withColumn("to_p", F.when(~itself, F.col("to_p")))


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + MARK + block


def _name(kind: str, p: int, sha: str, copy: int) -> str:
    return f"urn:x-capture:{kind}:{p}:{sha}:{copy}"


def _one_line(text: str) -> str:
    """A header value: line ends would end the header."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def _write(batches):
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            revisit = pd.notna(r.to_p)
            me = _name("response", r.p, r.sha, r.copy)
            target = [("WARC-Target-URI", _one_line(r.url))] if isinstance(r.url, str) else []
            near = [*target, ("WARC-Concurrent-To", f"<{me}>")]
            digest = base64.b32encode(bytes.fromhex(r.sha)).decode()
            head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + MARK
            own = [*target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
            if revisit:
                own.append(("WARC-Refers-To", f"<{_name('response', int(r.to_p), r.sha, 0)}>"))
                own.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
            out.append(_record(
                "request", _name("request", r.p, r.sha, r.copy), [*near, ("Content-Type", "application/http; msgtype=request")],
                "GET / HTTP/1.1" + MARK,
            ))
            out.append(_record("revisit" if revisit else "response", me, own, head + ("" if revisit else r.html)))
            out.append(_record(
                "metadata", _name("metadata", r.p, r.sha, r.copy), [*near, ("Content-Type", "application/warc-fields")],
                f"page-id: {'' if r.p == NULL_ID else r.p}\r\ncopy: {r.copy}\r\n",
            ))
        yield pd.DataFrame({"value": out})


def write(pages: DataFrame, path: str) -> None:
    """Write the archives as gzip files below ``path``."""
    records = plan(pages).mapInPandas(_write, "value string")
    (records.write.option("lineSep", MARK).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS)
     .mode("overwrite").text(path))


RECORD = ("type string, id string, concurrent_to string, refers_to string, target string, digest string, "
          "date string, block binary")


def parse(data: bytes):
    """The records of one archive, as (headers, block), by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _read(batches):
    bare = lambda x: x.strip("<>") if x else None
    for rows in batches:
        for content in rows["content"]:
            out, size = [], 0
            for head, block in parse(gzip.decompress(content)):
                out.append((
                    head["WARC-Type"], bare(head["WARC-Record-ID"]), bare(head.get("WARC-Concurrent-To")),
                    bare(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"),
                    (head.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None, head["WARC-Date"], block,
                ))
                size += len(block)
                if size > 8 << 20:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])


def read(spark, path: str) -> DataFrame:
    """All records of the archives below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(_read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its id, target and the request, response and metadata records.

    Records meet in one shuffle on the response's identifier; a capture that lacks one of the three has null there.
    """
    capture = F.coalesce("concurrent_to", "id").alias("capture")
    rest = F.struct("id", "type", "target", "date", "digest", "refers_to", "block").alias("record")
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type")).alias("kind")
    rows = records.select(capture, kind, rest)
    pick = [F.first(F.when(F.col("kind") == k, F.col("record")), ignorenulls=True).alias(k) for k in ("request", "response", "metadata")]
    return rows.groupBy("capture").agg(*pick)


def payload(block):
    """The body of an HTTP message."""
    return F.expr(f"substring({block}, locate('\\r\\n\\r\\n', decode({block}, 'ISO-8859-1')) + 4)")


def captures(pages: DataFrame) -> DataFrame:
    """Write, read back, assemble; per page the digest columns and the assembled capture's parts."""
    path = scratch_dir(pages.sparkSession, "warc")
    write(pages, path)
    records = read(pages.sparkSession, path)
    body = payload("block")
    records = records.withColumn("bytes", F.when(F.col("type") == "response", F.length(body))).withColumn(
        "seen", F.when(F.col("type") == "response", F.sha1(body))
    )
    meta = F.when(F.col("type") == "metadata", F.decode("block", "UTF-8"))
    slim = records.select(
        "type", "id", "concurrent_to", "refers_to", "target", "digest", "date",
        F.struct("bytes", "seen", F.regexp_extract(meta, r"page-id: (-?\d*)", 1).alias("page"),
                 F.regexp_extract(meta, r"copy: (\d+)", 1).alias("copy")).alias("block"),
    )
    nested = stage(assemble(slim), "captures")
    own = nested.select(F.col("capture").alias("to"), F.col("response.block.bytes").alias("to_bytes")).filter("to_bytes IS NOT NULL")
    revisits = nested.filter("response.type = 'revisit'").select("capture", F.col("response.refers_to").alias("to"))
    told = revisits.join(own, "to").select("capture", "to_bytes")
    out = nested.join(told, "capture", "left")
    referred = F.regexp_extract("response.refers_to", r":(-?\d+):[0-9a-f]+:\d+$", 1).cast("long")
    return out.select(
        F.expr("try_cast(metadata.block.page AS bigint)").alias("page_id"),
        F.coalesce(F.col("response.block.bytes").cast("long"), F.col("to_bytes").cast("long")).alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", F.when(referred != NULL_ID, referred)).alias("refers_to"),
        F.col("response.target").alias("url"), F.col("metadata.block.copy").cast("int").alias("copy"),
        F.col("request").isNotNull().alias("has_request"),
        F.col("response.block.seen").alias("payload_sha1"),
    )



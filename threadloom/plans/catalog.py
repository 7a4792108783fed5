"""Every registered query: a job over the given tables, and its SQL counterpart where there is one.

Inputs are the log-shaped views (``views``), so the work of every query grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.text import NUL, display_time, encode_cwd, excerpt, lstrip, one_line, sha, to_ms, within
from ..functions.tokens import FIELDS, display
from ..operators import belonging, dedupe, diff, format_a, format_b, ids, lineage, names, pairs
from ..operators.render import render
from ..operators.scan import cut_hot, running, sum_before
from ..operators.segment import progress_position, segment_a, segment_b
from ..params import DEFAULT_TEMPLATE, SOURCE_A, Params, Root
from ..session import scratch_dir, stage
from ..sources.archive import archive_files
from ..sources.lines import bad_lines, read_lines
from ..streaming.online import segment_stream
from . import oracles as O
from .incremental import changed_files, vanished_files
from .views import lines_a, lines_b, log_view_c, log_view_e, params_for_views, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- segmentation on plain event streams ----------------------------------------------------

SEG_E = O.LOG_E + """,
s0 AS (
  SELECT f, ts, event_id, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 3 AS VARCHAR) END AS parent,
    CASE et WHEN 'click' THEN 'Q' WHEN 'view' THEN 'A' WHEN 'purchase' THEN 'T'
      WHEN 'error' THEN 'M' ELSE 'P' END AS ka,
    CASE WHEN et = 'click' THEN 'U' WHEN et = 'signup' AND k % 5 = 0 THEN 'R'
      WHEN et = 'signup' THEN 'U' WHEN et = 'error' THEN 'D' ELSE 'X' END AS kb
  FROM le),
s1 AS (
  SELECT *, last_value(CASE WHEN ka IN ('Q', 'A') THEN ka END IGNORE NULLS) OVER w AS prev,
    count(*) FILTER (WHERE ka = 'Q') OVER w AS asked, last_value(kb) OVER w AS prev_b,
    count(*) FILTER (WHERE kb IN ('U', 'R', 'D')) OVER w AS started
  FROM s0 WINDOW w AS (PARTITION BY f ORDER BY ts, event_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, ka = 'Q' AND (asked = 0 OR prev = 'A') AS fresh FROM s1),
s3 AS (
  SELECT *, last_value(CASE WHEN fresh THEN parent END IGNORE NULLS) OVER (
    PARTITION BY f ORDER BY ts, event_id) AS head FROM s2),
s4 AS (
  SELECT *, fresh OR (ka = 'Q' AND parent <> '' AND parent = head) AS opener,
    (kb IN ('U', 'R', 'D') AND started = 0) OR (kb IN ('U', 'R') AND (kb = 'R' OR prev_b = 'X'
      OR (prev_b = 'D' AND started > 1))) AS opener_b
  FROM s3),
s5 AS (
  SELECT *, sum(CASE WHEN opener THEN 1 ELSE 0 END) OVER w AS pair,
    sum(CASE WHEN opener_b THEN 1 ELSE 0 END) OVER w AS pair_b
  FROM s4 WINDOW w AS (PARTITION BY f ORDER BY ts, event_id))
"""


def _stream_e(spark, sf):
    return cut_hot(log_view_e(spark, sf), ["session"], ["ts", "event_id"])


@query("pairs_segment_a", O.with_(SEG_E, """
    SELECT event_id, f AS session, CAST(pair AS BIGINT) AS pair, coalesce(opener, false) AS opener
    FROM s5"""))
def pairs_segment_a(spark, sf):
    df, order = _stream_e(spark, sf)
    return segment_a(df, order, "kind_a").select("event_id", "session", "pair", "opener")


@query("pairs_segment_b", O.with_(SEG_E, """
    SELECT event_id, f AS session, CAST(pair_b AS BIGINT) AS pair,
      coalesce(opener_b, false) AS opener FROM s5"""))
def pairs_segment_b(spark, sf):
    df, order = _stream_e(spark, sf)
    return segment_b(df, order, "kind_b").select("event_id", "session", "pair", "opener")


@query("progress_order", O.with_(SEG_E, """
    SELECT event_id, CAST(pair AS BIGINT) AS pair, ka = 'A' AND nxt IS NULL AS final,
      coalesce(nxt, event_id) AS place
    FROM (SELECT *, CASE WHEN ka = 'A' THEN lead(event_id) OVER (
            PARTITION BY f, pair, ka ORDER BY ts, event_id) END AS nxt FROM s5)
    WHERE pair > 0 AND ka IN ('A', 'T')"""))
def progress_order(spark, sf):
    df, order = _stream_e(spark, sf)
    df = segment_a(df, order, "kind_a")
    df = progress_position(df, order, F.col("kind_a") == "A")
    df = df.where((F.col("pair") > 0) & F.col("kind_a").isin("A", "T"))
    return df.select("event_id", "pair", "final", "place")


# --- conversations as units -----------------------------------------------------------------

def _entries_c(spark, sf) -> DataFrame:
    df, order = cut_hot(log_view_c(spark, sf), ["session"], ["seq"])
    df = segment_a(df, order)
    df = progress_position(df, order, F.col("kind") == "A").where("pair > 0")
    kind = F.col("kind")
    none = F.lit(None).cast("string")
    zero = F.lit(None).cast("bigint")
    return df.withColumns(
        {
            "source": F.lit(SOURCE_A), "file_id": F.col("session"), "side": F.lit(False),
            "role": F.when(kind == "A", "A").when(kind == "Q", "U").otherwise("P"),
            "meta": F.lit(False), "is_assistant": kind == "A", "progress_only": F.lit(False),
            "cwd": F.lit("/w"), "version": F.lit(""), "branch": F.lit(""), "model": none,
            "has_usage": F.lit(False), **{f: zero for f in FIELDS},
            "plain": F.when(kind == "Q", F.col("text")), "a_text": F.when(kind == "A", F.col("text")),
            "text": F.when(kind == "Q", F.regexp_replace("text", r"\s+$", "")),
            "command": none, "body_name": none, "body": none, "replay_part": none, "signature": none,
        }
    )


def _units_c(spark, sf) -> DataFrame:
    units = ids.ordinals(pairs.roll_up(_entries_c(spark, sf)))
    return units.withColumns(
        {
            "session_id": F.col("file_id"), "is_subagent": F.lit(False),
            "ts_ms": F.unix_millis(F.try_to_timestamp("ts_raw")),
            "session_name": F.lit(""), "conv_id": F.substring("file_id", 2, 20).cast("bigint"),
        }
    )


UNIT_OUT = ["session_id", "pair", "q_uuid", "question", "answer"]


@query("pair_rollup", O.with_(O.UNITS_C, """
    SELECT session AS session_id, CAST(pair AS BIGINT) AS pair, q_uuid, ts_raw, question, answer,
      progress_count, array_to_string(keys, ',') AS keys FROM units_c"""))
def pair_rollup(spark, sf):
    return _units_c(spark, sf).select(
        *UNIT_OUT, "ts_raw", "progress_count", F.array_join("fork_keys", ",").alias("keys"))


@query("unanswered_pairs", O.with_(O.UNITS_C, """
    SELECT session AS session_id, CAST(pair AS BIGINT) AS pair, q_uuid FROM units_c
    WHERE answer = ''"""))
def unanswered_pairs(spark, sf):
    return _units_c(spark, sf).where("answer = ''").select("session_id", "pair", "q_uuid")


@query("block_ids", O.with_(O.UNITS_C, """
    SELECT session AS session_id, ordinal, block_id FROM units_c"""))
def block_ids(spark, sf):
    return ids.block_ids(_units_c(spark, sf)).select("session_id", "ordinal", "block_id")


@query("block_id_collisions", O.with_(O.LOG_E, """
    SELECT event_id, 'blockid:' || left(sha256('claude' || chr(0) || 'h' || (event_id % 3) || chr(0)
      || '' || chr(0) || CASE WHEN k % 2 = 0 THEN '' || sha256('q' || (k % 7)) ELSE 'u' || (k % 5) END
      || chr(0) || (row_number() OVER (PARTITION BY event_id % 3, k % 10 = 9
        ORDER BY CASE WHEN k % 2 = 0 THEN '' ELSE 'u' || (k % 5) END, sha256('q' || (k % 7)),
        f || chr(0) || event_id) - 1)), 24) AS block_id
    FROM le"""))
def block_id_collisions(spark, sf):
    """Three sessions and one empty timestamp hold everything: ranks are cut, not gathered."""
    ev = log_view_e(spark, sf)
    k = F.col("k")
    units = ev.select(
        "event_id", F.lit(SOURCE_A).alias("source"),
        F.concat(F.lit("h"), F.col("event_id") % 3).alias("session_id"), F.lit("").alias("ts_raw"),
        (k % 10 == 9).alias("is_subagent"), F.col("session").alias("file_id"),
        F.col("event_id").alias("ordinal"), F.concat(F.lit("q"), k % 7).alias("question"),
        F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("u"), k % 5)).alias("q_uuid"),
    )
    return ids.block_ids(units).select("event_id", "block_id")


@query("timeline_8key", O.with_(O.UNITS_C, """
    SELECT q_uuid, row_number() OVER (ORDER BY ts_raw, session, q_uuid, session, ordinal) - 1 AS ord
    FROM units_c"""))
def timeline_8key(spark, sf):
    return ids.timeline(_units_c(spark, sf)).select("q_uuid", "ord")


@query("timeline_blocks", O.with_(O.UNITS_C, """
    SELECT row_number() OVER (ORDER BY ts_raw, session, q_uuid, ordinal) - 1 AS ord, block_id,
      session AS session_id, ts_raw, question, answer FROM units_c"""))
def timeline_blocks(spark, sf):
    """All question units with stable ids on one timeline."""
    blocks = ids.timeline(ids.block_ids(_units_c(spark, sf)))
    return blocks.select("ord", "block_id", "session_id", "ts_raw", "question", "answer")


@query("timeline_mixed_times", O.with_(O.LOG_E, """
    SELECT event_id, row_number() OVER (ORDER BY k % 5 = 4,
      CASE WHEN k % 5 = 4 THEN NULL ELSE hour END, raw, f, event_id) - 1 AS ord
    FROM (SELECT *, CASE WHEN k % 5 = 4 THEN 'at ' || k
      ELSE strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.000Z') END AS raw,
      date_trunc('hour', ts) AS hour FROM (SELECT f, ts, event_id, k FROM le))"""
    ))
def timeline_mixed_times(spark, sf):
    """Unreadable times sort last by their text; equal times fall back to session and file."""
    ev = log_view_e(spark, sf)
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = F.when(F.col("k") % 5 == 4, F.concat(F.lit("at "), "k")).otherwise(hour)
    units = ev.select(
        "event_id", raw.alias("ts_raw"), F.lit(SOURCE_A).alias("source"),
        F.col("session").alias("session_id"), F.lit("").alias("q_uuid"), F.lit("").alias("file_id"),
        F.col("event_id").alias("ordinal"),
    )
    return ids.timeline(units.withColumn("ts_ms", to_ms(F.col("ts_raw")))).select("event_id", "ord")


# --- family A from JSON lines ---------------------------------------------------------------

def _bare(c: str = "file_id"):
    return F.regexp_replace(c, "^[a-z]+/", "")


def _parsed_a(spark, sf, **changes):
    lines = lines_a(spark, sf)
    params = params_for_views(**changes)
    return stage(format_a.parse_a(lines.df, params), "parsed-a"), lines.order, params


def _entries_a(spark, sf, **changes):
    parsed, order, params = _parsed_a(spark, sf, **changes)
    entries = format_a.entries_a(parsed, order)
    return entries.select(*format_a.ENTRY_COLUMNS, "line_no"), params


@query("entries_a", O.with_(O.LINES_A, """
    SELECT f, side, line_no, CAST(pair AS BIGINT) AS pair, role, final, place,
      CAST(place_tie AS INTEGER) AS place_tie
    FROM entries_a WHERE role IS NOT NULL AND (kind <> 'M' OR joined)"""))
def entries_a(spark, sf):
    entries, _ = _entries_a(spark, sf)
    # An injected message counts only when it hangs on a message of its unit.
    known = entries.where("role = 'U'").groupBy(*pairs.UNIT).agg(
        pairs.accepted(F.sort_array(F.collect_list(F.struct("seq", "uuid", "parent", "meta")))).alias("u")
    ).select(*pairs.UNIT, F.explode(F.transform("u", lambda u: u["seq"])).alias("seq"))
    kept = entries.join(known.withColumn("ok", F.lit(True)), [*pairs.UNIT, "seq"], "left")
    kept = kept.where("ok or role <> 'U'")
    return kept.select(_bare().alias("f"), "side", "line_no", "pair", "role", "final", "place", "place_tie")


A_UNIT_SQL = """
    SELECT f, side, CAST(pair AS BIGINT) AS pair, q_uuid, question, answer, model, cwd, tok_in,
      tok_out, tok_cache_read, progress_count, fork_keys FROM units_a"""


def _a_units_out(units):
    return units.select(
        _bare().alias("f"), "side", "pair", "q_uuid", "question", "answer", "model", "cwd",
        "tok_in", "tok_out", "tok_cache_read", "progress_count",
        F.array_join("fork_keys", ",").alias("fork_keys"))


@query("units_a", O.with_(O.LINES_A, A_UNIT_SQL))
def units_a(spark, sf):
    entries, _ = _entries_a(spark, sf)
    return _a_units_out(pairs.roll_up(entries))


@query("progress_text_a", O.with_(O.LINES_A, """
    SELECT f, side, CAST(pair AS BIGINT) AS pair, progress FROM units_a"""))
def progress_text_a(spark, sf):
    entries, params = _entries_a(spark, sf, template="%Progress%")
    units = pairs.roll_up(entries, progress=True)
    return units.select(_bare().alias("f"), "side", "pair", "progress")


@query("token_totals", O.with_(O.LINES_A, """
    SELECT f, side, CAST(pair AS BIGINT) AS pair, coalesce(
      'in ' || format('{:,}', tok_in) || ', out ' || format('{:,}', tok_out) || ', cache read '
      || format('{:,}', tok_cache_read) || ', cache write 0', '') AS tokens FROM units_a"""))
def token_totals(spark, sf):
    entries, _ = _entries_a(spark, sf)
    units = pairs.roll_up(entries)
    return units.select(_bare().alias("f"), "side", "pair", display().alias("tokens"))


@query("ordinals", O.with_(O.LINES_A, """
    SELECT f, side, CAST(pair AS BIGINT) AS pair, row_number() OVER (
      PARTITION BY f ORDER BY side, pair) - 1 AS ordinal FROM units_a"""))
def ordinals(spark, sf):
    entries, _ = _entries_a(spark, sf)
    units = ids.ordinals(pairs.roll_up(entries))
    return units.select(_bare().alias("f"), "side", "pair", "ordinal")


@query("session_titles", O.with_(O.LOG_E, """
    SELECT f, coalesce(arg_max('title ' || event_id, (ts, event_id))
      FILTER (WHERE et = 'signup' AND k % 4 = 1), '') AS session_name FROM le GROUP BY f"""))
def session_titles(spark, sf):
    parsed, _, _ = _parsed_a(spark, sf)
    return format_a.sessions_a(parsed).select(_bare().alias("f"), "session_name")


@query("corrupt_counts", O.with_(O.LOG_E, """
    SELECT f, count(*) FILTER (WHERE et = 'signup' AND k % 4 = 3) AS bad_lines, count(*) AS lines
    FROM le GROUP BY f"""))
def corrupt_counts(spark, sf):
    parsed, _, _ = _parsed_a(spark, sf)
    return bad_lines(parsed).select(_bare().alias("f"), "bad_lines", "lines")


@query("event_streams", O.with_(O.LINES_A, """
    SELECT f, line_no, CASE WHEN kind IN ('Q', 'T', 'M') THEN 'user' WHEN kind = 'A' THEN 'assistant'
      WHEN kind = 'K' THEN 'attachment' ELSE 'custom-title' END || chr(0)
      || uuid AS event
    FROM a2 WHERE kind IS NOT NULL OR k % 4 = 1"""))
def event_streams(spark, sf):
    parsed, _, _ = _parsed_a(spark, sf)
    return format_a.event_stream_a(parsed).select(_bare().alias("f"), "line_no", "event")


# --- family B from JSON lines ---------------------------------------------------------------

def _context_b(spark, sf):
    lines = lines_b(spark, sf)
    params = params_for_views()
    parsed = stage(format_b.parse_b(lines.df), "parsed-b")
    return stage(format_b.context(parsed, lines.order, params), "ctx"), lines.order, params


@query("context_fill", O.with_(O.LINES_B, """
    SELECT f, line_no, turn, cwd, coalesce(model, '') AS model, CAST(stretch AS BIGINT) AS stretch
    FROM ctx WHERE ev <> 'eof'"""))
def context_fill(spark, sf):
    ctx, _, _ = _context_b(spark, sf)
    return ctx.where("rec <> 'eof'").select(
        _bare().alias("f"), "line_no", "turn", "cwd", F.coalesce("model", F.lit("")).alias("model"),
        "stretch")


@query("usage_delta", O.with_(O.LINES_B, """
    SELECT f, line_no, CAST(u.i AS BIGINT) AS tok_in, CAST(u.o AS BIGINT) AS tok_out
    FROM usage WHERE ev = 'usage'"""))
def usage_delta(spark, sf):
    ctx, _, _ = _context_b(spark, sf)
    use = format_b.usage_delta(F.col("total"), F.col("prev_total"), F.col("last"), F.col("is_sub"))
    return ctx.where("ev = 'usage'").withColumn("u", use).select(
        _bare().alias("f"), "line_no", F.col("u.input_tokens").alias("tok_in"),
        F.col("u.output_tokens").alias("tok_out"))


@query("usage_attach", O.with_(O.LINES_B, """
    SELECT f, at_line, ev = 'usage' AS carrier, CAST(u.i AS BIGINT) AS tok_in FROM emitted
    WHERE u IS NOT NULL"""))
def usage_attach(spark, sf):
    ctx, order, _ = _context_b(spark, sf)
    out = format_b.emit(ctx, order).where("usage is not null")
    return out.select(_bare().alias("f"), "at_line", (F.col("ev") == "usage").alias("carrier"),
                      F.col("usage.input_tokens").alias("tok_in"))


@query("fallback_questions", O.with_(O.LINES_B, """
    SELECT f, line_no, flush.line AS flush_line, flush.turn AS turn, flush.cwd AS cwd, body AS text
    FROM recovered"""))
def fallback_questions(spark, sf):
    ctx, order, _ = _context_b(spark, sf)
    due, _ = format_b.fallback_questions(ctx, order)
    return due.select(_bare().alias("f"), "line_no", F.col("flush.line").alias("flush_line"),
                      F.col("flush.turn").alias("turn"), F.col("flush.cwd").alias("cwd"), "text")


@query("emission_numbers", O.with_(O.LINES_B, """
    SELECT f, at_line, at_tie, uuid FROM numbered"""))
def emission_numbers(spark, sf):
    ctx, order, _ = _context_b(spark, sf)
    numbered, _ = format_b.number(format_b.emit(ctx, order), order)
    return numbered.select(_bare().alias("f"), "at_line", "at_tie", "uuid")


@query("turn_keys", O.with_(O.LINES_B, """
    SELECT f, uuid, turn_key FROM numbered WHERE cls = 'u'"""))
def turn_keys(spark, sf):
    ctx, order, _ = _context_b(spark, sf)
    numbered, place = format_b.number(format_b.emit(ctx, order), order)
    keyed = format_b.turn_keys(numbered, place).where("class = 'u'")
    return keyed.select(_bare().alias("f"), "uuid", "turn_key")


@query("msgid_handover", O.with_(O.LINES_B, """
    SELECT f, uuid, msg_id FROM handed WHERE cls = 'u' AND msg_id IS NOT NULL"""))
def msgid_handover(spark, sf):
    ctx, order, _ = _context_b(spark, sf)
    numbered, place = format_b.number(format_b.emit(ctx, order), order)
    _, items = format_b.fallback_questions(ctx, order)
    users = format_b.hand_over_ids(numbered.where("class = 'u'"), items, place, order)
    return users.where("msg_id is not null").select(_bare().alias("f"), "uuid", "msg_id")


@query("units_b", O.with_(O.LINES_B, """
    SELECT f, CAST(pair AS BIGINT) AS pair, q_uuid, question, answer, model, tok_in, tok_out,
      progress_count, replay_key FROM units_b"""))
def units_b(spark, sf):
    ctx, order, params = _context_b(spark, sf)
    units = pairs.roll_up(format_b.entries_b(ctx, order, params))
    return units.select(
        _bare().alias("f"), "pair", "q_uuid", "question", "answer", "model", "tok_in", "tok_out",
        "progress_count", "replay_key")


@query("session_facts_b", O.with_(O.LINES_B, """
    SELECT f, coalesce(arg_max('S' || (k % 4), line_no) FILTER (WHERE ev = 'meta'), f) AS session_id,
      coalesce(arg_max('/w/' || (k % 3), line_no) FILTER (WHERE ev = 'meta' AND k % 2 = 0), '')
        AS session_cwd FROM b0 GROUP BY f"""))
def session_facts_b(spark, sf):
    ctx, _, _ = _context_b(spark, sf)
    return format_b.sessions_b(ctx).select(_bare().alias("f"), "session_id", "session_cwd")


# --- attribution ----------------------------------------------------------------------------

BELONG = "cwd IN ('/w/t0', '/w/1') OR starts_with(cwd, '/w/t0/')"


def _project():
    return Params(project="/w/t0", extra_cwds=("/w/1",))


@query("prefilter_files", O.with_(O.LINES_B, """
    SELECT f, bool_or(cwd IN ('/w/t0', '/w/1')) AS keep FROM (
      SELECT f, CASE WHEN ev = 'meta' THEN '/w/' || (k % 3) ELSE '/w/t' || (k % 4) END AS cwd
      FROM b0 WHERE ev IN ('meta', 'turn') AND k % 2 = 0) GROUP BY f"""))
def prefilter_files(spark, sf):
    verdicts = belonging.cwd_verdicts(lines_b(spark, sf).df, _project())
    return verdicts.where("cwds > 0").select(_bare().alias("f"), "keep")


@query("belonging_units", O.with_(O.LINES_A, """
    SELECT f, side, CAST(pair AS BIGINT) AS pair FROM units_a
    WHERE cwd = '/w/p1' OR starts_with(cwd, '/w/p1/') OR cwd = '/w/p2'"""))
def belonging_units(spark, sf):
    entries, _ = _entries_a(spark, sf)
    params = Params(project="/w/p1", extra_cwds=("/w/p2",))
    units = pairs.roll_up(entries)
    return units.where(belonging.wanted(F.col("cwd"), params)).select(_bare().alias("f"), "side", "pair")


@query("path_containment", """
    SELECT page_id, p = base OR starts_with(p, base || '/') AS inside FROM (
      SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS p,
        '/' || regexp_extract(url, '^https?://([^/]+/[a-z]+)', 1) AS base FROM pages)""")
def path_containment(spark, sf):
    pages = table(spark, sf, "pages")
    p = F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "")
    base = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/]+/[a-z]+)", 1))
    return pages.select("page_id", within(p, base).alias("inside"))


@query("display_filter_counts", O.with_(O.LINES_A, """
    SELECT CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (WHERE side) AS BIGINT) AS hidden
    FROM units_a"""))
def display_filter_counts(spark, sf):
    entries, _ = _entries_a(spark, sf)
    units = pairs.roll_up(entries).withColumn("is_subagent", F.col("side"))
    shown = belonging.display_filter(units, params_for_views(include_subagents_a=False))
    return shown.agg(F.count(F.lit(1)).alias("units"), F.count_if("hidden").alias("hidden"))


# --- names ----------------------------------------------------------------------------------

def _renames(spark, sf, dated):
    ev, order = cut_hot(log_view_e(spark, sf), ["session"], ["ts", "event_id"])
    ev = running(ev, order, seq=sum_before(F.lit(1).cast("bigint")))
    at = F.floor("value").cast("bigint")
    name = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("n"), "event_id"))
    return ev.select(
        F.col("session").alias("id"), name.alias("name"),
        (at if dated else F.when(F.col("k") % 3 != 0, at)).alias("at"), "seq")


RENAMES = O.LOG_E + """,
r AS (
  SELECT f AS id, CASE WHEN k % 4 = 0 THEN '' ELSE 'n' || event_id END AS name,
    CAST(floor(value) AS BIGINT) AS stamp, k,
    row_number() OVER (PARTITION BY f ORDER BY ts, event_id) - 1 AS seq FROM le)
"""


@query("latest_name", O.with_(RENAMES, """
    SELECT id, arg_max(name, (stamp, seq)) AS name FROM r GROUP BY id"""))
def latest_name(spark, sf):
    return names.latest_names(_renames(spark, sf, dated=True)).select("id", "name")


@query("latest_name_undated", O.with_(RENAMES, """
    SELECT id, arg_max(name, (CASE WHEN k % 3 = 0 THEN -1 ELSE stamp END, seq)) AS name FROM (
      SELECT *, max(CASE WHEN k % 3 = 0 THEN seq END) OVER (PARTITION BY id) AS reset FROM r)
    WHERE seq >= coalesce(reset, -1) GROUP BY id"""))
def latest_name_undated(spark, sf):
    return names.latest_names(_renames(spark, sf, dated=False)).select("id", "name")


@query("name_resolution", O.with_(RENAMES, """
    SELECT s.id, coalesce(nullif(l.name, ''), nullif(w.name, ''), 'embedded ' || s.id) AS session_name
    FROM (SELECT DISTINCT id FROM r) s
    LEFT JOIN (SELECT id, arg_max(name, (stamp, seq)) AS name FROM r WHERE k % 2 = 0 GROUP BY id) l
      ON l.id = s.id AND CAST(s.id AS BIGINT) % 3 = 0
    LEFT JOIN (SELECT id, arg_max(name, (stamp, seq)) AS name FROM r WHERE k % 5 = 1 GROUP BY id) w
      ON w.id = s.id"""))
def name_resolution(spark, sf):
    """Files under /x/in are owned by that root first, then by /x."""
    ev = log_view_e(spark, sf)
    ev2, order = cut_hot(ev, ["session"], ["ts", "event_id"])
    ev2 = running(ev2, order, seq=sum_before(F.lit(1).cast("bigint")))
    recs = ev2.select(
        F.col("session").alias("id"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("n"), "event_id")).alias("name"),
        F.floor("value").cast("bigint").alias("at"), "seq", "k")
    inner = names.latest_names(recs.where("k % 2 = 0")).withColumn("root_dir", F.lit("/x/in"))
    outer = names.latest_names(recs.where("k % 5 = 1")).withColumn("root_dir", F.lit("/x"))
    index = inner.unionByName(outer)
    sid = F.col("id").cast("bigint")
    sessions = ev.select(F.col("session").alias("id")).distinct().select(
        F.col("id").alias("session_id"),
        F.concat(F.when(sid % 3 == 0, "/x/in/").otherwise("/x/"), "id").alias("file_path"),
        F.concat(F.lit("embedded "), "id").alias("session_name"))
    none = index.select("root_dir", "id", "name").limit(0)
    out = names.resolve(sessions, index, none)
    return out.select(F.col("session_id").alias("id"), "session_name")


# --- copies ---------------------------------------------------------------------------------

@query("fork_dedupe", O.with_(O.UNITS_C, """,
    forked AS (
      SELECT session, conv_id, ordinal, keys, ts_raw, q_uuid FROM units_c
      UNION ALL SELECT 'z' || session, conv_id, ordinal, keys, ts_raw, q_uuid FROM units_c
        WHERE ordinal < 2)
    SELECT session AS session_id, ordinal, starts_with(session, 'z') AS removed FROM forked"""
    .replace(",\n    forked", "\n    , forked", 1)))
def fork_dedupe(spark, sf):
    units = _units_c(spark, sf).select(
        "session_id", "file_id", "ordinal", "fork_keys", "ts_raw", "ts_ms", "q_uuid", "source")
    z = F.concat(F.lit("z"), "session_id")
    copies = units.where("ordinal < 2").withColumns({"session_id": z, "file_id": z})
    ordered = ids.timeline(units.unionByName(copies))
    return dedupe.fork_dedupe(stage(ordered, "ordered")).select("session_id", "ordinal", "removed")


@query("fork_dedupe_chains", "WITH RECURSIVE " + O.LOG_E.strip() + """,
    u AS (SELECT f, event_id AS ord,
        CASE WHEN k % 6 <> 0 THEN [k % 7, (k + 1) % 7] ELSE []::BIGINT[] END AS keys,
        row_number() OVER (PARTITION BY f ORDER BY event_id) AS n FROM le),
    r AS (
      SELECT f, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS ord, false AS removed FROM u GROUP BY f
      UNION ALL
      SELECT u.f, u.n, CASE WHEN list_has_any(r.taken, u.keys) THEN r.taken ELSE list_concat(r.taken, u.keys) END,
        u.ord, list_has_any(r.taken, u.keys)
      FROM r JOIN u ON u.f = r.f AND u.n = r.n + 1)
    SELECT ord, removed FROM r WHERE n > 0""")
def fork_dedupe_chains(spark, sf):
    """Ids chain units over long stretches, so whether one goes depends on many before it."""
    ev = log_view_e(spark, sf)
    k = F.col("k")
    keys = F.array_distinct(F.array(
        F.concat("session", F.lit(":"), k % 7), F.concat("session", F.lit(":"), (k + 1) % 7)))
    units = ev.select(F.col("event_id").alias("ord"), F.when(k % 6 != 0, keys).otherwise(
        F.array().cast("array<string>")).alias("fork_keys"))
    return dedupe.fork_dedupe(units).select("ord", "removed")


def _snapshots(spark, sf):
    """Each conversation logged twice under one session id: an early snapshot and the whole log.
    The early one lacks the last turn, and with it an answer."""
    view = log_view_c(spark, sf).where("kind <> 'M'")
    last = view.groupBy("conv_id").agg(F.max("seq").alias("_last"))
    old = view.join(last, "conv_id").where("seq < _last").drop("_last")
    both = old.withColumn("file_id", F.concat(F.lit("old/"), "session")).unionByName(
        view.withColumn("file_id", F.concat(F.lit("new/"), "session")))
    df, order = cut_hot(both, ["file_id"], ["seq"])
    df = segment_a(df, order).where("pair > 0")
    units = df.groupBy("file_id", "session", "conv_id", "pair").agg(
        F.min_by("uuid", F.when(F.col("kind") == "Q", F.col("seq"))).alias("q_uuid"),
        F.min_by("ts", F.when(F.col("kind") == "Q", F.col("seq"))).alias("ts_raw"),
        F.min_by("text", F.when(F.col("kind") == "Q", F.col("seq"))).alias("question"),
        F.coalesce(F.max_by("text", F.when(F.col("kind") == "A", F.col("seq"))), F.lit("")).alias("answer"),
    ).withColumns({
        "source": F.lit(SOURCE_A), "session_id": F.col("session"), "ordinal": F.col("pair") - 1,
        "ts_ms": F.unix_millis(F.try_to_timestamp("ts_raw")), "is_subagent": F.lit(False)})
    events = both.select("file_id", F.col("seq").alias("line_no"), F.concat("kind", F.lit(NUL), "uuid").alias("event"))
    return units, both, events


@query("logical_dedupe", O.with_(O.LOG_C, """
    , v AS (SELECT *, max(seq) OVER (PARTITION BY conv_id) AS last FROM lc WHERE kind <> 'M'),
    b AS (SELECT *, 'old/' || session AS file_id FROM v WHERE seq < last
          UNION ALL SELECT *, 'new/' || session FROM v),
    c1 AS (
      SELECT *, last_value(kind) OVER w AS prev, count(*) FILTER (WHERE kind = 'Q') OVER w AS asked
      FROM b WINDOW w AS (PARTITION BY file_id ORDER BY seq
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c2 AS (
      SELECT *, sum(CASE WHEN kind = 'Q' AND (asked = 0 OR prev = 'A') THEN 1 ELSE 0 END) OVER (
        PARTITION BY file_id ORDER BY seq) AS pair FROM c1),
    u AS (
      SELECT file_id, session, pair, count(*) FILTER (WHERE kind = 'A') > 0 AS answered,
        arg_min(text, seq) FILTER (WHERE kind = 'Q') AS question,
        min(ts) FILTER (WHERE kind = 'Q') AS ts FROM c2
      WHERE pair > 0 GROUP BY file_id, session, pair),
    -- Files sort new before old, so the whole log's unit comes first and the snapshot's goes.
    d AS (SELECT *, count(*) OVER (PARTITION BY session, question, ts) AS n FROM u)
    SELECT file_id, CAST(pair AS BIGINT) AS pair,
      CASE WHEN n = 2 AND starts_with(file_id, 'old/') THEN 'removed' ELSE 'kept' END AS verdict
    FROM d"""))
def logical_dedupe(spark, sf):
    units, lines, events = _snapshots(spark, sf)
    ordered = stage(ids.timeline(units), "ordered")
    hashes = dedupe.content_hashes(lines.select(
        "file_id", F.col("seq").alias("line_no"), *dedupe.line_hashes(F.col("text"))))
    events, order = cut_hot(events, ["file_id"], ["line_no"])
    prefixes = stage(dedupe.stream_prefixes(events, order), "prefixes")
    judged = dedupe.logical_dedupe(ordered, stage(hashes, "hashes"), prefixes)
    return judged.select("file_id", "pair", "verdict")


@query("prefix_streams", O.with_(O.LOG_C, """
    , v AS (SELECT *, max(seq) OVER (PARTITION BY conv_id) AS last FROM lc WHERE kind <> 'M'),
    a AS (SELECT session, list(kind || uuid ORDER BY seq) AS s FROM v WHERE seq < last GROUP BY session),
    b AS (SELECT session, list(kind || CASE WHEN conv_id % 3 = 0 AND seq = 1 THEN 'other' ELSE uuid END
        ORDER BY seq) AS s FROM v GROUP BY session)
    SELECT a.session AS session_id, len(a.s) < len(b.s) AND a.s = b.s[1:len(a.s)] AS is_prefix
    FROM a JOIN b USING (session)"""))
def prefix_streams(spark, sf):
    """Is the early snapshot's event stream a strict prefix of the whole one? Hashes decide."""
    view = log_view_c(spark, sf).where("kind <> 'M'")
    last = view.groupBy("conv_id").agg(F.max("seq").alias("_last"))
    old = view.join(last, "conv_id").where("seq < _last")
    changed = F.when((F.col("conv_id") % 3 == 0) & (F.col("seq") == 1), "other").otherwise(F.col("uuid"))

    def stream(df, prefix, uuid):
        ev = df.select(F.concat(F.lit(prefix), "session").alias("file_id"),
                       F.col("seq").alias("line_no"), F.concat("kind", uuid).alias("event"))
        ev, order = cut_hot(ev, ["file_id"], ["line_no"])
        return dedupe.stream_prefixes(ev, order)

    a = stream(old, "", F.col("uuid")).groupBy(F.col("file_id").alias("session_id")).agg(
        F.max("n").alias("n"), F.max_by("hash", "n").alias("hash"))
    b = stream(view, "", changed).select(F.col("file_id").alias("session_id"), "n", F.col("hash").alias("h2"))
    total = view.groupBy(F.col("session").alias("session_id")).agg(F.count(F.lit(1)).alias("total"))
    j = a.join(b, ["session_id", "n"], "left").join(total, "session_id")
    ok = (F.col("n") < F.col("total")) & F.coalesce(F.col("hash") == F.col("h2"), F.lit(False))
    return j.select("session_id", ok.alias("is_prefix"))


@query("content_hash_groups", """
    SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(DISTINCT body) AS BIGINT) AS contents FROM (
      SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents
      GROUP BY source, doc_id % 2)""")
def content_hash_groups(spark, sf):
    docs = table(spark, sf, "documents").withColumn("file_id", F.concat("source", F.lit("/"), F.col("doc_id") % 2))
    docs, order = cut_hot(docs, ["file_id"], ["doc_id"])
    docs = running(docs, order, line_no=sum_before(F.lit(1).cast("bigint")))
    h = dedupe.content_hashes(docs.select("file_id", "line_no", *dedupe.line_hashes(F.col("text"))))
    return h.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("file_hash").alias("contents"))


# --- lineage --------------------------------------------------------------------------------

def _threads(spark, sf):
    """Customers as threads: every one but each tenth was spawned by the customer at half its key."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    up = F.floor(key / 2).cast("bigint")
    is_sub = (key % 10 != 0) & (up > 0)
    return c.select(
        F.concat(F.lit("f"), key).alias("file_id"), F.lit(0).alias("root_rank"),
        key.cast("string").alias("thread_id"),
        F.when(is_sub, up.cast("string")).otherwise("").alias("parent_thread"),
        F.when(is_sub, F.lit("10")).otherwise(key.cast("string")).alias("lineage_id"),
        is_sub.alias("is_sub"))


@query("ancestor_closure", """
    WITH RECURSIVE t AS (
      SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 AND c_custkey // 2 > 0
        THEN c_custkey // 2 END AS up FROM customer),
    walk AS (
      SELECT id, 0 AS step, up AS anc FROM t WHERE up IN (SELECT id FROM t)
      UNION ALL
      SELECT w.id, w.step + 1, t.up FROM walk w JOIN t ON t.id = w.anc
      WHERE t.up IS NOT NULL AND t.up IN (SELECT id FROM t))
    SELECT 'f' || id AS file_id, step, 'f' || anc AS ancestor FROM walk
    UNION ALL
    SELECT 'f' || id, (SELECT count(*) FROM walk w WHERE w.id = t.id), 'f10' FROM t WHERE up IS NOT NULL
      AND 10 IN (SELECT id FROM t) AND NOT EXISTS (SELECT 1 FROM walk w WHERE w.id = t.id AND w.anc = 10)
      AND id <> 10""")
def ancestor_closure(spark, sf):
    return lineage.ancestor_closure(_threads(spark, sf)).select("file_id", "step", "ancestor")


def _replayed(spark, sf):
    """Conversations as parents; two children each replay the first two units, and add their own."""
    base = _units_c(spark, sf).select(
        "conv_id", "pair", "ordinal", "question", "answer", *FIELDS, "progress_count")
    key = sha(F.concat_ws(":", "conv_id", "pair"))
    cid = F.col("conv_id")
    parent = base.withColumn("file_id", F.concat(F.lit("p"), "conv_id"))
    # Every third conversation was still unanswered when it was logged.
    parent = parent.withColumn("answer", F.when(cid % 3 == 0, "").otherwise(F.col("answer")))
    copies = [
        base.where("ordinal < 2").withColumn("file_id", F.concat(F.lit(n), "conv_id")).withColumn(
            "answer", F.when((cid % 5 == 0) & (F.col("answer") != ""), "else").otherwise(F.col("answer")))
        for n in ("x", "y")]
    units = parent.unionByName(copies[0]).unionByName(copies[1]).withColumns({
        "replay_key": key, "replay_hash": sha(F.col("question")), "source": F.lit("codex"),
        "tok_in": F.length("file_id").cast("bigint") + F.when(F.col("file_id").startswith("y"), 7).otherwise(0)})
    files = units.select("file_id", "conv_id").distinct()
    child = ~F.col("file_id").startswith("p")
    sessions = files.select(
        "file_id", F.lit(0).alias("root_rank"), F.col("file_id").alias("thread_id"),
        F.when(child, F.concat(F.lit("p"), "conv_id")).otherwise("").alias("parent_thread"),
        F.concat(F.lit("p"), "conv_id").alias("lineage_id"), child.alias("is_sub"))
    return units, sessions


def _reduced(spark, sf):
    units, sessions = _replayed(spark, sf)
    units = stage(units, "replayed")
    given = units.where("answer <> ''").select("file_id", "pair", sha(F.col("answer")).alias("hash"))
    return lineage.remove_inherited(units, sessions, _no_signatures, given)


def _no_signatures(units):
    return units.select("file_id", "pair", F.array().cast("array<string>").alias("signature"))


REPLAYED = O.UNITS_C + """,
p AS (SELECT conv_id, pair, ordinal, question, answer,
        CASE WHEN conv_id % 3 = 0 THEN '' ELSE answer END AS p_answer,
        CASE WHEN conv_id % 5 = 0 AND answer <> '' THEN 'else' ELSE answer END AS c_answer
      FROM units_c),
-- The copies carry equal answers, so they share one verdict.
j AS (SELECT *, ordinal < 2 AND (c_answer = '' OR c_answer = p_answer OR p_answer = '') AS absorbed
      FROM p)
"""


@query("replay_match", O.with_(REPLAYED, """
    SELECT n.name || conv_id AS file_id, CAST(pair AS BIGINT) AS pair, 'p' || conv_id AS target_file,
      CAST(pair AS BIGINT) AS target_pair
    FROM p, (VALUES ('x'), ('y')) AS n(name) WHERE ordinal < 2"""))
def replay_match(spark, sf):
    units, sessions = _replayed(spark, sf)
    units = stage(units, "replayed")
    closure = lineage.ancestor_closure(sessions)
    children = units.where(~F.col("file_id").startswith("p"))
    out = lineage.replay_matches(children, closure, units)
    return out.select("file_id", "pair", "target_file", "target_pair")


@query("inherited_removed", O.with_(REPLAYED, """
    SELECT n.name || conv_id AS file_id, CAST(pair AS BIGINT) AS pair
    FROM j, (VALUES ('x'), ('y')) AS n(name)
    WHERE absorbed OR (ordinal < 2 AND name = 'y')"""))
def inherited_removed(spark, sf):
    """Absorbed copies go; of two kept copies with one answer the second goes as well."""
    return _reduced(spark, sf).removed.select("file_id", "pair")


@query("inherited_survivors", O.with_(REPLAYED, """
    SELECT 'p' || conv_id AS file_id, CAST(pair AS BIGINT) AS pair,
      CASE WHEN absorbed AND p_answer = '' THEN c_answer ELSE p_answer END AS answer,
      CAST(length('p' || conv_id) + CASE WHEN absorbed THEN 7 ELSE 0 END AS BIGINT) AS tok_in FROM j
    UNION ALL
    SELECT 'x' || conv_id, CAST(pair AS BIGINT), c_answer, CAST(length('p' || conv_id) + 7 AS BIGINT)
    FROM j WHERE ordinal < 2 AND NOT absorbed"""))
def inherited_survivors(spark, sf):
    out = _reduced(spark, sf).units
    return out.select("file_id", "pair", "answer", "tok_in")


@query("sibling_conflicts", O.with_(REPLAYED, """
    SELECT 'x' || conv_id AS file_id, CAST(pair AS BIGINT) AS pair, 'answer' AS reason
    FROM j WHERE ordinal < 2 AND NOT absorbed"""))
def sibling_conflicts(spark, sf):
    out = _reduced(spark, sf).conflicts
    return out.select("file_id", "pair", "reason")


@query("progress_containment", O.with_(O.LOG_E, """
    , s AS (SELECT f, count(*) AS n, count(*) FILTER (WHERE k % 3 = 0) AS m FROM le GROUP BY f)
    SELECT f, CASE WHEN CAST(f AS BIGINT) % 3 = 0 THEN 'target'
      WHEN CAST(f AS BIGINT) % 3 = 1 AND m < n THEN 'divergent' ELSE 'source' END AS verdict FROM s"""))
def progress_containment(spark, sf):
    """A user's stream against a copy of it: a part in order is covered, a part with a foreign
    record diverges, the whole with a further record covers the stream."""
    ev = log_view_e(spark, sf)
    row = F.struct("ts", "event_id", "kind_a")

    def ordered(rows):
        return F.transform(F.sort_array(F.collect_list(rows)), lambda x: x["kind_a"])

    s = ev.groupBy(F.col("session").alias("f")).agg(
        ordered(row).alias("t"), ordered(F.when(F.col("k") % 3 == 0, row)).alias("sub"))
    case = F.col("f").cast("bigint") % 3
    copy = (F.when(case == 0, F.col("sub")).when(case == 1, F.array_append("sub", F.lit("Z")))
            .otherwise(F.array_append("t", F.lit("Z"))))
    s = s.withColumn("s", copy)
    verdict = lineage.progress_verdict(F.size("t"), F.col("t"), F.size("s"), F.col("s"))
    return s.select("f", verdict.alias("verdict"))


# --- rendering and snapshots ----------------------------------------------------------------

@query("tool_summary", """
    SELECT doc_id, '[Tool: ' || lang || ' ' || CASE WHEN length(text) > 80 THEN left(text, 80) || '...'
      ELSE text END || ']' AS line FROM documents""")
def tool_summary(spark, sf):
    docs = table(spark, sf, "documents")
    block = F.try_parse_json(F.to_json(F.struct(
        F.col("lang").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))))
    return docs.withColumn("b", block).select("doc_id", B.tool_use_line(F.col("b"), False).alias("line"))


@query("tool_result_line", """
    SELECT doc_id, '[ToolResult: ' || left(split_part(text, chr(10), 1), 80)
      || CASE WHEN length(text) > length(left(split_part(text, chr(10), 1), 80)) THEN '...' ELSE '' END
      || ']' AS line FROM documents""")
def tool_result_line(spark, sf):
    docs = table(spark, sf, "documents")
    block = F.try_parse_json(F.to_json(F.struct(F.array(F.struct(F.col("text"))).alias("content"))))
    return docs.withColumn("b", block).select("doc_id", B.tool_result_line(F.col("b"), False).alias("line"))


@query("user_text", """
    SELECT doc_id, rtrim(text || chr(10) || '[Image]' || chr(10) || '[' || lang || ']' || chr(10)
      || text, ' ' || chr(10) || chr(9) || chr(13)) AS shown FROM documents""")
def user_text(spark, sf):
    docs = table(spark, sf, "documents")
    none = F.lit(None).cast("string")

    def block(kind, text=none):
        return F.struct(kind.alias("type"), text.alias("text"))

    content = F.try_parse_json(F.to_json(F.array(
        block(F.lit("text"), F.col("text")), block(F.lit("image")), block(F.col("lang")),
        block(F.lit("text"), F.col("text")))))
    return docs.withColumn("c", content).select("doc_id", B.user_text(F.col("c")).alias("shown"))


@query("render_blocks", O.with_(O.UNITS_C, """
    SELECT block_id, '<!-- ' || block_id || ' -->' || chr(10) || '### ClaudeCode, '
      || strftime(strptime(ts_raw, '%Y-%m-%dT%H:%M:%S.000Z'), '%Y/%m/%d %a %H:%M:%S') || chr(10) || chr(10)
      || replace(replace(question, '-->', '-- >'), '<!--', '<! --') || chr(10) || chr(10)
      || '**Reply of ** (session ' || session || ' , branch , folder /w, version , tokens )' || chr(10) || chr(10)
      || replace(replace(answer, '-->', '-- >'), '<!--', '<! --') || chr(10) || chr(10) || '***' || chr(10) AS md
    FROM units_c"""))
def render_blocks(spark, sf):
    units = ids.block_ids(_units_c(spark, sf)).withColumns(
        {"progress": F.lit(""), "progress_full": F.lit("")})
    return render(units, params_for_views(template=DEFAULT_TEMPLATE)).select("block_id", "md")


def _versions(spark, sf):
    """(old, new) snapshots of the rendered conversations. The new one misses every tenth
    conversation and gains the answers of every third."""
    none = F.array().cast("array<string>")
    units = ids.block_ids(_units_c(spark, sf)).withColumn("progress", none)
    cols = ["block_id", "conv_id", "question", "answer", "session_id", "session_name", "ts_raw",
            "ts_ms", "model", "version", "branch", "cwd", "progress", *FIELDS, "source", "q_uuid",
            "file_id", "ordinal"]
    full = stage(units.select(*cols), "version")
    old = full.withColumn("answer", F.when(F.col("conv_id") % 3 == 0, "").otherwise(F.col("answer")))
    new = full.where("conv_id % 10 <> 9").withColumn(
        "answer", F.when((F.col("conv_id") % 10 == 1) & (F.col("answer") != ""), "changed").otherwise(F.col("answer")))
    return old, new


@query("id_loss", O.with_(O.UNITS_C, """
    SELECT block_id FROM units_c WHERE conv_id % 10 = 9"""))
def id_loss(spark, sf):
    old, new = _versions(spark, sf)
    return diff.lost_ids(old, new).select("block_id")


@query("block_diff", O.with_(O.UNITS_C, """
    SELECT block_id, CASE WHEN conv_id % 10 = 9 THEN 'unexplained'
      WHEN conv_id % 3 <> 0 AND conv_id % 10 = 1 AND answer <> '' THEN 'mutated'
      WHEN conv_id % 3 = 0 AND answer <> '' THEN 'enriched' ELSE 'unchanged' END AS class
    FROM units_c"""))
def block_diff(spark, sf):
    old, new = _versions(spark, sf)

    def at(df):
        return df.withColumn("ord", F.struct("ts_raw", "session_id", "ordinal"))

    return diff.classify_blocks(at(old), at(new)).select("block_id", "class")


@query("append_tail", O.with_(O.UNITS_C, """
    , r AS (SELECT block_id, conv_id, row_number() OVER (ORDER BY ts_raw, session, q_uuid) - 1 AS ord
      FROM units_c)
    SELECT block_id, ord FROM r WHERE ord >= (SELECT count(*) FROM r) // 2"""))
def append_tail(spark, sf):
    """The second half of the timeline is what a writer holding the first half has to add."""
    old, _ = _versions(spark, sf)
    ordered = stage(ids.timeline(old), "ordered")
    half = ordered.count() // 2
    return diff.append_tail(ordered.where(F.col("ord") < half), ordered).select("block_id", "ord")


@query("snapshot_outcome", O.with_(O.UNITS_C, """
    , r AS (SELECT row_number() OVER (ORDER BY ts_raw, session, q_uuid) - 1 AS ord FROM units_c)
    SELECT 'append' AS outcome, CAST(count(*) FILTER (WHERE ord >= (SELECT count(*) FROM r) // 2)
      AS BIGINT) AS added FROM r"""))
def snapshot_outcome(spark, sf):
    old, _ = _versions(spark, sf)
    ordered = stage(ids.timeline(old).withColumn("md", F.col("question")), "ordered")
    half = ordered.count() // 2
    return diff.outcome(ordered.where(F.col("ord") < half), ordered)



# --- files, names and text rules ------------------------------------------------------------

def write_logs(spark, sf, lines) -> str:
    """The lines as text files, one per 50 users and 100,000 lines of each; returns the folder."""
    path = scratch_dir(spark, "logs")
    df = lines.df.withColumns({
        "f": _bare("file_id").cast("bigint"),
        "blk": F.floor(F.col("line_no") / 100_000)})
    df = df.withColumn("grp", F.concat_ws("-", F.floor(F.col("f") / 50), F.col("blk")))
    (df.repartition("grp").sortWithinPartitions("grp", "f", "line_no")
     .select("grp", "value").write.partitionBy("grp").text(path))
    return path


@query("file_lines", O.with_(O.LOG_E, """
    SELECT CASE WHEN NOT bad THEN 'e' || event_id END AS uuid, row_number() OVER (PARTITION BY CAST(f AS BIGINT) // 50,
      line // 100000 ORDER BY CAST(f AS BIGINT), ts, event_id) - 1 AS line_no, bad
    FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ts, event_id) - 1 AS line,
      et = 'signup' AND k % 4 = 3 AS bad FROM le)"""))
def file_lines(spark, sf):
    """Written logs read back: file order and line numbers survive splitting."""
    root = Root(write_logs(spark, sf, lines_a(spark, sf)), SOURCE_A, suffix=".txt", tree=True)
    lines = read_lines(spark, [root])
    parsed = stage(format_a.parse_a(lines.df, params_for_views()), "parsed-a")
    return parsed.select(F.when(F.col("ok"), F.col("uuid")).alias("uuid"), "line_no", (~F.col("ok")).alias("bad"))


@query("file_units", O.with_(O.LINES_A, """
    SELECT CAST(sum(n) AS BIGINT) AS questions, CAST(sum(answers) AS BIGINT) AS answers FROM (
      SELECT count(*) FILTER (WHERE kind IN ('Q', 'K')) AS n,
        count(*) FILTER (WHERE kind = 'A') AS answers FROM a2)"""))
def file_units(spark, sf):
    """Files to typed rows without the views' shortcut: discovery, parsing, classification."""
    root = Root(write_logs(spark, sf, lines_a(spark, sf)), SOURCE_A, suffix=".txt", tree=True)
    parsed = format_a.parse_a(read_lines(spark, [root]).df, params_for_views())
    return parsed.agg(F.count_if(F.col("kind").isin("Q", "K")).alias("questions"),
                      F.count_if(F.col("kind") == "A").alias("answers"))


@query("format_detect", O.with_(O.LINES_A, """
    SELECT f, bool_or(kind IN ('Q', 'A', 'T', 'M')) AS is_a, false AS is_b FROM a2 GROUP BY f"""))
def format_detect(spark, sf):
    """Each log is tried as both families."""
    lines = lines_a(spark, sf)
    a = format_a.parse_a(lines.df, params_for_views()).groupBy("file_id").agg(
        F.bool_or("recognised").alias("is_a"))
    b = format_b.parse_b(lines.df).groupBy("file_id").agg(F.bool_or("recognised").alias("is_b"))
    return a.join(b, "file_id").select(_bare().alias("f"), "is_a", "is_b")


@query("nested_dirs", """
    WITH d AS (SELECT c_custkey AS k, '/w/p' || CASE c_custkey % 3 WHEN 0 THEN '/' WHEN 1 THEN '-'
        ELSE 'q/' END || (c_custkey % 50) AS cwd FROM customer),
      e AS (SELECT '/logs/' || regexp_replace(cwd, '[^a-zA-Z0-9]', '-', 'g') AS dir, k, cwd FROM d),
      g AS (SELECT dir, arg_min(cwd, k) AS cwd FROM e WHERE starts_with(dir, '/logs/-w-p-') GROUP BY dir)
    SELECT dir FROM g WHERE starts_with(cwd, '/w/p/')""")
def nested_dirs(spark, sf):
    """/w/p/7 and /w/p-7 share one directory name; the first logged directory decides."""
    key = F.col("c_custkey")
    mid = F.when(key % 3 == 0, "/").when(key % 3 == 1, "-").otherwise("q/")
    df = table(spark, sf, "customer").select(key.alias("file_id"), F.concat(F.lit("/w/p"), mid, key % 50).alias("first_cwd"))
    df = df.withColumn("dir", F.concat(F.lit("/logs/"), encode_cwd(F.col("first_cwd"))))
    return belonging.nested_dirs(df, Params(project="/w/p"))


@query("thread_titles", """
    SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN trim(CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_brand END) <> ''
      THEN trim(p_brand) ELSE trim(p_name) END AS name FROM part
    WHERE p_partkey % 3 <> 0 OR trim(p_name) <> ''""")
def thread_titles(spark, sf):
    part = table(spark, sf, "part")
    return names.title_names(part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_brand")).alias("name"),
        F.col("p_name").alias("title")))


@query("index_merge", O.with_(RENAMES, """
    , o AS (SELECT id, arg_max({'n': name, 'a': stamp, 's': seq}, (stamp, seq)) AS r FROM r
        WHERE k % 2 = 0 GROUP BY id),
      p AS (SELECT id, arg_max({'n': name, 'a': stamp, 's': seq}, (stamp, seq)) AS r FROM r
        WHERE k % 3 = 0 GROUP BY id)
    SELECT id, CASE WHEN o.r IS NULL THEN p.r.n WHEN p.r IS NULL THEN o.r.n
      WHEN o.r.a <> p.r.a THEN CASE WHEN p.r.a > o.r.a THEN p.r.n ELSE o.r.n END
      WHEN p.r.s >= o.r.s THEN p.r.n ELSE o.r.n END AS name FROM o FULL JOIN p USING (id)"""))
def index_merge(spark, sf):
    ev, order = _stream_e(spark, sf)
    ev = running(ev, order, seq=sum_before(F.lit(1).cast("bigint")))
    recs = ev.select(
        F.col("session").alias("id"), "k", "seq", F.floor("value").cast("bigint").alias("at"),
        F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("n"), "event_id")).alias("name"))
    own, parent = names.latest_names(recs.where("k % 2 = 0")), names.latest_names(recs.where("k % 3 = 0"))
    return names.merge_indexes(own, parent).select("id", "name")


@query("noise_filter", """
    SELECT doc_id, regexp_matches(CASE doc_id % 4 WHEN 0 THEN '  <system-reminder>' WHEN 1 THEN
      '<local-command-stdout>' WHEN 2 THEN '<system-reminders>' ELSE '' END || text,
      '^\\s*<(local-command-caveat|local-command-stdout|system-reminder)>') AS noise FROM documents""")
def noise_filter(spark, sf):
    case = F.col("doc_id") % 4
    head = (F.when(case == 0, "  <system-reminder>").when(case == 1, "<local-command-stdout>")
            .when(case == 2, "<system-reminders>").otherwise(""))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", lstrip(F.concat(head, "text")).rlike(format_a.NOISE).alias("noise"))


@query("injected_context", """
    SELECT doc_id, regexp_matches(CASE doc_id % 5 WHEN 0 THEN chr(10) || '<system-x' WHEN 1 THEN
      '<environment_context>' WHEN 2 THEN '<permissions mode=1>' WHEN 3 THEN '<permissionsx>' ELSE '' END
      || text, '^\\s*(<system-|<(environment_context|permissions|user_instructions|codex_internal_context|recommended_plugins)[>/\\s])')
      AS injected FROM documents""")
def injected_context(spark, sf):
    case = F.col("doc_id") % 5
    head = (F.when(case == 0, "\n<system-x").when(case == 1, "<environment_context>")
            .when(case == 2, "<permissions mode=1>").when(case == 3, "<permissionsx>").otherwise(""))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", lstrip(F.concat(head, "text")).rlike(format_b.INJECTED).alias("injected"))


WS_SQL = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


@query("one_line", f"""
    SELECT doc_id, CASE WHEN length(s) > 200 THEN left(s, 200) || '...' ELSE s END AS line,
      CASE WHEN length(s) > 60 THEN left(s, 60) || '…' ELSE s END AS excerpt
    FROM (SELECT doc_id, trim(regexp_replace(text, '{WS_SQL}+', ' ', 'g'), ' ') AS s FROM documents)""")
def one_line_texts(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", one_line(F.col("text")).alias("line"), excerpt(F.col("text")).alias("excerpt"))


@query("datetime_display", O.with_(O.LOG_E, """
    SELECT event_id, CASE WHEN k % 4 = 0 THEN 'Unknown' WHEN k % 4 = 1 THEN 'at <! -- ' || k
      ELSE strftime(date_trunc('second', ts), '%Y/%m/%d %a %H:%M:%S') END AS shown FROM le"""))
def datetime_display(spark, sf):
    ev = log_view_e(spark, sf)
    k = F.col("k")
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("at\n<!-- "), k)).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    ev = ev.select("event_id", raw.alias("raw"))
    return ev.select("event_id", display_time(to_ms(F.col("raw")), F.col("raw")).alias("shown"))


@query("ids_in_text", O.with_(O.UNITS_C, "SELECT block_id, false AS malformed FROM units_c"))
def ids_in_text(spark, sf):
    md = render_blocks(spark, sf).select(F.explode(F.split("md", "\n")).alias("value"))
    return diff.ids_in_text(md).select("block_id", "malformed")


@query("stale_partitions", """
    WITH s AS (SELECT c_custkey AS k, 'f' || c_custkey AS file_path, CASE WHEN c_custkey % 7 = 0 THEN 0
        ELSE 1 END AS units FROM customer WHERE c_custkey % 5 <> 0)
    SELECT 'c' || k AS session_id, file_path FROM s WHERE units = 0
    UNION ALL
    SELECT 'old' || k, file_path FROM s WHERE k % 2 = 0""")
def stale_partitions(spark, sf):
    """Partitions of emptied sessions and of former names; those of unseen sessions stay."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    key, path = F.col("k"), F.concat(F.lit("f"), "k").alias("file_path")
    source = F.lit("codex").alias("source")
    now = F.concat(F.lit("c"), key).alias("session_id")
    old = F.concat(F.lit("old"), key)
    existing = c.select(source, now, path).unionByName(c.select(source, old.alias("session_id"), path))
    seen = c.where("k % 5 <> 0")
    sessions = seen.select(source, now, path, F.when(key % 7 == 0, 0).otherwise(1).alias("units"))
    former = seen.where("k % 2 = 0").select(path, old.alias("former_id"))
    return diff.stale_partitions(existing, sessions, former).select("session_id", "file_path")


@query("archive_plan", """
    WITH f AS (SELECT c_custkey AS k, c_custkey % 40 || '.jsonl' AS rel,
        CASE WHEN c_custkey % 11 = 0 THEN '/keep/' ELSE '/r' || (c_custkey // 40) || '/' END AS dir
      FROM customer),
      g AS (SELECT *, dir || k || '/' || rel AS path FROM f
        WHERE (k % 3 <> 0 OR k % 10 = 0) AND k % 11 <> 0)
    SELECT path AS file_path, CASE WHEN row_number() OVER (PARTITION BY rel ORDER BY path) = 1 THEN rel
      ELSE replace(rel, '.jsonl', '') || '__' || left(sha256(path), 8) || '.jsonl' END AS archive_path
    FROM g""")
def archive_plan(spark, sf):
    """Logs to keep: of belonging sessions and child transcripts, none already in the archive."""
    k = F.col("c_custkey")
    rel = F.concat(k % 40, F.lit(".jsonl"))
    folder = F.when(k % 11 == 0, "/keep/").otherwise(F.concat(F.lit("/r"), F.floor(k / 40), F.lit("/")))
    files = table(spark, sf, "customer").select(
        F.lit(SOURCE_A).alias("source"), k.alias("file_id"), rel.alias("rel_path"),
        F.concat(folder, k, F.lit("/"), rel).alias("file_path"), F.lit(0).alias("root_rank"),
        (k % 10 == 0).alias("subagent_dir"))
    sessions = files.where("file_id % 3 <> 0").select("file_id")
    return archive_files(files, sessions, "/keep").select("file_path", "archive_path")


@query("changed_files", O.with_(O.LOG_E, """
    , m AS (SELECT f, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE k % 50 <> 0) AS BIGINT)
      AS before FROM le GROUP BY f)
    SELECT f FROM m WHERE n <> before OR CAST(f AS BIGINT) % 20 = 0"""))
def changed_files_query(spark, sf):
    """Logs that grew since the last manifest, or are new to it."""
    ev = log_view_e(spark, sf)

    def listing(df):
        return df.groupBy(F.col("session").alias("file_id")).agg(
            F.count(F.lit(1)).alias("size")).withColumns(
            {"mtime": F.lit(0), "root_dir": F.lit("/logs"), "fingerprint": F.lit("p")})

    new, old = listing(ev), listing(ev.where("k % 50 <> 0"))
    old = old.where(F.col("file_id").cast("bigint") % 20 != 0)
    return changed_files(new, old).select(F.col("file_id").alias("f"))


@query("vanished_files", O.with_(O.LOG_E, """
    SELECT DISTINCT f FROM le WHERE CAST(f AS BIGINT) % 20 = 0"""))
def vanished_files_query(spark, sf):
    files = log_view_e(spark, sf).select(F.col("session").alias("file_id")).distinct()
    now = files.where(F.col("file_id").cast("bigint") % 20 != 0)
    return vanished_files(now, files).select(F.col("file_id").alias("f"))


@query("delegate_units", O.with_(O.LOG_E, """
    , s AS (SELECT *, CASE et WHEN 'click' THEN 'U' WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'D'
        ELSE 'R' END ELSE 'X' END AS kb,
      row_number() OVER (PARTITION BY f ORDER BY ts, event_id) AS n FROM le),
    t AS (SELECT *, lag(kb) OVER w AS prev, count(*) FILTER (WHERE kb <> 'X') OVER (
        PARTITION BY f ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started
      FROM s WINDOW w AS (PARTITION BY f ORDER BY n))
    SELECT event_id, (kb <> 'X' AND started = 0) OR kb = 'R' OR (kb = 'U' AND (prev = 'X'
      OR (prev = 'D' AND started > 1))) AS opener FROM t"""))
def delegate_units(spark, sf):
    """Instructions from above open a unit, replies from below do not; read from addresses."""
    ev, order = _stream_e(spark, sf)
    k, kind = F.col("k"), F.col("kind_a")
    up = k % 3 == 0
    author = F.when(up, "/root/a").otherwise("/root")
    recipient = F.when(up, "/root").otherwise("/root/a")
    reply = format_b.is_reply(author, recipient, F.lit(""))
    kb = F.when(kind == "Q", "U").when((kind == "P") & reply, "D").when(kind == "P", "R").otherwise("X")
    return segment_b(ev.withColumn("kb", kb), order, "kb").select("event_id", "opener")


@query("stream_segment", O.with_(SEG_E, """
    SELECT f AS session, event_id AS seq, CAST(pair AS BIGINT) AS pair, coalesce(opener, false) AS opener
    FROM s5"""))
def stream_segment(spark, sf):
    """The segmentation as a stream of slices, the second and third in the wrong order: lines wait for those before them.

    Each slice is one run of the stream, which goes on from the checkpoint. So there are as many micro-batches as slices,
    however many files these have: each micro-batch costs the driver a report of every state partition.
    """
    ev = log_view_e(spark, sf).select(
        "session", F.col("event_id").alias("id"), F.col("kind_a").alias("kind"), "parent", "ts")
    line = F.row_number().over(Window.partitionBy("session").orderBy("ts", "id")) - 1
    ev = stage(ev.withColumn("seq", line.cast("bigint")), "numbered")
    base = scratch_dir(spark, "stream")
    lo, hi = (x or 0 for x in ev.agg(F.min("id"), F.max("id")).first())
    cut = stage(ev.withColumn("part", F.floor((F.col("id") - lo) * 4 / (hi - lo + 1))), "slices")
    for i in (0, 2, 1, 3):
        rows = cut.where(F.col("part") == i).select("session", "seq", "kind", "parent")
        rows.repartition("session").write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        done = (segment_stream(source, first=0).writeStream.format("parquet")
                .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
                .trigger(availableNow=True).start())
        done.awaitTermination()
    out = spark.read.parquet(f"{base}/out").where("NOT late").select("session", "seq", "pair", "opener")
    return out.join(ev.select("session", "seq", "id"), ["session", "seq"]).select(
        "session", F.col("id").alias("seq"), "pair", "opener")


@query("run_metrics", O.with_(O.LINES_A, """
    SELECT f, CAST(count(DISTINCT CASE WHEN pair > 0 AND opener THEN side || ':' || pair END) AS BIGINT)
      AS units FROM a7 GROUP BY f"""))
def run_metrics(spark, sf):
    entries, _ = _entries_a(spark, sf)
    units = pairs.roll_up(entries)
    files = entries.select("file_id").distinct()
    counts = units.groupBy("file_id").agg(F.count(F.lit(1)).alias("units"))
    return files.join(counts, "file_id", "left").select(
        _bare().alias("f"), F.coalesce("units", F.lit(0).cast("bigint")).alias("units"))

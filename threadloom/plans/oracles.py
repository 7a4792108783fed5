"""The registered queries in plain SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

import textwrap

LOG_C = """
lc AS (
  SELECT 's' || conv_id AS session, conv_id, turn AS seq,
    CASE role WHEN 'user' THEN 'Q' WHEN 'assistant' THEN 'A' ELSE 'M' END AS kind,
    left(sha256(conv_id || ':' || turn), 12) AS uuid,
    CASE WHEN turn = 0 THEN '' ELSE left(sha256(conv_id || ':' || (turn - 1)), 12) END AS parent,
    strftime(make_timestamp((1704067200 + (conv_id % 3650) * 86400 + turn * 60) * 1000000),
             '%Y-%m-%dT%H:%M:%S.000Z') AS ts,
    text
  FROM conversations)
"""

# Units of LogView-C. Parents differ along a conversation, so nothing is retyped, and system rows
# come first, so nothing is injected into an open question.
UNITS_C = LOG_C + """,
c1 AS (
  SELECT *, last_value(CASE WHEN kind IN ('Q', 'A') THEN kind END IGNORE NULLS) OVER w AS prev,
    count(*) FILTER (WHERE kind = 'Q') OVER w AS asked
  FROM lc WINDOW w AS (PARTITION BY session ORDER BY seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c2 AS (
  SELECT *, sum(CASE WHEN kind = 'Q' AND (asked = 0 OR prev = 'A') THEN 1 ELSE 0 END) OVER (
    PARTITION BY session ORDER BY seq) AS pair
  FROM c1),
uc AS (
  SELECT session, conv_id, pair,
    arg_min(uuid, seq) FILTER (WHERE kind = 'Q') AS q_uuid,
    min(ts) FILTER (WHERE kind = 'Q') AS ts_raw,
    string_agg(rtrim(text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY seq)
      FILTER (WHERE kind = 'Q') AS question,
    coalesce(arg_max(text, seq) FILTER (WHERE kind = 'A'), '') AS answer,
    greatest(count(*) FILTER (WHERE kind = 'A') - 1, 0) AS progress_count,
    list(uuid ORDER BY seq) FILTER (WHERE kind = 'Q')
      || coalesce([arg_max(uuid, seq) FILTER (WHERE kind = 'A')], []) AS keys
  FROM c2 WHERE pair > 0 GROUP BY session, conv_id, pair),
units_c AS (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY pair) - 1 AS ordinal,
    'blockid:' || left(sha256('claude' || chr(0) || session || chr(0) || ts_raw || chr(0) || q_uuid
      || chr(0) || '0'), 24) AS block_id
  FROM uc)
"""

LOG_E = """
le AS (
  SELECT CAST(user_id AS VARCHAR) AS f, ts, event_id, event_type AS et, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)
"""

LINES_A = LOG_E + """,
a0 AS (
  SELECT *, row_number() OVER w - 1 AS line_no, 'e' || event_id AS uuid,
    CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'p' || (k % 3)
      ELSE coalesce('e' || lag(event_id) OVER w, '') END AS parent,
    k % 10 = 9 AS side,
    CASE et WHEN 'click' THEN 'Q' WHEN 'view' THEN 'A' WHEN 'purchase' THEN 'T'
      WHEN 'error' THEN 'M' ELSE CASE WHEN k % 2 = 0 THEN 'K' END END AS kind
  FROM le WINDOW w AS (PARTITION BY f ORDER BY ts, event_id)),
a1 AS (
  SELECT *, kind = 'M' AND k % 4 >= 2 AND k % 7 <> 0
      AND side = lag(side) OVER (PARTITION BY f ORDER BY line_no) AS link
  FROM a0),
a2 AS (
  SELECT *, coalesce(link, false) AND last_value(
      CASE WHEN NOT coalesce(link, false) THEN coalesce(kind, 'x') END IGNORE NULLS) OVER (
      PARTITION BY f ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      IN ('Q', 'K') AS joined
  FROM a1),
a3 AS (
  SELECT *,
    last_value(CASE WHEN kind IN ('Q', 'K', 'A') THEN kind END IGNORE NULLS) OVER w AS prev,
    count(*) FILTER (WHERE kind IN ('Q', 'K')) OVER w AS asked
  FROM a2 WHERE kind IS NOT NULL
  WINDOW w AS (PARTITION BY f, side ORDER BY line_no
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a4 AS (SELECT *, kind IN ('Q', 'K') AND (asked = 0 OR coalesce(prev = 'A', false)) AS fresh FROM a3),
a5 AS (
  SELECT *, last_value(CASE WHEN fresh THEN parent END IGNORE NULLS) OVER (
    PARTITION BY f, side ORDER BY line_no) AS head
  FROM a4),
a6 AS (
  SELECT *, fresh OR (kind = 'Q' AND parent <> '' AND coalesce(parent = head, false)) AS opener
  FROM a5),
a7 AS (
  SELECT *, sum(CASE WHEN opener THEN 1 ELSE 0 END) OVER (PARTITION BY f, side ORDER BY line_no)
    AS pair FROM a6),
a8 AS (
  SELECT *, CASE WHEN kind = 'A' THEN lead(line_no) OVER (
      PARTITION BY f, side, pair, kind ORDER BY line_no) END AS next_a
  FROM a7 WHERE pair > 0),
entries_a AS (
  SELECT *, kind = 'A' AND next_a IS NULL AS final,
    coalesce(next_a, line_no) AS place, CASE WHEN next_a IS NULL THEN 1 ELSE 0 END AS place_tie,
    CASE WHEN kind IN ('Q', 'K') OR joined THEN 'U' WHEN kind = 'A' THEN 'A'
      WHEN kind = 'T' THEN 'P' END AS role
  FROM a8),
units_a AS (
  SELECT f, side, pair,
    arg_min(uuid, line_no) FILTER (WHERE role = 'U') AS q_uuid,
    string_agg(CASE kind WHEN 'Q' THEN 'q' WHEN 'K' THEN 'k' ELSE 'm' END || event_id,
      chr(10) || chr(10) ORDER BY line_no) FILTER (WHERE role = 'U') AS question,
    coalesce(arg_max('a' || event_id, line_no) FILTER (WHERE kind = 'A' AND k % 3 <> 0), '')
      AS answer,
    coalesce(arg_max('m' || (k % 3), line_no) FILTER (WHERE kind = 'A' AND k % 6 <> 0), '') AS model,
    coalesce(
      arg_min('/w/p' || (k % 3), line_no) FILTER (WHERE role = 'U' AND kind <> 'K' AND k % 2 = 0),
      arg_min('/w/p' || (k % 3), line_no) FILTER (WHERE final AND k % 2 = 0),
      arg_min('/w/p' || (k % 3), place * 2 + place_tie)
        FILTER (WHERE NOT final AND role IN ('A', 'P') AND k % 2 = 0), '') AS cwd,
    CAST(sum(k) FILTER (WHERE kind = 'A' AND k % 5 <> 0) AS BIGINT) AS tok_in,
    CAST(sum(1) FILTER (WHERE kind = 'A' AND k % 5 <> 0) AS BIGINT) AS tok_out,
    CAST(sum(k % 9) FILTER (WHERE kind = 'A' AND k % 5 <> 0) AS BIGINT) AS tok_cache_read,
    count(*) FILTER (WHERE NOT final AND role IN ('A', 'P')) AS progress_count,
    string_agg(CASE WHEN role = 'U' OR final THEN uuid END, ',' ORDER BY line_no) AS fork_keys,
    coalesce(string_agg(CASE
      WHEN kind = 'T' THEN '- [ToolResult: r' || event_id || '...]'
      WHEN kind = 'A' AND NOT final AND k % 3 <> 0 THEN '- (assistant) a' || event_id
      WHEN kind = 'A' AND k % 3 = 0 THEN '- [Tool: Read /f/' || k || ']' END,
      chr(10) ORDER BY CASE WHEN final THEN 1 ELSE 0 END, place, place_tie, line_no), '') AS progress
  FROM entries_a WHERE role IS NOT NULL GROUP BY f, side, pair)
"""

# Family-B rules, step by step. One eof row per file closes waiting questions.
LINES_B = LOG_E + """,
b0 AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY ts, event_id) - 1 AS line_no,
    CASE WHEN et = 'click' AND k % 4 = 0 THEN 'fallback' WHEN et = 'click' THEN 'user'
      WHEN et = 'view' THEN 'agent' WHEN et = 'purchase' THEN 'usage'
      WHEN et = 'error' AND k % 2 = 0 THEN 'start' WHEN et = 'error' THEN 'complete'
      WHEN k % 5 = 0 THEN 'meta' WHEN k % 5 = 1 THEN 'turn' WHEN k % 5 = 2 THEN 'call'
      WHEN k % 5 = 3 THEN 'output' ELSE 'reason' END AS ev
  FROM le
  UNION ALL
  SELECT f, NULL, NULL, NULL, NULL, NULL, 9223372036854775807, 'eof' FROM le GROUP BY f),
b1 AS (
  SELECT *,
    CASE ev WHEN 'user' THEN 'f' || (k % 3) WHEN 'fallback' THEN 'f' || (k % 3)
      WHEN 'agent' THEN 'a' || (k % 3) WHEN 'complete' THEN 'a' || (k % 3)
      WHEN 'reason' THEN 'h' || event_id WHEN 'output' THEN 'o' || event_id END AS body,
    last_value(CASE WHEN ev = 'meta' AND k % 2 = 0 THEN '/w/' || (k % 3) END IGNORE NULLS) OVER w
      AS session_cwd,
    coalesce(last_value(CASE WHEN ev IN ('turn', 'start') THEN 't' || (k % 5) END IGNORE NULLS)
      OVER w, '') AS turn,
    coalesce(last_value(CASE WHEN ev IN ('turn', 'start') THEN 't' || (k % 5) END IGNORE NULLS)
      OVER x, '') AS turn_before,
    last_value(CASE WHEN ev = 'turn' THEN 'm' || (k % 2) END IGNORE NULLS) OVER w AS model,
    sum(CASE WHEN ev = 'start' THEN 1 ELSE 0 END) OVER w AS stretch,
    last_value(CASE WHEN ev = 'usage' AND k % 6 <> 0 THEN
      {'i': CAST(floor(value) AS BIGINT), 'o': k} END IGNORE NULLS) OVER x AS prev_total
  FROM b0
  WINDOW w AS (PARTITION BY f ORDER BY line_no),
    x AS (PARTITION BY f ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ctx AS (
  SELECT *, coalesce(nullif(last_value(CASE WHEN ev = 'meta' THEN coalesce(session_cwd, '')
      WHEN ev = 'turn' AND k % 2 = 0 THEN '/w/t' || (k % 4) END IGNORE NULLS) OVER (
      PARTITION BY f ORDER BY line_no), ''), session_cwd, '') AS cwd
  FROM b1),
usage AS (
  SELECT *, CASE
    WHEN ev <> 'usage' THEN NULL
    WHEN k % 6 = 0 THEN {'i': k, 'o': 1}
    WHEN prev_total IS NULL THEN {'i': CAST(floor(value) AS BIGINT), 'o': k}
    WHEN floor(value) < prev_total.i OR k < prev_total.o THEN {'i': k, 'o': 1}
    WHEN floor(value) > prev_total.i OR k > prev_total.o THEN
      {'i': CAST(floor(value) AS BIGINT) - prev_total.i, 'o': k - prev_total.o} END AS u
  FROM ctx),
spoken AS (
  SELECT *, coalesce(ev IN ('agent', 'reason', 'call') OR (ev = 'complete' AND coalesce(
      last_value(CASE WHEN ev IN ('agent', 'complete') THEN body END IGNORE NULLS) OVER (
        PARTITION BY f, turn ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      <> body, true)), false) AS asst
  FROM usage),
marks AS (
  SELECT f, line_no, lag(asst) OVER w AS prev_asst, lead(asst) OVER w AS next_asst,
    lead(u) OVER w AS next_u
  FROM spoken WHERE asst OR u IS NOT NULL WINDOW w AS (PARTITION BY f, turn ORDER BY line_no)),
credited AS (
  SELECT s.*, u IS NOT NULL AND NOT coalesce(prev_asst, false) AS carrier,
    CASE WHEN asst AND NOT next_asst THEN next_u END AS attached
  FROM spoken s LEFT JOIN marks m USING (f, line_no)),
flushes AS (
  SELECT *, lead(CASE WHEN ev IN ('agent', 'complete', 'start', 'reason', 'call', 'eof') THEN
      {'line': line_no, 'cwd': cwd, 'turn': CASE WHEN ev = 'start' THEN turn_before ELSE turn END}
      END IGNORE NULLS) OVER (PARTITION BY f ORDER BY line_no) AS flush
  FROM ctx),
waiting AS (
  SELECT * FROM (
    SELECT *, CASE WHEN k % 8 = 0 THEN 'msg_' || (k % 10) END AS msg_id,
      row_number() OVER (PARTITION BY f, stretch, k % 8 = 0, k % 10 ORDER BY line_no) AS nth
    FROM flushes WHERE ev = 'fallback')
  WHERE msg_id IS NULL OR nth = 1),
recovered AS (
  SELECT w.* FROM waiting w
  JOIN (SELECT f, stretch, min(flush.line) AS first_flush FROM waiting GROUP BY ALL)
    USING (f, stretch)
  LEFT JOIN (SELECT f, stretch, min(line_no) AS first_user FROM ctx WHERE ev = 'user' GROUP BY ALL)
    USING (f, stretch)
  WHERE w.flush.line = first_flush AND NOT coalesce(first_user < w.flush.line, false)),
emitted AS (
  SELECT f, line_no AS at_line, 1 AS at_phase, 0 AS at_tie,
    CASE WHEN ev = 'user' THEN 'u' WHEN asst OR carrier THEN 'a' ELSE 'r' END AS cls,
    ev, turn, cwd, model, body, event_id, k, CASE WHEN carrier THEN u ELSE attached END AS u
  FROM credited WHERE ev IN ('user', 'output') OR asst OR carrier
  UNION ALL
  SELECT f, flush.line, 0, line_no, 'u', ev, flush.turn, flush.cwd, NULL, body, event_id, k, NULL
  FROM recovered),
numbered AS (
  SELECT *, cls || '-' || seq AS uuid,
    CASE WHEN cls = 'u' AND turn <> '' THEN turn || '#' || (row_number() OVER (
      PARTITION BY f, turn, cls ORDER BY seq) - 1) END AS turn_key,
    row_number() OVER (PARTITION BY f, turn, body, cls ORDER BY seq) AS kth
  FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY at_line, at_phase, at_tie) - 1 AS seq
        FROM emitted)),
items AS (
  SELECT f, turn, body, msg_id,
    row_number() OVER (PARTITION BY f, turn, body ORDER BY line_no) AS kth
  FROM waiting WHERE msg_id IS NOT NULL),
handed AS (
  SELECT n.*, i.msg_id FROM numbered n LEFT JOIN items i
    ON n.cls = 'u' AND i.f = n.f AND i.turn = n.turn AND i.body = n.body AND i.kth = n.kth),
seg0 AS (
  SELECT *, lag(cls) OVER (PARTITION BY f ORDER BY seq) AS prev,
    count(*) FILTER (WHERE cls = 'u') OVER (PARTITION BY f ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked
  FROM handed),
seg AS (
  SELECT *, sum(CASE WHEN cls = 'u' AND (asked = 0 OR prev <> 'u') THEN 1 ELSE 0 END) OVER (
    PARTITION BY f ORDER BY seq) AS pair
  FROM seg0),
entries_b AS (
  SELECT *, CASE WHEN cls = 'u' THEN 'U' WHEN ev IN ('agent', 'complete') AND cls = 'a' THEN 'A'
      ELSE 'P' END AS role,
    ev IN ('agent', 'complete') AND cls = 'a' AS answer
  FROM seg WHERE pair > 0),
placed_b AS (
  SELECT *, CASE WHEN answer THEN lead(seq) OVER (PARTITION BY f, pair, answer ORDER BY seq) END
    AS next_a FROM entries_b),
units_b AS (
  SELECT f, pair, arg_min(uuid, seq) FILTER (WHERE role = 'U') AS q_uuid,
    string_agg(body, chr(10) || chr(10) ORDER BY seq) FILTER (WHERE role = 'U') AS question,
    coalesce(arg_max(body, seq) FILTER (WHERE answer), '') AS answer,
    coalesce(arg_max(model, CASE WHEN answer AND next_a IS NULL THEN 1000000000
        ELSE coalesce(next_a, seq) * 2 + CASE WHEN next_a IS NULL THEN 1 ELSE 0 END END)
      FILTER (WHERE cls = 'a' AND model IS NOT NULL), '') AS model,
    CAST(sum(u.i) AS BIGINT) AS tok_in, CAST(sum(u.o) AS BIGINT) AS tok_out,
    count(*) FILTER (WHERE role = 'P' OR (answer AND next_a IS NOT NULL)) AS progress_count,
    CASE WHEN bool_and(msg_id IS NOT NULL OR turn_key IS NOT NULL) FILTER (WHERE role = 'U') THEN
      sha256(string_agg(coalesce('m:' || msg_id, 't:' || turn_key), chr(0) ORDER BY seq)
        FILTER (WHERE role = 'U')) ELSE '' END AS replay_key
  FROM placed_b GROUP BY f, pair)
"""


def with_(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip() + "\n" + textwrap.dedent(select).strip()

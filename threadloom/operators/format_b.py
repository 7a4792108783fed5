"""Family-B rollout logs to typed entries and per-file session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.text import NUL, WS, lstrip, one_line, present, rstrip, sha
from ..functions.tokens import FIELDS
from ..params import Params
from .dedupe import line_hashes
from .format_a import ENTRY_COLUMNS
from .scan import Order, first_upto, last_before, last_upto, next_after, running, sum_before, sum_upto
from .segment import progress_position, segment_b

# Record types of the format, its counters, and texts injected by the tool itself.
RECORD_TYPES = ["session_meta", "turn_context", "event_msg", "response_item"]
MARKER = "inter_agent_communication_metadata"
COUNTERS = [
    "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens",
    "total_tokens",
]
INJECTED = (
    "^(<system-|<(environment_context|permissions|user_instructions|codex_internal_context|"
    f"recommended_plugins)([>/]|{WS}))"
)
TEXT_TYPES = ["input_text", "output_text", "text"]
FINAL_REPLY = f"(?m)^Message Type:{WS}*FINAL_ANSWER\\b"
EOF_LINE = (1 << 63) - 1

FILE = ["source", "file_id", "file_path", "rel_path", "extra_root", "root_dir", "root_rank",
        "subagent_dir"]
# Rows that close a turn's waiting fallback questions.
FLUSH = ["agent", "complete", "start", "reason", "call", "instruction", "developer", "eof"]


_COUNTS = "STRUCT<" + ", ".join(
    f"{c}: DOUBLE" for c in [*COUNTERS, "cache_read_input_tokens"]
) + ">"
# Fields of a record that are read.
RECORD = f"""
type STRING, timestamp STRING, payload STRUCT<
  type: STRING, id: STRING, session_id: STRING, session_name: STRING, title: STRING, cwd: STRING,
  cli_version: STRING, git: STRUCT<branch: STRING>, thread_source: STRING, source: VARIANT,
  parent_thread_id: STRING, agent_nickname: STRING, agent_path: STRING, turn_id: STRING,
  model: STRING, message: STRING, last_agent_message: STRING, role: STRING, content: VARIANT,
  summary: VARIANT, output: VARIANT, input: VARIANT, arguments: VARIANT, name: STRING,
  call_id: STRING, author: STRING, recipient: STRING,
  internal_chat_message_metadata_passthrough: STRUCT<turn_id: STRING>,
  info: STRUCT<total_token_usage: {_COUNTS}, last_token_usage: {_COUNTS}>>"""


def _message_text(content: Column) -> Column:
    def part(b: Column) -> Column:
        typed = B.str_at(b, "$.type").isin(TEXT_TYPES)
        return F.when(typed, B.str_at(b, "$.text")).otherwise("")

    parts = F.filter(F.transform(B.array_at(content), part), lambda t: t != "")
    return F.coalesce(B.text_at(content), F.array_join(parts, "\n"), F.lit(""))


def _output_text(output: Column) -> Column:
    def part(b: Column) -> Column:
        return F.coalesce(B.text_at(b), present(B.str_at(b, "$.text")), F.to_json(b))

    joined = F.array_join(F.transform(B.array_at(output), part), "\n")
    return F.coalesce(B.text_at(output), joined, F.to_json(output), F.lit(""))


def _reasoning_text(summary: Column) -> Column:
    parts = F.transform(B.array_at(summary), lambda b: B.str_at(b, "$.text"))
    return F.coalesce(
        B.text_at(summary), F.array_join(F.filter(parts, lambda t: t != ""), "\n"), F.lit("")
    )


def _counters(report: Column) -> Column:
    """A usage report's numbers; a missing number is NULL."""
    names = [*COUNTERS, "cache_read_input_tokens"]
    fields = [B.whole(report[c]) for c in names]
    known = F.coalesce(*fields).isNotNull()
    return F.struct(*[f.alias(c) for f, c in zip(fields, names)], known.alias("any"))


def parse_b(lines: DataFrame) -> DataFrame:
    """One typed row per line; JSON is read here and nowhere later. ``ok``: the line is a record."""
    blank = B.text_or_blank
    rows = lines.withColumn("r", B.read_json(F.col("value"), RECORD))
    rec = F.col("r")
    rows = rows.withColumns({"_t": blank(rec["type"]), "_p": blank(rec["payload"]["type"])})
    t, p, body = F.col("_t"), F.col("_p"), rec["payload"]
    is_meta, is_turn = t == "session_meta", t == "turn_context"
    event, item = t == "event_msg", t == "response_item"
    usage = event & (p == "token_count")
    total, last = body["info"]["total_token_usage"], body["info"]["last_token_usage"]
    call = item & p.isin("custom_tool_call", "function_call")
    out = item & p.isin("custom_tool_call_output", "function_call_output")
    arg = F.when(B.filled(body["input"]), body["input"]).otherwise(body["arguments"])
    arg_text = B.text_at(arg)
    arg = F.coalesce(F.try_parse_json(arg_text), arg)
    source = body["source"]

    def identity(key: str) -> Column:
        nested = [B.text_at(source, f"$.subagent.{key}"), B.text_at(source, f"$.subagent.thread_spawn.{key}")]
        return F.coalesce(present(body[key]), *[present(n) for n in nested], F.lit(""))

    sub = (body["thread_source"] == "subagent") | B.is_set(source, "$.subagent")
    thread = F.struct(
        "line_no",
        blank(body["id"]).alias("thread_id"),
        blank(body["session_id"]).alias("lineage_id"),
        identity("parent_thread_id").alias("parent_thread"),
        F.coalesce(sub, F.lit(False)).alias("is_sub"),
        F.coalesce(present(identity("agent_nickname")), identity("agent_path")).alias("agent"),
    )
    text = (
        F.when(event & p.isin("user_message", "agent_message"), blank(body["message"]))
        .when(event & (p == "task_complete"), blank(body["last_agent_message"]))
        .when(item & (p == "reasoning"), _reasoning_text(body["summary"]))
        .when(out, _output_text(body["output"]))
        .when(item & p.isin("message", "agent_message"), _message_text(body["content"]))
    )
    parsed = rows.select(
        *FILE, "_chunk", "line_no",
        B.is_record(rec, F.col("value")).alias("ok"),
        *line_hashes(F.col("value")),
        t.isin(RECORD_TYPES).alias("recognised"),
        ((t == MARKER) | (p == MARKER)).alias("marker"),
        t.alias("rec"), p.alias("part"),
        blank(rec["timestamp"]).alias("ts"),
        blank(body["role"]).alias("role_in"),
        text.alias("text"),
        F.when(is_meta, thread).alias("meta"),
        F.when(is_meta, F.coalesce(present(body["session_name"]), blank(body["title"])))
        .alias("meta_name"),
        F.when(is_meta, blank(body["cli_version"])).alias("meta_version"),
        F.when(is_meta, blank(body["git"]["branch"])).alias("meta_branch"),
        F.when(is_meta | is_turn, blank(body["cwd"])).alias("rec_cwd"),
        F.when(is_turn, blank(body["model"])).alias("rec_model"),
        F.when(is_turn | (event & (p == "task_started")), present(body["turn_id"])).alias("rec_turn"),
        F.when(usage & total.isNotNull(), _counters(total)).alias("total"),
        F.when(usage & last.isNotNull(), _counters(last)).alias("last"),
        F.when(item, blank(body["id"])).alias("item_id"),
        F.when(item, present(body["message"])).alias("direct_text"),
        F.when(item, blank(body["author"])).alias("author"),
        F.when(item, blank(body["recipient"])).alias("recipient"),
        F.when(item, present(body["internal_chat_message_metadata_passthrough"]["turn_id"]))
        .alias("own_turn"),
        F.when(call | out, blank(body["call_id"])).alias("call_id"),
        F.when(call, F.coalesce(present(body["name"]), F.lit("unknown"))).alias("call_name"),
        F.when(call, F.coalesce(B.written_order(arg_text), F.to_json(arg), F.lit("null")))
        .alias("call_input"),
        F.when(call, F.coalesce(*[B.text_at(arg, f"$.{k}") for k in B.TOOL_HINTS], F.lit("")))
        .alias("call_hint"),
    )
    return parsed


def _event(params: Params) -> Column:
    """What a row does, once it is known whether it follows the inter-agent marker."""
    rec, part, role = F.col("rec"), F.col("part"), F.col("role_in")
    delivered = F.coalesce(F.col("_after_marker"), F.lit(False)) & (
        (part == "agent_message") | ((part == "message") & (role != "user"))
    )
    msg, item = rec == "event_msg", rec == "response_item"
    event = (
        F.when(rec == "session_meta", "meta")
        .when(rec == "turn_context", "turn")
        .when(msg & (part == "task_started"), "start")
        .when(msg & (part == "user_message"), "user")
        .when(msg & (part == "agent_message"), "agent")
        .when(msg & (part == "token_count"), "usage")
        .when(msg & (part == "task_complete"), "complete")
        .when(item & delivered, "instruction")
        .when(item & (part == "message") & (role == "user"), "fallback")
    )
    if params.include_developer_messages:
        event = event.when(item & (part == "message") & (role == "developer"), "developer")
    return (
        event.when(item & (part == "reasoning"), "reason")
        .when(item & part.isin("custom_tool_call", "function_call"), "call")
        .when(item & part.isin("custom_tool_call_output", "function_call_output"), "output")
        .when(rec == "eof", "eof")
    )


def context(parsed: DataFrame, order: Order, params: Params) -> DataFrame:
    """Forward-filled context on every record, plus one end-of-file row per file."""
    parsed = parsed.where("ok")
    ends = (
        parsed.groupBy(*FILE)
        .agg(F.max("_chunk").alias("_chunk"))
        .withColumns({"line_no": F.lit(EOF_LINE), "rec": F.lit("eof"), "marker": F.lit(False)})
    )
    df = parsed.unionByName(ends, allowMissingColumns=True)
    df = running(
        df, order,
        _after_marker=last_before(F.col("marker")),
        thread=first_upto(F.col("meta")),
    )
    is_sub = F.coalesce(F.col("thread.is_sub"), F.lit(False))
    # A child session replays its parent's records, session_meta included: only its first counts.
    valid = (F.col("rec") == "session_meta") & (
        (F.col("thread.line_no") == F.col("line_no")) | ~is_sub
    )
    df = df.withColumns({"ev": _event(params), "is_sub": is_sub, "meta_valid": F.coalesce(valid, F.lit(False))})
    valid, ev = F.col("meta_valid"), F.col("ev")
    df = running(
        df, order,
        session_cwd=last_upto(F.when(valid, present(F.col("rec_cwd")))),
        version=last_upto(F.when(valid, present(F.col("meta_version")))),
        branch=last_upto(F.when(valid, present(F.col("meta_branch")))),
        model=last_upto(present(F.col("rec_model"))),
        turn=last_upto(F.col("rec_turn")),
        turn_before=last_before(F.col("rec_turn")),
        stretch=sum_upto(F.when(ev == "start", 1).otherwise(0).cast("bigint")),
        prev_total=last_before(F.col("total")),
    )
    # A new session_meta resets the directory to the session's; turn_context overrides it.
    moved = F.when(valid, F.coalesce("session_cwd", F.lit(""))).when(
        F.col("rec") == "turn_context", present(F.col("rec_cwd"))
    )
    df = running(df, order, _cwd=last_upto(moved))
    blank = F.lit("")
    return df.withColumns(
        {
            "cwd": F.coalesce(present(F.col("_cwd")), "session_cwd", blank),
            "version": F.coalesce("version", blank),
            "branch": F.coalesce("branch", blank),
            "turn": F.coalesce("turn", blank),
            "turn_before": F.coalesce("turn_before", blank),
        }
    ).drop("_cwd", "_after_marker")


def usage_delta(total: Column, prev: Column, last: Column, inherited: Column) -> Column:
    """Usage to credit: growth of the cumulative counters.

    No total: the last call. First report: the whole total, or the last call where the count was
    inherited. A counter that went down means a reset: the last call, else the total.
    """
    reset = F.lit(False)
    grown = []
    for c in COUNTERS:
        reset = reset | F.coalesce(total[c] < prev[c], F.lit(False))
        delta = F.coalesce(total[c], F.lit(0)) - F.coalesce(prev[c], F.lit(0))
        grown.append(F.greatest(F.lit(0).cast("bigint"), delta).alias(c))
    moved = F.greatest(*grown) > 0
    none = F.lit(None).cast("bigint").alias("cache_read_input_tokens")
    delta = F.struct(*grown, none, F.lit(True).alias("any"))
    return (
        F.when(total.isNull(), last)
        .when(prev.isNull() & inherited, last)
        .when(prev.isNull(), total)
        .when(reset, F.coalesce(last, total))
        .when(moved, delta)
    )


def fallback_questions(ctx: DataFrame, order: Order) -> tuple[DataFrame, DataFrame]:
    """(questions recovered from response items, all accepted items carrying a message id).

    Within a turn stretch only the first flushed group counts, and only where the stretch shows no
    user_message before that flush. A repeated ``msg_`` id within a stretch is a replay.
    """
    text, line = F.col("text"), F.col("line_no")
    flushed = F.struct(
        line.alias("line"),
        F.col("_chunk").alias("chunk"),
        "cwd", "version", "branch",
        F.when(F.col("ev") == "start", F.col("turn_before")).otherwise(F.col("turn")).alias("turn"),
    )
    df = running(ctx, order, flush=next_after(F.when(F.col("ev").isin(FLUSH), flushed)))
    waiting = df.where(
        (F.col("ev") == "fallback") & (text != "") & ~lstrip(text).rlike(INJECTED)
    ).withColumn("msg_id", F.when(F.col("item_id").startswith("msg_"), F.col("item_id")).otherwise(""))
    waiting = running(
        waiting, order.by("stretch", "msg_id"), _seen=sum_before(F.lit(1).cast("bigint"))
    ).where((F.col("msg_id") == "") | (F.col("_seen") == 0))
    key = ["file_id", "stretch"]
    first_flush = waiting.groupBy(*key).agg(F.min("flush.line").alias("_first_flush"))
    first_user = (
        ctx.where(F.col("ev") == "user").groupBy(*key).agg(F.min("line_no").alias("_first_user"))
    )
    due = waiting.join(first_flush, key).join(first_user, key, "left")
    asked = F.coalesce(F.col("_first_user") < F.col("flush.line"), F.lit(False))
    due = due.where((F.col("flush.line") == F.col("_first_flush")) & ~asked)
    return due, waiting.where(F.col("msg_id") != "")


def is_reply(author: Column, recipient: Column, text: Column) -> Column:
    """A delivered message came up from a delegate. Agent paths nest, so the addresses tell; the
    message type decides only where they do not."""
    addressed = (author != recipient) & (author != "") & (recipient != "")
    up = addressed & author.startswith(F.concat(recipient, F.lit("/")))
    down = addressed & recipient.startswith(F.concat(author, F.lit("/")))
    return F.when(up, True).when(down, False).otherwise(text.rlike(FINAL_REPLY))


def _progress_key(prefix: Column, body: Column) -> Column:
    return F.concat(prefix, F.when(body != "", F.concat(F.lit("~"), sha(body, 12))).otherwise(""))


def _credited(usage: Column) -> dict[str, Column]:
    zero = F.lit(0).cast("bigint")

    def n(c: str) -> Column:
        return F.coalesce(usage[c], zero)

    return {
        "has_usage": usage.isNotNull(),
        "tok_in": F.when(usage.isNotNull(), n("input_tokens")),
        "tok_out": F.when(usage.isNotNull(), n("output_tokens")),
        "tok_cache_read": F.when(
            usage.isNotNull(), n("cache_read_input_tokens") + n("cached_input_tokens")
        ),
        "tok_reasoning": F.when(usage.isNotNull(), n("reasoning_output_tokens")),
        "tok_write_5m": F.lit(None).cast("bigint"),
        "tok_write_1h": F.lit(None).cast("bigint"),
    }


def emit(ctx: DataFrame, order: Order) -> DataFrame:
    """Entries in emission order, before numbering: own records, usage carriers, fallbacks."""
    ev, text = F.col("ev"), F.col("text")
    said = F.when(ev == "developer", F.concat(F.lit("[Developer] "), text)).otherwise(text)
    by_turn = order.by("turn")
    df = ctx.withColumn("usage", F.when(
        ev == "usage",
        usage_delta(F.col("total"), F.col("prev_total"), F.col("last"), F.col("is_sub")),
    ))
    df = df.withColumn("usage", F.when(F.col("usage.any"), F.col("usage")))
    # The closing answer repeats the turn's latest text unless that text got lost.
    df = running(
        df, by_turn,
        _latest=last_before(
            F.when(ev.isin("agent", "complete", "developer") & (text != ""), said)
        ),
    )
    repeated = (ev == "complete") & F.coalesce(F.col("_latest") == text, F.lit(False))
    spoken = (ev.isin("agent", "complete", "developer", "reason") & (text != "") & ~repeated) | (
        ev == "call"
    )
    df = df.withColumn("_asst", F.coalesce(spoken, F.lit(False)))
    asst, usage = F.col("_asst"), F.col("usage")
    mark = F.when(asst | usage.isNotNull(), F.struct(asst.alias("asst"), usage.alias("usage")))
    df = running(df, by_turn, _prev=last_before(mark), _next=next_after(mark))
    carrier = usage.isNotNull() & ~F.coalesce(F.col("_prev.asst"), F.lit(False))
    attached = F.when(asst & ~F.col("_next.asst"), F.col("_next.usage"))
    direct = F.coalesce("direct_text", "text")
    user = ((ev == "user") & (text != "")) | ((ev == "instruction") & (direct != ""))
    reply = is_reply(F.col("author"), F.col("recipient"), text)
    kind = (
        F.when((ev == "instruction") & reply, "D")
        .when(ev == "instruction", "R")
        .when(user, "U")
        .otherwise("X")
    )
    instruction_id = F.when(
        (ev == "instruction") & F.col("item_id").rlike("^a?msg_"), F.col("item_id")
    )
    entry_class = (
        F.when(user, "u").when(asst | carrier, "a").when(ev == "output", "r")
    )
    key = (
        F.when(
            ev == "reason",
            _progress_key(F.concat(F.lit("reasoning#"), "item_id"), text),
        )
        .when(
            ev == "call",
            _progress_key(
                F.concat(F.lit("call:"), "call_name", F.lit("#"),
                         F.coalesce(present(F.col("call_id")), "item_id")),
                F.col("call_input"),
            ),
        )
        .when(ev == "output", _progress_key(F.concat(F.lit("result#"), "call_id"), text))
    )
    own = df.withColumn("class", entry_class).where(F.col("class").isNotNull())
    own = own.select(
        "source", "file_id", "_chunk",
        F.col("line_no").alias("at_line"), F.lit(1).alias("at_phase"), F.lit(0).cast("bigint").alias("at_tie"),
        "class", "ev", kind.alias("kind"), "ts", "cwd", "version", "branch",
        F.when(F.col("class") == "a", F.col("model")).alias("model"),
        F.when(F.col("class") == "u", F.when(ev == "instruction", F.coalesce("own_turn", "turn"))
               .otherwise(F.col("turn"))).otherwise(F.col("turn")).alias("turn"),
        F.when(ev == "instruction", direct).when(ev == "usage", F.lit(None)).otherwise(said).alias("body"),
        instruction_id.alias("own_msg_id"),
        key.alias("progress_key"),
        "call_name", "call_input", "call_hint",
        F.when(carrier, usage).otherwise(attached).alias("usage"),
    )
    due, _ = fallback_questions(ctx, order)
    recovered = due.select(
        "source", "file_id", F.col("flush.chunk").alias("_chunk"),
        F.col("flush.line").alias("at_line"), F.lit(0).alias("at_phase"), F.col("line_no").alias("at_tie"),
        F.lit("u").alias("class"), "ev", F.lit("U").alias("kind"), "ts",
        F.col("flush.cwd").alias("cwd"), F.col("flush.version").alias("version"),
        F.col("flush.branch").alias("branch"), F.col("flush.turn").alias("turn"),
        F.col("text").alias("body"),
    )
    return own.unionByName(recovered, allowMissingColumns=True)


def number(emitted: DataFrame, order: Order) -> tuple[DataFrame, Order]:
    """Per-file emission number and the ids built from it."""
    place = Order(("file_id",), ("at_line", "at_phase", "at_tie"), order.chunk)
    df = running(emitted, place, seq=sum_before(F.lit(1).cast("bigint")))
    uuid = F.concat("class", F.lit("-"), "seq")
    return df.withColumn("uuid", uuid), Order(("file_id",), ("seq",), order.chunk)


def turn_keys(numbered: DataFrame, order: Order) -> DataFrame:
    """``turn_key``: ``<turn>#<n>``, n counting the turn's user messages."""
    is_user = F.col("class") == "u"
    df = running(
        numbered, order.by("turn"),
        _n=sum_before(F.when(is_user, 1).otherwise(0).cast("bigint")),
    )
    key = F.when(is_user & (F.col("turn") != ""), F.concat("turn", F.lit("#"), "_n"))
    return df.withColumn("turn_key", key).drop("_n")


def hand_over_ids(users: DataFrame, items: DataFrame, order: Order, item_order: Order) -> DataFrame:
    """The k-th message of a (turn, text) takes the k-th id recorded for that (turn, text).

    ``users``: turn, body, own_msg_id; ``items``: turn, text, msg_id. Adds ``msg_id``.
    """
    one = F.lit(1).cast("bigint")
    users = users.withColumns(
        {"_body": sha(F.col("body")), "_own": F.col("own_msg_id").isNotNull()}
    )
    users = running(users, order.by("turn", "_body", "_own"), _k=sum_before(one))
    items = items.withColumn("_body", sha(F.col("text")))
    items = running(items, item_order.by("turn", "_body"), _k=sum_before(one)).select(
        "file_id", "turn", "_body", "_k", F.lit(False).alias("_own"), F.col("msg_id").alias("_item")
    )
    key = ["file_id", "turn", "_body", "_own", "_k"]
    joined = users.join(items, key, "left")
    return joined.withColumn("msg_id", F.coalesce("own_msg_id", "_item")).drop("_body", "_own", "_k", "_item")


def entries_b(ctx: DataFrame, order: Order, params: Params) -> DataFrame:
    """Entries with unit numbers, in the columns both families share."""
    numbered, place = number(emit(ctx, order), order)
    keyed = turn_keys(numbered, place)
    _, items = fallback_questions(ctx, order)
    is_user = F.col("class") == "u"
    users = hand_over_ids(keyed.where(is_user), items, place, order)
    keyed = users.unionByName(keyed.where(~is_user), allowMissingColumns=True)
    df = segment_b(keyed, place)
    kind, cls, ev = F.col("kind"), F.col("class"), F.col("ev")
    progress_only = (cls == "a") & ~ev.isin("agent", "complete")
    df = df.withColumn("progress_only", progress_only).withColumn(
        "role",
        F.when((cls == "u") & (F.col("opener") | (kind != "D")), "U")
        .when((cls == "a") & ~F.col("progress_only"), "A")
        .otherwise("P"),
    )
    df = progress_position(df, place, F.col("role") == "A").where(F.col("pair") > 0)
    body = F.col("body")
    a_text = F.when((cls == "a") & ev.isin("agent", "complete", "developer"), body)
    entry_type = F.when(cls == "a", "assistant").otherwise("user")
    signed = F.coalesce("progress_key", present(a_text))
    signature = F.when(
        signed.isNotNull(),
        F.concat(entry_type, F.lit(NUL), F.when(F.col("progress_only"), "1").otherwise("0"),
                 F.lit(NUL), signed),
    )
    line = one_line(body)

    def lines(full: bool) -> Column:
        name = F.concat(F.lit("- [Tool: "), "call_name")
        if full:
            called = F.concat(name, F.lit("] "), B.cut(F.col("call_input"), 200))
            result = F.concat(F.lit("- [ToolResult] "), body)
            thought = F.concat(F.lit("- [Thinking] "), line)
        else:
            hint = F.when(F.col("call_hint") != "", F.concat(F.lit(" "), B.cut(F.col("call_hint"), 80)))
            called = F.concat(name, F.coalesce(hint, F.lit("")), F.lit("]"))
            head = F.left(F.split_part(body, F.lit("\n"), F.lit(1)), F.lit(80))
            more = F.when(F.length(body) > F.length(head), "...").otherwise("")
            result = F.concat(F.lit("- [ToolResult: "), head, more, F.lit("]"))
            thought = F.lit(None).cast("string")
        shown = (
            F.when(ev == "call", called)
            .when(ev == "output", result)
            .when(ev == "reason", thought)
            .when(a_text.isNotNull() & (line != ""), F.concat(F.lit("- (assistant) "), line))
        )
        return F.array_compact(F.array(shown))

    none = F.lit(None).cast("array<string>")
    return df.withColumns(
        {
            **_credited(F.col("usage")),
            "side": F.lit(False),
            "meta": F.lit(False),
            "is_assistant": cls == "a",
            "parent": F.lit(""),
            "text": F.when(cls == "u", rstrip(body)),
            "plain": F.when(cls == "u", body),
            "a_text": a_text,
            "command": F.lit(None).cast("string"),
            "body_name": F.lit(None).cast("string"),
            "lines": lines(False) if params.wants_progress else none,
            "lines_full": lines(True) if params.wants_full_progress else none,
            "tail": none,
            "tail_full": none,
            "replay_part": F.when(
                F.col("role") == "U",
                F.coalesce(
                    F.concat(F.lit("m:"), "msg_id"), F.concat(F.lit("t:"), "turn_key"), F.lit("")
                ),
            ),
            "signature": signature,
            "body": F.lit(None).cast("string"),
        }
    ).select(*ENTRY_COLUMNS)


def sessions_b(ctx: DataFrame) -> DataFrame:
    """Session facts per file: ids, name, directory, thread identity."""
    valid, line = F.col("meta_valid"), F.col("line_no")
    sub = F.col("is_sub")
    meta_id, lineage = F.col("meta.thread_id"), F.col("meta.lineage_id")
    sid = F.when(
        sub, F.coalesce(present(F.col("thread.thread_id")), F.col("thread.lineage_id"))
    ).otherwise(F.coalesce(present(lineage), meta_id))
    name = F.coalesce(F.when(sub, present(F.col("thread.agent"))), present(F.col("meta_name")))

    def newest(c: Column) -> Column:
        return F.coalesce(F.max_by(c, F.when(valid & (c != ""), line)), F.lit(""))

    by_file = ctx.groupBy(*FILE).agg(
        F.bool_or("recognised").alias("recognised"),
        newest(sid).alias("_sid"),
        newest(name).alias("session_name"),
        newest(F.col("rec_cwd")).alias("session_cwd"),
        F.min_by("meta", F.when(F.col("meta").isNotNull(), line)).alias("_thread"),
    )
    base = F.regexp_replace(F.regexp_replace("rel_path", "^.*/", ""), r"\.jsonl$", "")
    blank = F.lit("")
    return by_file.withColumns(
        {
            "session_id": F.coalesce(present(F.col("_sid")), base),
            "file_is_subagent": F.coalesce("_thread.is_sub", F.lit(False)),
            "thread_id": F.coalesce("_thread.thread_id", blank),
            "lineage_id": F.coalesce("_thread.lineage_id", blank),
            "parent_thread": F.coalesce("_thread.parent_thread", blank),
            "first_cwd": F.lit(None).cast("string"),
        }
    ).drop("_sid", "_thread")

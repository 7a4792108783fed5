"""Log-shaped views of the given tables.

LogView-C turns ``conversations`` into family-A sessions, LogView-E turns ``events`` into streams
that reach every branch of the stateful rules. The same views are written in SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import CHUNK, COLD, Order, cut_hot, last_before, running, sum_before
from ..params import SOURCE_A, SOURCE_B, Params
from ..sources.lines import Lines

# 2024-01-01T00:00:00Z
EPOCH = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_id(*parts) -> F.Column:
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(12))


def iso(seconds) -> F.Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_view_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, conv_id, seq, kind (Q/A/M), uuid, parent, ts, text."""
    conv = table(spark, sf_dir, "conversations")
    seconds = EPOCH + (F.col("conv_id") % 3650) * 86400 + F.col("turn") * 60
    return conv.select(
        F.concat(F.lit("s"), F.col("conv_id")).alias("session"),
        "conv_id",
        F.col("turn").alias("seq"),
        F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A")
        .otherwise("M").alias("kind"),
        short_id("conv_id", "turn").alias("uuid"),
        F.when(F.col("turn") == 0, "").otherwise(short_id("conv_id", F.col("turn") - 1))
        .alias("parent"),
        iso(seconds).alias("ts"),
        "text",
    )


def log_view_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, event_id, kind_a, kind_b, parent, value, k."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return ev.select(
        F.col("user_id").cast("string").alias("session"),
        "ts",
        "event_id",
        F.when(kind == "click", "Q").when(kind == "view", "A").when(kind == "purchase", "T")
        .when(kind == "error", "M").otherwise("P").alias("kind_a"),
        F.when(kind == "click", "U").when((kind == "signup") & (k % 5 == 0), "R")
        .when(kind == "signup", "U").when(kind == "error", "D").otherwise("X").alias("kind_b"),
        F.when(k % 3 == 0, "").otherwise((k % 3).cast("string")).alias("parent"),
        "value",
        k.alias("k"),
    )


def _json(**fields) -> F.Column:
    """JSON object; fields whose value is NULL are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _logged_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str | None]:
    """events with file key ``f``, line number and the integer ``k`` of the properties."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("f"), "ts", "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    ev, order = cut_hot(ev, ["f"], ["ts", "event_id"])
    one = F.lit(1).cast("bigint")
    ev = running(
        ev, order, line_no=sum_before(one), _prev=last_before(F.col("event_id"))
    )
    return (ev if order.chunk else ev.withColumn(CHUNK, F.lit(COLD))), order.chunk


def _as_lines(df: DataFrame, source: str, value: F.Column) -> DataFrame:
    return df.withColumn("value", value).select(
        F.lit(source).alias("source"), F.concat(F.lit(source + "/"), "f").alias("file_id"),
        F.concat(F.lit("/logs/"), "f", F.lit(".jsonl")).alias("file_path"),
        F.concat("f", F.lit(".jsonl")).alias("rel_path"), F.lit(False).alias("extra_root"),
        F.lit("/logs").alias("root_dir"), F.lit(0).alias("root_rank"),
        F.lit(False).alias("subagent_dir"), "_chunk", "line_no", "value",
    )


def lines_a(spark: SparkSession, sf_dir: str) -> Lines:
    """``events`` as family-A logs, one file per user: questions, queued prompts, retyped and
    injected messages, answers with usage, tool results, side conversations, broken lines."""
    ev, chunk = _logged_events(spark, sf_dir)
    k, eid, et = F.col("k"), F.col("event_id"), F.col("event_type")
    none = F.lit(None).cast("string")
    uuid = F.concat(F.lit("e"), eid)
    parent = (
        F.when(k % 4 == 0, none)
        .when(k % 4 == 1, F.concat(F.lit("p"), k % 3))
        .otherwise(F.concat(F.lit("e"), "_prev"))
    )
    side = k % 10 == 9
    ts = F.concat(F.lit("2024-01-01T00:00:00."), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("Z"))
    cwd = F.when(k % 2 == 0, F.concat(F.lit("/w/p"), k % 3))
    base = dict(uuid=uuid, parentUuid=parent, timestamp=ts, isSidechain=side, cwd=cwd)

    def message(content, **more):
        return F.struct(content.alias("content"), *[c.alias(n) for n, c in more.items()])

    nothing = F.lit(None).cast("string")
    talk = F.array(F.struct(
        F.lit("text").alias("type"), F.concat(F.lit("a"), eid).alias("text"), nothing.alias("name"),
        F.struct(nothing.alias("path")).alias("input")))
    tool = F.array(F.struct(
        F.lit("tool_use").alias("type"), nothing.alias("text"), F.lit("Read").alias("name"),
        F.struct(F.concat(F.lit("/f/"), k).alias("path")).alias("input")))
    usage = F.when(k % 5 != 0, F.struct(
        k.alias("input_tokens"), F.lit(1).alias("output_tokens"),
        (k % 9).alias("cache_read_input_tokens")))
    model = F.when(k % 6 == 0, "<synthetic>").otherwise(F.concat(F.lit("m"), k % 3))
    injected = F.when(k % 7 == 0, "<system-reminder> x").otherwise(F.concat(F.lit("m"), eid))
    result = F.array(F.struct(
        F.lit("tool_result").alias("type"), F.concat(F.lit("r"), eid, F.lit("\nmore")).alias("content")))
    prompt = F.struct(
        F.lit("queued_command").alias("type"), F.concat(F.lit("k"), eid).alias("prompt"))
    title = F.concat(F.lit("title "), eid)
    value = (
        F.when(et == "click", _json(type=F.lit("user"), **base,
                                    message=message(F.concat(F.lit("q"), eid, F.lit(" ")))))
        .when(et == "view", _json(type=F.lit("assistant"), **base, message=message(
            F.when(k % 3 == 0, tool).otherwise(talk), usage=usage, model=model)))
        .when(et == "purchase", _json(type=F.lit("user"), **base, message=message(result)))
        .when(et == "error", _json(type=F.lit("user"), isMeta=F.lit(True), **base,
                                   message=message(injected)))
        .when(k % 2 == 0, _json(type=F.lit("attachment"), **base, attachment=prompt))
        .when(k % 4 == 1, _json(type=F.lit("custom-title"), **base, customTitle=title))
        .otherwise("{broken")
    )
    return Lines(_as_lines(ev, SOURCE_A, value), Order(("file_id",), ("line_no",), chunk))


def lines_b(spark: SparkSession, sf_dir: str) -> Lines:
    """``events`` as family-B rollouts, one file per user: every record kind that matters."""
    ev, chunk = _logged_events(spark, sf_dir)
    k, eid, et = F.col("k"), F.col("event_id"), F.col("event_type")
    ts = F.concat(F.lit("2024-01-01T00:00:00."), F.lpad((k % 100).cast("string"), 3, "0"), F.lit("Z"))
    stamp = dict(timestamp=ts)

    def rec(kind: str, **payload):
        body = F.struct(*[c.alias(n) for n, c in payload.items()])
        return _json(type=F.lit(kind), **stamp, payload=body)

    def event(part: str, **payload):
        return rec("event_msg", type=F.lit(part), **payload)

    def item(part: str, **payload):
        return rec("response_item", type=F.lit(part), **payload)

    turn = F.concat(F.lit("t"), k % 5)
    reply = F.concat(F.lit("a"), k % 3)
    text = F.array(F.struct(F.lit("input_text").alias("type"),
                            F.concat(F.lit("f"), k % 3).alias("text")))
    amount = F.floor("value").cast("bigint")
    total = F.when(k % 6 != 0, F.struct(amount.alias("input_tokens"), k.alias("output_tokens")))
    last = F.struct(k.alias("input_tokens"), F.lit(1).alias("output_tokens"))
    call = F.concat(F.lit("c"), eid)
    value = (
        F.when((et == "click") & (k % 4 == 0), item(
            "message", role=F.lit("user"), content=text,
            id=F.when(k % 8 == 0, F.concat(F.lit("msg_"), k % 10))))
        .when(et == "click", event("user_message", message=F.concat(F.lit("f"), k % 3)))
        .when(et == "view", event("agent_message", message=reply))
        .when(et == "purchase", event("token_count", info=F.struct(
            total.alias("total_token_usage"), last.alias("last_token_usage"))))
        .when((et == "error") & (k % 2 == 0), event("task_started", turn_id=turn))
        .when(et == "error", event("task_complete", last_agent_message=reply))
        .when(k % 5 == 0, rec(
            "session_meta", id=F.lit("P"), session_id=F.concat(F.lit("S"), k % 4),
            cwd=F.when(k % 2 == 0, F.concat(F.lit("/w/"), k % 3))))
        .when(k % 5 == 1, rec(
            "turn_context", turn_id=turn, cwd=F.when(k % 2 == 0, F.concat(F.lit("/w/t"), k % 4)),
            model=F.concat(F.lit("m"), k % 2)))
        .when(k % 5 == 2, item("function_call", call_id=call, name=F.lit("sh"),
                               arguments=F.lit('{"command":"ls"}')))
        .when(k % 5 == 3, item("function_call_output", call_id=call,
                               output=F.concat(F.lit("o"), eid)))
        .otherwise(item("reasoning", id=F.concat(F.lit("rs"), eid), summary=F.array(
            F.struct(F.concat(F.lit("h"), eid).alias("text")))))
    )
    return Lines(_as_lines(ev, SOURCE_B, value), Order(("file_id",), ("line_no",), chunk))


def params_for_views(**changes) -> Params:
    return Params(project="/w", **changes)

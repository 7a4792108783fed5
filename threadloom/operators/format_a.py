"""Family-A session logs to typed entries and per-file session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions.text import NUL, WS, lstrip, present, rstrip
from ..functions.tokens import FIELDS
from ..params import Params
from .dedupe import line_hashes
from .scan import Order
from .segment import progress_position, segment_a

# Injected texts that never extend a question.
NOISE = "^<(local-command-caveat|local-command-stdout|system-reminder)>"
COMMAND_NAME = f"<command-name>{WS}*/?([^<\\t-\\r ]+){WS}*</command-name>"
COMMAND_DIR = r"(?i)[\\/]commands[\\/]"


# Fields of a record that are read.
RECORD = """
type STRING, uuid STRING, parentUuid STRING, timestamp STRING, cwd STRING, version STRING,
gitBranch STRING, isMeta BOOLEAN, isSidechain BOOLEAN, customTitle STRING, aiTitle STRING,
attachment STRUCT<type: STRING, prompt: VARIANT, commandMode: STRING>,
message STRUCT<content: VARIANT, model: STRING, usage: STRUCT<
  input_tokens: DOUBLE, output_tokens: DOUBLE, cache_read_input_tokens: DOUBLE,
  cache_creation_input_tokens: DOUBLE, cache_creation: STRUCT<
    ephemeral_5m_input_tokens: DOUBLE, ephemeral_1h_input_tokens: DOUBLE>>>,
toolUseResult VARIANT"""


def _kind(r: Column, prompt: Column, blocks: Column) -> Column:
    typ = r["type"]
    mode = r["attachment"]["commandMode"]
    queued = (
        (typ == "attachment")
        & (r["attachment"]["type"] == "queued_command")
        & prompt.isNotNull()
        & (mode.isNull() | (mode == "prompt"))
    )
    user = (typ == "user") & B.filled(r["message"]["content"])
    return (
        F.when(queued, "K")
        .when(user & r["isMeta"], "M")
        .when(user & B.only_tool_results(blocks), "T")
        .when(user, "Q")
        .when((typ == "assistant") & r["message"].isNotNull(), "A")
    )


def parse_a(lines: DataFrame, params: Params) -> DataFrame:
    """One typed row per line; JSON is read here and nowhere later. ``ok``: the line is a record."""
    rows = lines.withColumn("r", B.read_json(F.col("value"), RECORD))
    r = F.col("r")
    content = r["message"]["content"]
    rows = rows.withColumns(
        {
            "_texts": F.when(r["message"].isNotNull(), B.texts_of(content)),
            "_prompt": F.when(r["type"] == "attachment", B.text_at(r["attachment"]["prompt"])),
        }
    )
    texts, prompt = F.col("_texts"), F.col("_prompt")
    rows = rows.withColumn("kind", _kind(r, prompt, texts))
    kind = F.col("kind")
    queued = kind == "K"
    usage = r["message"]["usage"]
    has_usage = (kind == "A") & usage.isNotNull()
    split = usage["cache_creation"]
    tokens = {
        "tok_in": usage["input_tokens"],
        "tok_out": usage["output_tokens"],
        "tok_cache_read": usage["cache_read_input_tokens"],
        "tok_write_5m": F.when(split.isNotNull(), split["ephemeral_5m_input_tokens"]).otherwise(
            usage["cache_creation_input_tokens"]
        ),
        "tok_write_1h": split["ephemeral_1h_input_tokens"],
        "tok_reasoning": F.lit(0.0),
    }
    shown = F.when(queued, rstrip(prompt)).when(kind.isin("Q", "M"), B.user_text(content))
    plain = F.when(queued, prompt).when(kind.isin("Q", "M"), B.joined_text(texts))
    command = F.when(
        plain.contains("<command-name>"), F.regexp_extract(plain, COMMAND_NAME, 1)
    )
    command_parts = F.filter(F.split(command, "[/:]"), lambda p: p != "")
    tool_file = r["toolUseResult"]
    body_path = F.when(kind == "T", B.text_at(tool_file, "$.file.filePath"))
    body = F.when(kind == "T", B.text_at(tool_file, "$.file.content"))
    is_body = body_path.rlike(COMMAND_DIR) & body.isNotNull()
    base = F.element_at(F.split(F.replace(body_path, F.lit("\\"), F.lit("/")), "/"), -1)
    from_user = kind == "T"

    # Tool inputs as text, for display in the order they were logged.
    as_text = "message STRUCT<content: ARRAY<STRUCT<input: STRING>>>"
    written = None
    if params.wants_full_progress:
        written = F.from_json("value", as_text)["message"]["content"]

    def lines_when(wanted: bool, full: bool) -> tuple[Column, Column]:
        if not wanted:
            none = F.lit(None).cast("array<string>")
            return none, none
        return (
            F.when(kind.isin("T", "A"), B.progress_lines(content, from_user, full, written)),
            F.when(kind == "A", B.answer_lines(content, full, written)),
        )

    short, short_tail = lines_when(params.wants_progress, False)
    long, long_tail = lines_when(params.wants_full_progress, True)
    anchored = ~F.coalesce(queued, F.lit(False))
    typ, blank = B.text_or_blank(r["type"]), B.text_or_blank
    return rows.select(
        "source", "file_id", "file_path", "rel_path", "extra_root", "root_dir", "root_rank",
        "subagent_dir", "_chunk", "line_no", "kind",
        B.is_record(r, F.col("value")).alias("ok"),
        *line_hashes(F.col("value")),
        F.coalesce(r["isSidechain"], F.lit(False)).alias("side"),
        typ.alias("line_type"),
        blank(r["uuid"]).alias("uuid"),
        blank(r["parentUuid"]).alias("parent"),
        blank(r["timestamp"]).alias("ts"),
        F.when(anchored, blank(r["cwd"])).alias("cwd"),
        F.when(anchored, blank(r["version"])).alias("version"),
        F.when(anchored, blank(r["gitBranch"])).alias("branch"),
        F.when(kind == "A", present(r["message"]["model"])).alias("model"),
        F.coalesce(has_usage, F.lit(False)).alias("has_usage"),
        *[F.when(has_usage, B.count_or_0(c)).alias(n) for n, c in tokens.items()],
        shown.alias("text"),
        plain.alias("plain"),
        (lstrip(plain).rlike(NOISE)).alias("noise"),
        F.when(kind == "A", B.last_text(texts)).alias("a_text"),
        F.when(F.size(command_parts) > 0, F.element_at(command_parts, -1)).alias("command"),
        F.when(is_body, F.lower(base)).alias("body_name"),
        F.when(is_body, body).alias("body"),
        short.alias("lines"), short_tail.alias("tail"),
        long.alias("lines_full"), long_tail.alias("tail_full"),
        (typ.isin("user", "assistant") & r["message"].isNotNull()).alias("recognised"),
        F.when(typ == "custom-title", r["customTitle"]).alias("custom_title"),
        F.when(typ == "ai-title", r["aiTitle"]).alias("ai_title"),
    )


def _latest_title(name: str) -> Column:
    c = F.col(name)
    return F.max_by(c, F.when(rstrip(lstrip(c)) != "", F.col("line_no")))


def sessions_a(parsed: DataFrame) -> DataFrame:
    """Session facts per recognised file. Ids come from the path: ids inside a log would mix a
    session with its children."""
    by_file = parsed.groupBy(
        "source", "file_id", "file_path", "rel_path", "extra_root", "root_dir", "root_rank",
        "subagent_dir",
    ).agg(
        F.bool_or("recognised").alias("recognised"),
        F.coalesce(_latest_title("custom_title"), _latest_title("ai_title"), F.lit("")).alias(
            "session_name"
        ),
        F.min_by("cwd", F.when(F.col("cwd") != "", F.col("line_no"))).alias("first_cwd"),
    )
    stem = F.regexp_replace("rel_path", r"\.jsonl$", "")
    return by_file.withColumns(
        {
            "session_id": F.replace(stem, F.lit("/"), F.lit("__")),
            "session_cwd": F.lit(""),
            "file_is_subagent": F.col("subagent_dir"),
            "thread_id": F.lit(""),
            "lineage_id": F.lit(""),
            "parent_thread": F.lit(""),
        }
    )


def entries_a(parsed: DataFrame, order: Order) -> DataFrame:
    """Entries with unit numbers; the main and the side conversation are separate streams."""
    rows = parsed.where(F.col("kind").isNotNull())
    order = order.by("side")
    rows = segment_a(rows, order)
    rows = progress_position(rows, order, F.col("kind") == "A").where(F.col("pair") > 0)
    joins_question = ~F.col("noise") & ~F.col("answered") & (F.col("parent") != "")
    kind = F.col("kind")
    role = (
        F.when(kind.isin("Q", "K"), "U")
        .when((kind == "M") & joins_question, "U")
        .when(kind == "A", "A")
        .when(kind == "T", "P")
    )
    return rows.withColumns(
        {
            "role": role,
            "meta": kind == "M",
            "is_assistant": kind == "A",
            "progress_only": F.lit(False),
            "seq": F.col("line_no"),
            "replay_part": F.lit(None).cast("string"),
            "signature": F.lit(None).cast("string"),
        }
    ).where(F.col("role").isNotNull())


def event_stream_a(parsed: DataFrame) -> DataFrame:
    """(source, file_id, line_no, event) of every parseable line, for snapshot comparison."""
    return parsed.where("ok").select(
        "source", "file_id", "line_no",
        F.concat("line_type", F.lit(NUL), "uuid").alias("event"),
    )


ENTRY_COLUMNS = [
    "source", "file_id", "side", "pair", "role", "meta", "is_assistant", "progress_only", "opener",
    "final", "place", "place_tie", "seq", "uuid", "parent", "ts", "cwd", "version", "branch",
    "model", "has_usage", *FIELDS, "text", "plain", "a_text", "command", "body_name", "body",
    "lines", "tail", "lines_full", "tail_full", "replay_part", "signature",
]

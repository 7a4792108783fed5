"""Column expressions over JSON kept as VARIANT: typed access and content blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut, one_line, rstrip

# Fixed value: inputs that describe a tool call in one line, the first text among them wins.
TOOL_HINTS = ["file_path", "path", "pattern", "command", "url", "query"]


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text_at(v: Column, path: str = "$") -> Column:
    """The value if it is a JSON string, else NULL (numbers and objects do not count)."""
    inner = at(v, path)
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, path, "string"))


def str_at(v: Column, path: str) -> Column:
    """As ``text_at`` with '' for everything else."""
    return F.coalesce(text_at(v, path), F.lit(""))


def object_at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def is_object(v: Column, path: str = "$") -> Column:
    return object_at(v, path).isNotNull()


def array_at(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def is_set(v: Column, path: str) -> Column:
    """Present and not JSON null."""
    inner = at(v, path)
    return inner.isNotNull() & ~F.is_variant_null(inner)


def read_json(value: Column, schema: str) -> Column:
    """The record in typed fields, parsed once. Parts whose shape varies are VARIANT fields."""
    return F.from_json(value, schema + ", _corrupt_record STRING")


def is_record(r: Column, value: Column) -> Column:
    """The line is a JSON object. Only a line with a mistyped or broken part is parsed again."""
    return F.when(r["_corrupt_record"].isNull(), True).otherwise(is_object(F.try_parse_json(value)))


def filled(c: Column) -> Column:
    """A VARIANT field that is present and not JSON null."""
    return c.isNotNull() & ~F.is_variant_null(c)


def whole(c: Column) -> Column:
    """A count as BIGINT; NULL stays NULL."""
    return F.round(c).cast("bigint")


def count_or_0(c: Column) -> Column:
    return F.coalesce(whole(c), F.lit(0).cast("bigint"))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def json_text(v: Column) -> Column:
    """Compact JSON, 200 characters at most; a missing value shows as ``undefined``."""
    return F.coalesce(cut(F.to_json(v), 200), F.lit("undefined"))


def texts_of(content: Column) -> Column:
    """Content as ARRAY<STRUCT<type, text>>; a plain string is one text block."""
    blocks = F.transform(
        array_at(content),
        lambda b: F.struct(
            str_at(b, "$.type").alias("type"), text_at(b, "$.text").alias("text")
        ),
    )
    whole = F.array(F.struct(F.lit("text").alias("type"), text_at(content).alias("text")))
    empty = F.slice(whole, F.lit(1), F.lit(0))
    return F.when(text_at(content).isNotNull(), whole).otherwise(F.coalesce(blocks, empty))


def only_tool_results(blocks: Column) -> Column:
    return (F.size(blocks) > 0) & F.forall(blocks, lambda b: b["type"] == "tool_result")


def plain_texts(blocks: Column) -> Column:
    """Texts of the text blocks."""
    kept = F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull())
    return F.transform(kept, lambda b: b["text"])


def last_text(blocks: Column) -> Column:
    t = plain_texts(blocks)
    return F.when(F.size(t) > 0, F.element_at(t, -1))


def joined_text(blocks: Column) -> Column:
    return F.array_join(plain_texts(blocks), "\n")


def tool_result_text(content: Column) -> Column:
    def part(x: Column) -> Column:
        return F.coalesce(text_at(x), text_at(x, "$.text"), json_text(x))

    joined = F.array_join(F.transform(array_at(content), part), " ")
    return F.coalesce(text_at(content), joined, json_text(content))


def tool_result_line(block: Column, full: bool) -> Column:
    body = tool_result_text(at(block, "$.content"))
    if full:
        return F.concat(F.lit("[ToolResult] "), body)
    head = F.left(F.split_part(body, F.lit("\n"), F.lit(1)), F.lit(80))
    more = F.when(F.length(body) > F.length(head), F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.lit("[ToolResult: "), head, more, F.lit("]"))


def written_order(text: Column) -> Column:
    """Compact JSON of an object or array text with its keys as written; a VARIANT sorts them."""
    wrapped = F.concat(F.lit('{"a":'), text, F.lit("}"))
    v = F.try_parse_json(text)
    nested = is_object(v) | array_at(v).isNotNull()
    return F.when(nested, F.from_json(wrapped, "a STRING")["a"])


def tool_use_line(block: Column, full: bool, written: Column | None = None) -> Column:
    """``written``: the input's JSON text as logged, if at hand."""
    name = F.coalesce(text_at(block, "$.name"), F.lit("unknown"))
    if full:
        shown = json_text(at(block, "$.input"))
        if written is not None:
            shown = F.when(is_object(block, "$.input"), cut(written, 200)).otherwise(shown)
        return F.concat(F.lit("[Tool: "), name, F.lit("] "), shown)
    hint = F.coalesce(*[text_at(block, f"$.input.{k}") for k in TOOL_HINTS], F.lit(""))
    shown = F.when(hint != "", F.concat(F.lit(" "), cut(hint, 80))).otherwise(F.lit(""))
    return F.concat(F.lit("[Tool: "), name, shown, F.lit("]"))


def user_text(content: Column) -> Column:
    """What a user message shows: texts, image marks, short tool results; trailing space cut."""

    def shown(b: Column) -> Column:
        kind = str_at(b, "$.type")
        return (
            F.when((kind == "text") & text_at(b, "$.text").isNotNull(), text_at(b, "$.text"))
            .when(kind == "image", F.lit("[Image]"))
            .when(kind == "tool_result", tool_result_line(b, full=False))
            .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
        )

    parts = F.transform(array_at(content), shown)
    return rstrip(F.coalesce(text_at(content), F.array_join(parts, "\n"), F.lit("")))


def _dash(c: Column) -> Column:
    return F.concat(F.lit("- "), c)


def _said(text: Column) -> Column:
    line = one_line(text)
    return F.when(line != "", F.concat(F.lit("- (assistant) "), line))


def _input_at(written: Column | None, i: Column) -> Column | None:
    return None if written is None else F.get(written, i)["input"]


def progress_lines(
    content: Column, from_user: Column, full: bool, written: Column | None = None
) -> Column:
    """Lines a progress record shows; a user record shows its tool results only."""

    def line(b: Column, i: Column) -> Column:
        kind = str_at(b, "$.type")
        thought = F.coalesce(one_line(str_at(b, "$.thinking")), F.lit(""))
        is_text = (kind == "text") & text_at(b, "$.text").isNotNull()
        return (
            F.when(kind == "tool_result", _dash(tool_result_line(b, full)))
            .when(from_user, F.lit(None))
            .when(is_text, _said(text_at(b, "$.text")))
            .when(kind == "tool_use", _dash(tool_use_line(b, full, _input_at(written, i))))
            .when(kind == "image", F.lit("- [Image]"))
            .when(
                kind == "thinking",
                F.concat(F.lit("- [Thinking] "), thought) if full else F.lit(None),
            )
            .otherwise(F.concat(F.lit("- ["), kind, F.lit("]")))
        )

    plain = F.when(~from_user & text_at(content).isNotNull(), F.array(_said(text_at(content))))
    return F.array_compact(
        F.coalesce(plain, F.transform(array_at(content), line), F.array().cast("array<string>"))
    )


def answer_lines(content: Column, full: bool, written: Column | None = None) -> Column:
    """Lines the final answer adds to progress: its earlier texts, then its tool calls."""
    blocks = texts_of(content)
    # Position of the last text block, 1-based; 0 when there is none.
    last = F.aggregate(
        F.transform(blocks, lambda b, i: F.when(b["type"] == "text", i + 1).otherwise(0)),
        F.lit(0),
        lambda acc, x: F.greatest(acc, x),
    )
    earlier = F.filter(
        F.transform(
            blocks, lambda b, i: F.when((i + 1 != last) & (b["type"] == "text"), b["text"])
        ),
        lambda t: t.isNotNull(),
    )
    calls = F.transform(
        array_at(content),
        lambda b, i: F.when(
            str_at(b, "$.type") == "tool_use",
            _dash(tool_use_line(b, full, _input_at(written, i))),
        ),
    )
    return F.array_compact(
        F.concat(
            F.transform(earlier, _said),
            F.coalesce(calls, F.array().cast("array<string>")),
        )
    )

"""Rendering blocks from a template, and checking templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import defang, display_time
from ..functions.tokens import display as token_text
from ..params import LABELS, SHORT_LABELS, Params

PLACEHOLDER = re.compile(r"%([A-Za-z][A-Za-z0-9]*)%")


def _by_source(values: dict[str, str]) -> Column:
    out = None
    for source, label in values.items():
        test = F.col("source") == source
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def placeholders(params: Params) -> dict[str, Column]:
    """Value of every placeholder. Content has comment marks defused; other values are as they are."""
    return {
        "DateTime": display_time(F.col("ts_ms"), F.col("ts_raw")),
        "Source": _by_source(LABELS),
        "SourceShort": _by_source(SHORT_LABELS),
        params.id_placeholder: F.col("block_id"),
        "SessionId": F.col("session_id"),
        "SessionName": F.col("session_name"),
        "Question": defang(F.col("question")),
        "Progress": defang(F.col("progress")),
        "ProgressFull": defang(F.col("progress_full")),
        "Answer": defang(F.col("answer")),
        "Model": F.col("model"),
        "Version": F.col("version"),
        "GitBranch": F.col("branch"),
        "Cwd": F.col("cwd"),
        "Tokens": token_text(),
    }


def render(units: DataFrame, params: Params) -> DataFrame:
    """Adds ``md``. The template is split once into literals and columns, so a value that looks
    like a placeholder is never expanded again."""
    values = placeholders(params)
    parts: list[Column] = []
    marker = f"<!-- %{params.id_placeholder}% -->"
    if marker not in re.split(r"\r?\n", params.template):
        parts.append(F.concat(F.lit("<!-- "), F.col("block_id"), F.lit(" -->\n")))
    at = 0
    for m in PLACEHOLDER.finditer(params.template):
        if m.group(1) not in values:
            continue
        parts.append(F.lit(params.template[at : m.start()]))
        parts.append(F.coalesce(values[m.group(1)], F.lit("")))
        at = m.end()
    parts.append(F.lit(params.template[at:]))
    return units.withColumn("md", F.concat(*parts))


def template_warnings(params: Params) -> list[str]:
    out = []
    if params.wants_progress and params.wants_full_progress:
        out.append("both progress placeholders are used; both will be filled")
    if "%Source%" not in params.template:
        out.append("no %Source%: sources cannot be told apart")
    known = set(placeholders(params))
    unknown = [n for n in dict.fromkeys(PLACEHOLDER.findall(params.template)) if n not in known]
    out += [f"unknown placeholder %{n}%" for n in unknown]
    return out

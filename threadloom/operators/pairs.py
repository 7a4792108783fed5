"""Rolling entries up to question units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUL, rstrip, sha
from ..functions.tokens import FIELDS, totals
from ..params import SOURCE_A, SOURCE_B

UNIT = ["source", "file_id", "side", "pair"]
SYNTHETIC = "<synthetic>"  # fixed value: model name of records no model produced


def accepted(users: Column) -> Column:
    """User messages of a unit; an injected one counts only if it hangs on an accepted one."""

    def step(acc: Column, u: Column) -> Column:
        ok = ~u["meta"] | F.array_contains(acc["ids"], u["parent"])
        grown = F.when(ok, F.array_append(acc["ids"], u["uuid"])).otherwise(acc["ids"])
        return F.struct(grown.alias("ids"), F.array_append(acc["ok"], ok).alias("ok"))

    start = F.struct(
        F.array().cast("array<string>").alias("ids"), F.array().cast("array<boolean>").alias("ok")
    )
    folded = F.aggregate(users, start, step)["ok"]
    kept = F.filter(users, lambda u, i: F.get(folded, i))
    return F.when(F.exists(users, lambda u: u["meta"]), kept).otherwise(users)


def _first_of(users: Column, name: str) -> Column:
    """First non-empty value among the user messages."""
    return F.get(F.filter(F.transform(users, lambda u: u[name]), lambda x: x != ""), F.lit(0))


def _restored(users: Column, command_files: Column) -> Column:
    """Texts of the user messages, with the first cut-off command body restored from its file."""
    name = F.get(
        F.filter(F.transform(users, lambda u: u["command"]), lambda c: c.isNotNull()), F.lit(0)
    )
    wanted = F.lower(F.concat(name, F.lit(".md")))
    body = F.get(F.filter(command_files, lambda f: f["name"] == wanted), F.lit(0))["body"]
    full = F.when(body != "", rstrip(body))

    def cut_off(u: Column, i: Column) -> Column:
        key = rstrip(u["plain"])
        return (
            (i > 0) & (u["plain"] != "") & (F.length(key) < F.length(full)) & full.startswith(key)
        )

    hits = F.transform(users, lambda u, i: F.coalesce(cut_off(u, i), F.lit(False)))
    hit = F.array_position(hits, F.lit(True))
    return F.transform(users, lambda u, i: F.when(i + 1 == hit, full).otherwise(u["text"]))


def roll_up(entries: DataFrame, progress: bool = False, progress_full: bool = False) -> DataFrame:
    """One row per unit.

    Everything but the user messages is a partial aggregate; a unit's question is one value, so
    its few messages are gathered. Progress text is gathered only on request.
    """
    role, final = F.col("role"), F.col("final")
    assistant = F.col("is_assistant")
    in_progress = (role == "P") | ((role == "A") & ~final)
    place = F.struct("place", "place_tie", "seq")
    model = F.col("model")
    usable = F.when(assistant & (model != SYNTHETIC), F.struct(final.alias("last"), place))
    said = (role == "A") & (F.col("a_text") != "")
    user = F.struct(
        "seq", "uuid", "parent", "meta", "text", "plain", "ts", "cwd", "version", "branch",
        "command", "replay_part",
    )
    aggs = [
        F.sort_array(F.collect_list(F.when(role == "U", user))).alias("_users"),
        F.max_by(F.struct("uuid", "cwd", "version", "branch"), F.when(final, F.col("seq"))).alias(
            "_final"
        ),
        F.max_by("a_text", F.when(said, F.col("seq"))).alias("answer"),
        F.max_by(model, usable).alias("model"),
        *totals(F.col("source"), F.col("has_usage") & assistant),
        F.count_if(in_progress).alias("progress_count"),
        F.sort_array(
            F.collect_list(
                F.when(
                    F.col("body").isNotNull(),
                    F.struct(place, F.col("body_name").alias("name"), "body"),
                )
            )
        ).alias("_command_files"),
    ]
    for f in ("cwd", "version", "branch"):
        c = F.col(f)
        aggs.append(F.min_by(c, F.when(in_progress & (c != ""), place)).alias(f"_p_{f}"))
    for name, lines, tail, wanted in (
        ("progress", "lines", "tail", progress),
        ("progress_full", "lines_full", "tail_full", progress_full),
    ):
        if wanted:
            shown = F.struct(final.alias("last"), place, F.when(final, F.col(tail)).otherwise(F.col(lines)).alias("l"))
            ordered = F.sort_array(F.collect_list(F.when(in_progress | final, shown)))
            flat = F.flatten(F.transform(ordered, lambda x: F.coalesce(x["l"], F.array().cast("array<string>"))))
            aggs.append(F.array_join(flat, "\n").alias(name))

    units = entries.groupBy(*UNIT).agg(*aggs)
    units = units.withColumn("_users", accepted(F.col("_users")))
    users = F.col("_users")
    texts = F.filter(_restored(users, F.col("_command_files")), lambda t: t != "")
    head = F.get(users, F.lit(0))
    parts = F.transform(users, lambda u: F.coalesce(u["replay_part"], F.lit("")))
    provable = (F.col("source") == SOURCE_B) & F.forall(parts, lambda p: p != "")
    raw_texts = F.transform(users, lambda u: u["plain"])
    uuids = F.transform(users, lambda u: u["uuid"])
    forks = F.filter(
        F.concat(uuids, F.array(F.coalesce(F.col("_final.uuid"), F.lit("")))), lambda k: k != ""
    )
    anchors = {
        f: F.coalesce(
            _first_of(users, f),
            F.when(F.col(f"_final.{f}") != "", F.col(f"_final.{f}")),
            F.col(f"_p_{f}"),
            F.lit(""),
        )
        for f in ("cwd", "version", "branch")
    }
    return units.select(
        *UNIT,
        head["uuid"].alias("q_uuid"),
        head["ts"].alias("ts_raw"),
        F.array_join(texts, "\n\n").alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("model", F.lit("")).alias("model"),
        *[c.alias(n) for n, c in anchors.items()],
        *FIELDS,
        "progress_count",
        F.when(F.col("source") == SOURCE_A, F.array_distinct(forks))
        .otherwise(F.array().cast("array<string>"))
        .alias("fork_keys"),
        F.when(provable, sha(F.array_join(parts, NUL))).otherwise("").alias("replay_key"),
        F.when(provable, sha(F.array_join(raw_texts, NUL))).otherwise("").alias("replay_hash"),
        *(["progress"] if progress else []),
        *(["progress_full"] if progress_full else []),
    )


def answers_given(entries: DataFrame) -> DataFrame:
    """(file_id, pair, hash) of every text a unit gave as its answer, the final one and earlier."""
    said = (F.col("role") == "A") & (F.col("a_text") != "")
    return entries.where(said).select("file_id", "pair", sha(F.col("a_text")).alias("hash"))


def signatures(entries: DataFrame, units: DataFrame) -> DataFrame:
    """Ordered progress signature of the given units only (records that show nothing left out)."""
    in_progress = (F.col("role") == "P") | ((F.col("role") == "A") & ~F.col("final"))
    sig = F.struct("place", "place_tie", "seq", "signature")
    ordered = F.sort_array(F.collect_list(sig))
    return (
        entries.where(in_progress & F.col("signature").isNotNull())
        .join(units.select(*UNIT), UNIT, "left_semi")
        .groupBy(*UNIT)
        .agg(F.transform(ordered, lambda s: s["signature"]).alias("signature"))
    )

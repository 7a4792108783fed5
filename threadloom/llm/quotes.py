"""Quotation linking: messages in reply order, without what they quote.

Lines that begin with ``>`` are quoted, as deep as they have such marks. Runs of lines of one depth
are passages. A passage, each of its paragraphs and each of its lines are normalised (lower case, single spaces) and
hashed, and joined to the messages that say them: as their whole text, a stretch of it between quotes, or one of the paragraphs
or lines. The original is the first such message of the same conversation, if that comes before the quoting one, otherwise
the first of all other conversations. Of the parts of a passage that have an original, the longest links it.

A message answers the latest original in its own conversation among its least deep linked passages; a
message that links to none stands by itself. Conversations are ordered by threads (first message first), then
depth of reply, then turn, so an answer follows what it answers. Depths come from pointer doubling over
written tables, in as many rounds as the depth has binary digits.

Originals are reduced to one per hash and conversation, and two per hash, before they are joined, so a common
passage joins one row of each. Null texts are empty; a null conv_id or turn is a value like others (its quotes count and link) but answers
nothing; repeated rows are separate messages in the order of their copy number. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import column, global_rank, ship
from threadloom.session import stage

ship(__name__)

MARKS = re.compile(r"^((?:[ \t]*>)+) ?(.*)$", re.S)
KEY = ["conv_id", "turn", "copy"]


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def key_of(text: str) -> bytes:
    return hashlib.md5(normal(text).encode()).digest()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]], list[str]]:
    """(own text, [(depth, passage)], stretches of own text between quotes) of a message."""
    own, passages, stretches, depth, run = [], [], [], 0, []

    def close() -> None:
        if run and normal(" ".join(run)):
            passages.append((depth, "\n".join(run)))
        run.clear()

    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        deep = m.group(1).count(">") if m else 0
        if deep != depth:
            close()
        if not deep and (depth or not stretches):
            stretches.append([])
        depth = deep
        if deep:
            run.append(m.group(2))
        else:
            own.append(line)
            stretches[-1].append(line)
    close()
    return "\n".join(own).strip("\n"), passages, ["\n".join(x) for x in stretches]


def parts(text: str) -> list[str]:
    """A text, its paragraphs and its lines, those with words."""
    found = dict.fromkeys([text, *re.split(r"\n\s*\n", text), *text.split("\n")])
    return [p for p in found if normal(p)]


def units(own: str, stretches: list[str]) -> set[bytes]:
    """Hashes of what a quote of this text may hold: all of it, its stretches, their paragraphs and lines."""
    return {key_of(p) for text in (own, *stretches) for p in parts(text)}


def _parse(batches):
    for rows in batches:
        own, depth, said = [], [], []
        for text in rows["text"]:
            clean, passages, stretches = parse(text)
            own.append(clean)
            depth.append([
                {"at": n, "depth": d, "part": k, "size": len(normal(p)), "key": key_of(p)}
                for n, (d, passage) in enumerate(passages) for k, p in enumerate(parts(passage))])
            said.append(sorted(units(clean, stretches)))
        yield rows.drop(columns=["text"]).assign(own=own, quotes=depth, said=said).astype({"conv_id": "Int64", "turn": "Int64"})


def link(messages: DataFrame) -> DataFrame:
    """One row per message.

    (conv_id, turn, copy, role, own text, n_quotes, n_linked, source_conv, source_turn, parent_turn, parent_copy,
    root_turn, depth, position): ``source`` is the first linked original anywhere, ``parent`` the message it answers,
    ``position`` its place in its conversation.
    """
    rows = messages.select(column(messages, "conv_id", "long").alias("conv_id"), column(messages, "turn", "long").alias("turn"),
                           column(messages, "role", "string").alias("role"), column(messages, "text", "string").alias("text"))
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    rows = rows.withColumn("copy", copy).select("conv_id", "turn", "copy", "role", "text")
    schema = "conv_id long, turn long, copy int, role string, own string, quotes array<struct<at:int,depth:int,part:int,size:int,key:binary>>, said array<binary>"
    typed = rows.mapInPandas(_parse, schema)
    parsed = stage(typed, "messages")
    said = parsed.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(*KEY, F.explode("said").alias("key"))
    here = said.groupBy("key", "conv_id").agg(F.min(F.struct("turn", "copy")).alias("here"))
    quoted = parsed.select(*KEY, F.explode("quotes").alias("q")).select(*KEY, "q.*")
    # the first original of a key, and the first of another conversation than that
    place = F.struct("conv_id", F.col("here.turn").alias("turn"), F.col("here.copy").alias("copy"))
    here = stage(here.join(quoted.select("key").distinct(), "key", "left_semi"), "originals")
    first = here.groupBy("key").agg(F.min(place).alias("any"), F.count("*").alias("convs"))
    many = here.join(first.filter("convs > 1"), "key").filter(F.col("conv_id") != F.col("any.conv_id"))
    second = many.groupBy("key").agg(F.min(place).alias("next"))
    first = first.join(second, "key", "left").select("key", "any", "next")
    joined = quoted.join(here, ["key", "conv_id"], "left").join(first, "key", "left")
    joined = joined.withColumn("any", F.when(F.col("any.conv_id") == F.col("conv_id"), F.col("next")).otherwise(F.col("any")))
    earlier = F.col("here") < F.struct(F.col("turn"), F.col("copy"))
    other = F.col("any").isNotNull()
    joined = joined.withColumn("to", F.when(earlier, F.struct(
        F.col("conv_id").alias("conv_id"), F.col("here.turn").alias("turn"), F.col("here.copy").alias("copy"))).when(other, F.col("any")))
    longest = F.max(F.when(F.col("to").isNotNull(), F.struct("size", (-F.col("part")).alias("part"), "to"))).alias("best")
    joined = joined.groupBy(*KEY, "at").agg(F.max("depth").alias("depth"), longest).select(*KEY, "depth", F.col("best.to").alias("to"))
    # of the least deep passages linked in the conversation, the latest original
    best = F.when(F.col("to.conv_id") == F.col("conv_id"), F.struct((-F.col("depth")).alias("x"), F.col("to.turn").alias("turn"), F.col("to.copy").alias("copy")))
    found = joined.groupBy(*KEY).agg(
        F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"), F.max(best).alias("p"), F.min("to").alias("source"))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in KEY], "n_quotes", "n_linked", "p", "source")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    links = stage(parsed.select(*KEY, "role", "own").join(found, same, "left").select(
        *KEY, "role", "own", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.col("source.conv_id").alias("source_conv"), F.col("source.turn").alias("source_turn"),
        F.col("p.turn").alias("parent_turn"), F.col("p.copy").alias("parent_copy")), "quotes")
    answers = links.filter("parent_turn IS NOT NULL").select(*KEY, F.struct(F.col("parent_turn").alias("turn"), F.col("parent_copy").alias("copy")).alias("up"), F.lit(1).alias("depth"))
    while True:  # ``up`` doubles its distance each round
        answers = stage(answers, "replies")
        next_ = answers.select("conv_id", F.struct("turn", "copy").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        if not answers.join(next_, ["conv_id", "up"], "left_semi").limit(1).count():
            break
        answers = answers.join(next_, ["conv_id", "up"], "left").select(
            *KEY, F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
    all_ = links.join(answers, KEY, "left").withColumn("depth", F.coalesce("depth", F.lit(0))).withColumn(
        "root", F.coalesce("up", F.struct("turn", "copy"))).withColumn("root_turn", F.col("root.turn")).withColumn("root_copy", F.col("root.copy")).drop("up", "root")
    ranked = global_rank(all_, ["conv_id", "root_turn", "root_copy", "depth", "turn", "copy"], "ordered")
    start = ranked.groupBy("conv_id").agg(F.min("rank").alias("start"))
    out = ranked.alias("r").join(start.alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")))
    return out.select(*[F.col(f"r.{c}") for c in (
        "conv_id", "turn", "copy", "role", "own", "n_quotes", "n_linked", "source_conv", "source_turn", "parent_turn", "parent_copy", "root_turn")],
        F.col("depth").cast("int").alias("depth"), (F.col("rank") - F.col("start")).alias("position"))

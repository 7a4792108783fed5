"""Segmentation of growing logs: unit numbers for lines as they arrive, in whatever order.

The state of a session is a few small values however long it gets, plus the lines that came before one they follow. Units
are decided line by line in file order, so a line waits until all earlier ones are there. A gap is given up after
``wait`` milliseconds without its lines, or when ``most`` lines wait behind it; the lines behind it are
numbered then. A line that comes after its place was passed, a repeated one too, is not counted but comes out marked
``late``, so nothing vanishes. A session keeps its state while silent: its next line goes on with the numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, seq bigint, kind string, pair bigint, opener boolean, answered boolean, late boolean"
STATE = "pair bigint, answered boolean, head string, next bigint, waiting string"
MOST_WAITING = 100_000


class Units:
    """Where a session stands: unit number, whether it is answered, and the parent of its first question."""

    def __init__(self, pair: int, answered: bool, head: str):
        self.pair, self.answered, self.head = pair, answered, head

    def take(self, kind: str, parent: str) -> tuple[int, bool, bool]:
        """(unit, opens it, answered before) of the next line."""
        fresh = kind in ("Q", "K") and (self.pair == 0 or self.answered)
        opener = fresh or (kind == "Q" and parent != "" and parent == self.head)
        if fresh:
            self.head = parent
        if opener:
            self.pair, self.answered = self.pair + 1, False
        found = self.pair, opener, self.answered
        if kind == "A" and self.pair:
            self.answered = True
        return found


def _advance(
    key, batches: Iterator[pd.DataFrame], state: GroupState, first: int | None, wait: int | None, most: int
) -> Iterator[pd.DataFrame]:
    """One micro-batch of a session, or the end of its wait."""
    start = -(2**63) if first is None else first
    pair, answered, head, due, waiting = state.get if state.exists else (0, False, "", start, "[]")
    units, out = Units(pair, answered, head), []
    held = {seq: (kind, parent) for seq, kind, parent in json.loads(waiting)}
    if not state.hasTimedOut:
        for rows in batches:
            for seq, kind, parent in zip(rows["seq"].tolist(), rows["kind"], rows["parent"], strict=True):
                if seq < due or seq in held:
                    out.append((seq, kind, None, False, None, True))
                else:
                    held[seq] = (kind, parent)
    give_up = first is None or state.hasTimedOut or len(held) > most
    for seq in sorted(held):
        if seq > due and not give_up:
            break
        out.append((seq, held[seq][0], *units.take(*held.pop(seq)), False))
        due = seq + 1
    state.update((units.pair, units.answered, units.head, due, json.dumps([(s, *held[s]) for s in sorted(held)])))
    if held and wait is not None:
        state.setTimeoutDuration(wait)
    if out:
        found = pd.DataFrame(out, columns=["seq", "kind", "pair", "opener", "answered", "late"])
        found.insert(0, "session", key[0])
        yield found.astype({"pair": "Int64", "answered": "boolean"})


def segment_stream(
    rows: DataFrame, first: int | None = None, wait: str | int | None = None, most: int = MOST_WAITING
) -> DataFrame:
    """Streaming counterpart of ``segment_a``. ``rows``: session, seq, kind, parent.

    With ``first``, ``seq`` numbers a session's lines without gaps from there on, as line numbers do. Without, it only orders
    them: nothing waits, the lines of a micro-batch are put in order, and one behind an earlier micro-batch is late. ``wait``
    (milliseconds) ends the wait for missing lines; without it only ``most`` does. Bound the micro-batches with the
    source's ``maxBytesPerTrigger``: each hands a session's new lines to one task.
    """
    wait = None if wait is None else int(wait)
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    kind, parent = F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("parent", F.lit("")).alias("parent")
    slim = rows.select("session", F.col("seq").cast("bigint"), kind, parent)

    def step(key, batches, state):
        return _advance(key, batches, state, first, wait, most)

    return slim.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append", timeout)

"""The cache of answers as keyed streaming state: the newest answers of each owner, until they are invalidated."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.config import DEFAULTS

EVENTS = "owner string, seq long, clear boolean, response string, embedding array<float>"
CHANGES = "owner string, seq long, change string, response string, embedding array<float>"
_NONE = -(1 << 63)


def trim_events(events: DataFrame, size: int = DEFAULTS.cache_size) -> DataFrame:
    """Of each Arrow batch the newest ``size`` answers and the last invalidation of an owner.

    Runs before the shuffle, so that a hot owner sends a bounded number of rows per batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values("seq")
            yield pd.concat([
                rows[~rows["clear"]].groupby("owner", sort=False).tail(size),
                rows[rows["clear"]].groupby("owner", sort=False).tail(1),
            ])

    return events.mapInPandas(run, EVENTS)


class AnswerCache(StatefulProcessor):
    """Holds the newest answers of an owner; an invalidation drops what came before it, also what arrives later."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answers = handle.getMapState("answers", "seq long", "response string, embedding array<float>")
        self.cleared = handle.getValueState("cleared", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0] for k in self.answers.keys()}
        before = cleared = self.cleared.get()[0] if self.cleared.exists() else _NONE
        fresh: dict[int, tuple] = {}
        for batch in rows:
            clears = batch.loc[batch["clear"], "seq"]
            cleared = max(cleared, int(clears.max())) if len(clears) else cleared
            for seq, response, vector in batch.loc[~batch["clear"], ["seq", "response", "embedding"]].itertuples(index=False):
                fresh[int(seq)] = (response, None if vector is None else [float(x) for x in vector])
            fresh = dict(sorted(fresh.items())[-self.size:])
        live = set(sorted(seq for seq in held | fresh.keys() if seq > cleared)[-self.size:])
        out = [(key[0], seq, "drop", None, None) for seq in sorted(held - live)]
        for _, seq, *_ in out:
            self.answers.removeKey((seq,))
        for seq in sorted(live - held):
            self.answers.updateValue((seq,), fresh[seq])
            out.append((key[0], seq, "put", *fresh[seq]))
        if cleared != before:
            self.cleared.update((cleared,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def answer_cache(events: DataFrame, size: int = DEFAULTS.cache_size) -> DataFrame:
    """Stream of what enters (``put``) and leaves (``drop``) each owner's cache.

    ``events``: owner, seq, clear, response, embedding; ``seq`` orders the answers and invalidations of an
    owner and is unique among them. Events without owner or seq are ignored, ``clear`` null means an
    answer. What the cache holds in the end does not depend on the cut into micro-batches; an event
    that comes again changes nothing.
    """
    known = events.select(
        F.col("owner").cast("string"), F.col("seq").cast("long"), F.coalesce("clear", F.lit(False)).alias("clear"),
        "response", F.col("embedding").cast("array<float>"),
    ).filter("owner IS NOT NULL AND seq IS NOT NULL")
    return trim_events(known, size).groupBy("owner").transformWithStateInPandas(AnswerCache(size), CHANGES, "Append", "None")


def held_answers(changes: DataFrame) -> DataFrame:
    """What the cache holds after the written changes: owner, seq, response, embedding. What left never returns."""
    gone = changes.filter("change = 'drop'").select("owner", "seq")
    # a micro-batch that was written twice puts the same answer
    puts = changes.filter("change = 'put'").select("owner", "seq", "response", "embedding").dropDuplicates(["owner", "seq"])
    return puts.join(gone, ["owner", "seq"], "left_anti")

"""Chat sessions as keyed streaming state: the last messages of each session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.config import DEFAULTS

MESSAGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)
OUTPUT = T.StructType([T.StructField("session_id", T.StringType()), *MESSAGE.fields])


def trim_batches(messages: DataFrame, size: int = DEFAULTS.session_size) -> DataFrame:
    """Keep the last ``size`` messages per session of each Arrow batch.

    Runs before the shuffle, so a session that floods the stream sends a bounded
    number of rows per batch to the one task that holds its state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values("seq").groupby("session_id", sort=False).tail(size)

    return messages.mapInPandas(run, OUTPUT)


class SessionLog(StatefulProcessor):
    """Holds the last messages of a session; emits them whenever they change.

    The time to live starts anew with each write, as the whole list is written.
    """

    def __init__(self, size: int, ttl_seconds: int | None) -> None:
        self.size, self.ttl_seconds = size, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = None if self.ttl_seconds is None else self.ttl_seconds * 1000
        self.log = handle.getListState("messages", MESSAGE, ttlDurationMs=ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.log.get()] if self.log.exists() else []
        for batch in rows:
            fresh = batch[["seq", "role", "content"]].itertuples(index=False, name=None)
            held = sorted({*held, *((int(s), r, c) for s, r, c in fresh)})[-self.size:]
        self.log.put(held)
        yield pd.DataFrame(
            [(key[0], *message) for message in held], columns=["session_id", "seq", "role", "content"]
        )

    def close(self) -> None:
        pass


def session_log(
    messages: DataFrame, size: int = DEFAULTS.session_size, ttl_seconds: int | None = None
) -> DataFrame:
    """Stream of the retained messages of each session that changed.

    ``messages``: session_id, seq, role, content. Give ``ttl_seconds`` in
    long-running queries only; a bounded run ends by itself without it.
    """
    return (
        trim_batches(messages.select("session_id", "seq", "role", "content"), size)
        .groupBy("session_id")
        .transformWithStateInPandas(
            SessionLog(size, ttl_seconds), OUTPUT, "Update",
            "None" if ttl_seconds is None else "ProcessingTime",
        )
    )

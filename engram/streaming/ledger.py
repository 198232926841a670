"""Facts and document statuses as keyed streaming state, with timers.

Within a micro-batch the rows of a key are taken in order of time and id; a row's own time decides what
is forgotten by then, so the result does not depend on how ordered rows are cut into micro-batches.
Timers only tidy up keys that hear nothing more. Calling Python costs far more per key than deciding, so
keys are dealt by hash to ``SHARDS`` groups that keep the state of their keys together; a shard is read and
written whole when one of its keys has rows. The number of shards belongs to a stream's checkpoint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.config import DEFAULTS, Settings
from engram.functions.text import is_singular
from engram.schemas import PINNED

HELD = "held array<struct<entity_id: string, attribute: string, id: string, val: string, last_accessed_us: bigint, expires_us: bigint>>"
DECISIONS = "entity_id string, attribute string, id string, action string, closed_id string, at_us long"
STATUS = "held array<struct<document_id: string, status: string, at_us: bigint>>"
VERDICTS = "document_id string, id string, status string, action string, held string, error_message string, at_us long"
#: What a document may become; before the first row it has no status.
TRANSITIONS = {
    None: ("pending",), "pending": ("processing", "failed"), "processing": ("completed", "failed"),
    "completed": (), "failed": ("pending",),
}
SHARDS = 8192
_NEVER = 1 << 62
_NO_TIME = -1 << 63


def _micros(time: str) -> Column:
    return F.coalesce(F.unix_micros(time), F.lit(_NO_TIME)).alias("us")


def _sharded(rows: DataFrame, keys: list[str], decide, out: str, held: str) -> DataFrame:
    """What ``decide`` makes of the rows of each shard of keys, with its times as timestamps."""
    shards = rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(SHARDS))).groupBy("shard")
    decided = shards.applyInPandasWithState(decide, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    at = F.when(F.col("at_us") != _NO_TIME, F.timestamp_micros("at_us")).alias("at")
    return decided.select(*(c for c in decided.columns if c != "at_us"), at)


def _taken(rows: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    """The rows of one shard in a micro-batch as (us, id, ...), in order."""
    taken = [row for part in rows for row in zip(*(part[c].tolist() for c in ("us", "id", *columns)))]
    return sorted(taken, key=lambda row: (row[0], row[1] is None, row[1] or ""))


def _rows(out: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])


def _wake(state: GroupState, at_ms: int) -> None:
    """Call again when the watermark has passed ``at_ms``."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs() + 1))


def _expiry(stability: float, since_us: int, settings: Settings) -> int:
    """When retention falls below the cut-off."""
    if stability == PINNED:
        return _NEVER
    days = stability if stability > 0 else settings.default_stability_days
    return since_us + math.ceil(days * 24 * 3.6e9 * -math.log(settings.retention_cutoff))


def _forgotten(key: tuple, held: list[tuple], now_us: int) -> tuple[list[tuple], list[tuple]]:
    gone = [(*key, h[0], "forget", None, h[3]) for h in held if h[3] < now_us]
    return [h for h in held if h[3] >= now_us], gone


def _ledger(settings: Settings):
    """The open values of each entity and attribute of a shard; decides what each new fact does to them."""

    def decide(shard: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, out = {}, []
        for entity, attribute, *value in state.get[0] if state.exists else ():
            open_.setdefault((entity, attribute), []).append(tuple(value))
        if state.hasTimedOut:
            for key, held in open_.items():
                open_[key], gone = _forgotten(key, held, state.getCurrentWatermarkMs() * 1000)
                out += gone
        else:
            for now_us, fact_id, entity, attribute, val, stability, singular in _taken(
                rows, "entity_id", "attribute", "val", "stability", "singular"
            ):
                key = entity, attribute
                held, gone = _forgotten(key, open_.get(key, ()), now_us)
                out += gone
                fresh = (fact_id, val, now_us, _expiry(stability, now_us, settings))
                same, last = any(h[1] == val for h in held), held[-1][0] if held else None
                if not held:
                    action, held = "insert", [fresh]
                elif singular:
                    action, last = ("skip", None) if held[-1][1] == val else ("supersede", last)
                    held = held if action == "skip" else [fresh]
                else:
                    action, last = "skip" if same else "coexist", None
                    held = held if same else [*held, fresh]
                open_[key] = held
                out.append((*key, fact_id, action, last, now_us))
        values = [(*key, *value) for key, held in open_.items() for value in held]
        if values:
            state.update((values,))
            soonest = min(value[-1] for value in values)
            if soonest < _NEVER:
                _wake(state, soonest // 1000 + 1)
        else:
            state.remove()
        yield _rows(out, DECISIONS)

    return decide


def fact_ledger(facts: DataFrame, delay: str = "1 hour", settings: Settings = DEFAULTS) -> DataFrame:
    """What each fact of a stream does: insert, skip, supersede (``closed_id``) or coexist; and what is forgotten.

    ``facts``: id, entity_id, attribute, val, valid_from, stability. Rows later than ``delay`` are dropped
    by the watermark. A value equal to an open one is skipped, whether it was read meanwhile or not; a value
    whose retention fell below the cut-off before the new row's time is forgotten first.
    """
    rows = facts.select(
        "id", "entity_id", "attribute", "val", "valid_from", F.coalesce("stability", F.lit(0.0)).alias("stability"),
        is_singular(F.col("attribute")).alias("singular"), _micros("valid_from"),
    ).withWatermark("valid_from", delay)
    return _sharded(rows, ["entity_id", "attribute"], _ledger(settings), DECISIONS, HELD)


def _machine(stuck_ms: int):
    """The status of each document of a shard; refuses what it may not become, and ends what is stuck."""

    def decide(shard: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_by = {d: (status, at) for d, status, at in state.get[0]} if state.exists else {}
        out = []

        def end_stuck(document: str, now_us: int) -> None:
            held, at = held_by.get(document, (None, None))
            if held == "processing" and now_us >= at + 1000 * stuck_ms:
                at += 1000 * stuck_ms
                out.append((document, None, "failed", "stuck", held, "stuck in processing", at))
                held_by[document] = "failed", at

        if state.hasTimedOut:
            for document in held_by:
                end_stuck(document, state.getCurrentWatermarkMs() * 1000)
        else:
            for now_us, row_id, document, status, error in _taken(rows, "document_id", "status", "error_message"):
                end_stuck(document, now_us)
                held, _ = held_by.get(document, (None, None))
                if status in TRANSITIONS[held]:
                    out.append((document, row_id, status, "accept", held, error, now_us))
                    held_by[document] = status, now_us
                else:
                    out.append((document, row_id, status, "refuse", held, error, now_us))
        if held_by:
            state.update(([(document, *held) for document, held in held_by.items()],))
        running = [at for status, at in held_by.values() if status == "processing"]
        if running:
            _wake(state, min(running) // 1000 + stuck_ms)
        yield _rows(out, VERDICTS)

    return decide


def status_machine(log: DataFrame, stuck_after: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Each status row with ``action`` accept or refuse and the status ``held`` before; rows ``stuck`` end a
    document that has been processing for ``stuck_after`` seconds.

    ``log``: document_id, id, status, error_message, updated_at. Rows later than ``delay`` are dropped by
    the watermark.
    """
    rows = log.select("document_id", "id", "status", "error_message", "updated_at", _micros("updated_at"))
    rows = rows.withWatermark("updated_at", delay)
    return _sharded(rows, ["document_id"], _machine(1000 * stuck_after), VERDICTS, STATUS)

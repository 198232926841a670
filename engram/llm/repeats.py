"""Removal of repeated byte strings over a whole corpus, by prefix-free parsing.

A rolling hash over 28-byte windows sets triggers: every string of ``length`` bytes holds the
leftmost least hash among its windows, which depends on the string alone. The strings that share a
trigger make one phrase, so phrases overlap by ``length - 1`` bytes, no trigger is the start of
another phrase's inside, and every string of ``length`` bytes lies in exactly one phrase.

1. Triggers are counted. One that occurs once in the corpus has a phrase without repeats.
2. The phrases of repeated triggers are parsed out with their bytes and dealt by trigger, once.
   Of equal phrases (the dictionary) the first in corpus order stays and all others are repeats as
   a whole; map tasks already fold equal phrases of a piece of text.
3. Distinct phrases of one trigger may still share strings. The suffixes of at least ``length``
   bytes of such dictionary phrases are sorted by hash within their trigger; equal neighbours are
   repeats except the first in corpus order. That is the part of the corpus's suffix order in which
   common prefixes reach ``length``.
4. Spans go back to their documents, which drop the bytes covered.

A full suffix array of dictionary and parse would order all the unrepeated text as well, several
times the input in shuffles; the result here is the same. A trigger with more phrases than one
task should sort goes phrase by phrase and string by string through combinable aggregates. Which
triggers are worth parsing in step 2 is told by a bit filter of a bounded size; a full one lets
unrepeated phrases through, which costs time and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from engram.llm import kernels
from engram.session import checkpoint

WINDOW = 28
#: Bits of a sort key that hold the place, the same for every piece so that ties fall alike.
PLACE_BITS = 31
#: Bound of the bit filter of repeated triggers (32 MB).
FILTER_BITS = 1 << 28
#: Phrases of one trigger that one task sorts.
GROUP = 50_000


def _slide_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` keys, by block-wise running minima from both sides."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def parse(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The phrases of documents: doc (index), lo (byte in doc), n (strings), trigger, phrase (hashes)."""
    begin = int(offsets[0])
    body, offsets = data[begin : int(offsets[-1])], offsets - begin
    width = length - WINDOW + 1
    starts = np.diff(offsets) - length + 1
    empty = {"doc": np.zeros(0, np.int64), "lo": np.zeros(0, np.int64), "n": np.zeros(0, np.int64),
             "trigger": np.zeros(0, np.uint64), "phrase": np.zeros(0, np.uint64)}
    if not (starts > 0).any():
        return empty
    running, down = kernels.prefix_hash(body), kernels.power("down", len(body))
    hashes = kernels.mix((running[WINDOW:] - running[:-WINDOW]) * down[: len(running) - WINDOW])
    # the hash decides, the place settles ties for the leftmost
    low = np.uint64((1 << PLACE_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    at = (_slide_least(keys, width) & low).astype(np.int64)
    own = starts > 0
    edge = np.zeros(len(body) + 1, np.int32)
    np.add.at(edge, offsets[:-1][own], 1)
    np.add.at(edge, offsets[:-1][own] + starts[own], -1)
    valid = np.cumsum(edge)[: len(at)] > 0
    where = np.flatnonzero(valid)
    at = at[where]
    new = np.ones(len(where), bool)
    new[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(new)
    lo, n = where[first], np.diff(np.append(first, len(where)))
    doc = np.searchsorted(offsets, lo, "right") - 1
    phrase = kernels.mix((running[lo + n + length - 1] - running[lo]) * down[lo] + n.astype(np.uint64))
    trigger = at[first]
    shift = (trigger - lo).astype(np.uint64)
    return {"doc": doc, "lo": lo - offsets[doc], "n": n, "trigger": hashes[trigger], "phrase": kernels.mix(phrase ^ shift)}


def _pieces(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = kernels.texts(batch.column(1))
        for a, b in kernels.pieces(offsets):
            yield ids[a:b], data, offsets[a : b + 1]


def _count(length: int):
    """Per piece of text, how often a trigger occurs (2 for more) and with how many phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in _pieces(batches):
            found = parse(data, offsets, length)
            order = np.lexsort((found["phrase"], found["trigger"]))
            t, p = found["trigger"][order], found["phrase"][order]
            first = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
            fresh = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))[: len(t)].astype(np.int64)
            times = np.diff(np.append(first, len(t)))
            phrases = np.add.reduceat(fresh, first) if len(t) else fresh
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[first].view(np.int64)), pa.array(np.minimum(times, 2).astype(np.int64)), pa.array(phrases)],
                names=["trigger", "times", "phrases"])

    return run


def _later(new: np.ndarray, ids: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Of runs of equals in corpus order, those that don't stand at the place of their run's first."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (ids != ids[first]) | (lo != lo[first])


def merge_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans per document, as maximal runs."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    base = (np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.append(True, start[1:] + base[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - base[first]


SPANS = "id bigint, lo int, hi int"
PHRASES = "trigger bigint, phrase bigint, id bigint, lo int, n int, body binary, hi int"


def _phrases(shared, length: int):
    """Phrases with a maybe repeated trigger; of equal ones in a piece the first, the others as spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value
        for ids, data, offsets in _pieces(batches):
            found = parse(data, offsets, length)
            slot = found["trigger"] & np.uint64(mask)
            hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            found = {k: v[hit] for k, v in found.items()}
            doc, lo, n = found["doc"], found["lo"], found["n"]
            order = np.lexsort((lo, ids[doc], found["phrase"], found["trigger"]))
            t, p = found["trigger"][order], found["phrase"][order]
            new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))[: len(order)]
            rest, own = order[_later(new, ids[doc[order]], lo[order])], np.sort(order[new])
            who, start, end = merge_spans(ids[doc[rest]], lo[rest], lo[rest] + n[rest] + length - 1)
            begin = offsets[doc[own]] + lo[own]
            body = [data[s : s + k + length - 1].tobytes() for s, k in zip(begin.tolist(), n[own].tolist())]
            blank = pa.nulls(len(who), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(found["trigger"][own].view(np.int64)), blank]),
                pa.concat_arrays([pa.array(found["phrase"][own].view(np.int64)), blank]),
                pa.array(np.concatenate([ids[doc[own]], who]).astype(np.int64)),
                pa.array(np.concatenate([lo[own], start]).astype(np.int32)),
                pa.concat_arrays([pa.array(n[own].astype(np.int32)), pa.nulls(len(who), pa.int32())]),
                pa.concat_arrays([pa.array(body, pa.binary()), pa.nulls(len(who), pa.binary())]),
                pa.concat_arrays([pa.nulls(len(own), pa.int32()), pa.array(end.astype(np.int32))]),
            ], names=["trigger", "phrase", "id", "lo", "n", "body", "hi"])

    return run


def _suffixes(trigger: np.ndarray, body: pa.Array, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all strings of the phrases (mixed with their trigger), their phrase's row and offset."""
    data, offsets = kernels.texts(body)
    flat = data[int(offsets[0]) : int(offsets[-1])]
    running, down = kernels.prefix_hash(flat), kernels.power("down", len(flat))
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (offsets[:-1] - offsets[0])[row] + offset
    hashes = kernels.mix((running[at + length] - running[at]) * down[at])
    return kernels.mix(hashes ^ trigger[row]), row, offset


def _sorted(length: int):
    """Of phrases sorted by trigger, the spans that also occur earlier; spans pass through."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        given = table.filter(pc.is_null(table.column("trigger"))).select(["id", "lo", "hi"])
        table = table.filter(pc.is_valid(table.column("trigger"))).combine_chunks()
        ids, lo, n = (table.column(c).to_numpy() for c in ("id", "lo", "n"))
        trigger, phrase = (table.column(c).to_numpy().view(np.uint64) for c in ("trigger", "phrase"))
        order = np.lexsort((lo, ids, phrase, trigger))
        t, p = trigger[order], phrase[order]
        new = np.append(True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]))[: len(order)]
        whole = order[_later(new, ids[order], lo[order])]
        first = order[new]
        kinds = np.unique(trigger[first], return_inverse=True, return_counts=True)
        first = first[kinds[2][kinds[1]] > 1] if len(first) else first
        first = first[np.lexsort((lo[first], ids[first]))]
        body = table.column("body").combine_chunks().take(pa.array(first))
        hashes, row, offset = _suffixes(trigger[first], body, n[first], length)
        by = np.argsort(hashes, kind="stable")
        new = np.append(True, hashes[by[1:]] != hashes[by[:-1]])[: len(by)]
        who, start = ids[first][row[by]], lo[first][row[by]] + offset[by]
        later = _later(new, who, start)
        parts = [
            (given.column("id").to_numpy(), given.column("lo").to_numpy(), given.column("hi").to_numpy()),
            (ids[whole], lo[whole], lo[whole] + n[whole] + length - 1),
            (who[later], start[later], start[later] + length),
        ]
        out = merge_spans(*(np.concatenate([np.asarray(x[i], np.int64) for x in parts]) for i in range(3)))
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0]), *(pa.array(x.astype(np.int32)) for x in out[1:])], names=["id", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < GROUP:
                continue
            table = pa.Table.from_batches(held)
            last = pc.equal(table.column("trigger"), table.column("trigger")[-1]).to_numpy()
            at = np.flatnonzero(np.equal(last, True))  # sorted: the last trigger may go on
            cut = int(at[0]) if len(at) else table.num_rows
            if cut:
                yield judge(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield judge(pa.Table.from_batches(held))

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lo, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            trigger = batch.column(0).to_numpy().view(np.uint64)
            hashes, row, offset = _suffixes(trigger, batch.column(4), n, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(ids[row]), pa.array((lo[row] + offset).astype(np.int32))],
                names=["string", "id", "lo"])

    return run


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``id, lo, hi``: byte spans (end exclusive, may overlap) covered by strings that start earlier too."""
    spark = docs.sparkSession
    rows = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.encode(F.col(text), "UTF-8").alias("body")).where(F.length("body") >= length)
    counted = rows.mapInArrow(_count(length), "trigger bigint, times bigint, phrases bigint").groupBy("trigger").agg(
        F.sum("times").alias("times"), F.sum("phrases").alias("phrases"))
    repeated = checkpoint(counted.where("times > 1").select("trigger", "phrases"))
    size = 1 << 16
    while size < FILTER_BITS and size < 32 * repeated.count():
        size *= 2
    slot = F.col("trigger").bitwiseAND(F.lit(size - 1))
    words = repeated.groupBy(F.shiftrightunsigned(slot, 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(trigger & 63 as int))")).alias("b")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    parsed = rows.mapInArrow(_phrases(spark.sparkContext.broadcast((bits, size - 1)), length), PHRASES)
    hot = repeated.where(F.col("phrases") > GROUP).select("trigger")
    spans = []
    if not hot.isEmpty():
        parsed = checkpoint(parsed)
        spans = _hot_spans(parsed.join(hot, "trigger", "left_semi").select(parsed.columns), length)
        parsed = parsed.join(hot, "trigger", "left_anti").select(parsed.columns)
    # spans found in a piece have no trigger and are dealt by place
    dealt = parsed.repartition(F.coalesce("trigger", F.xxhash64("id", "lo"))).sortWithinPartitions("trigger")
    spans.append(dealt.mapInArrow(_sorted(length), SPANS))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return checkpoint(out)


def _hot_spans(phrases: DataFrame, length: int) -> list[DataFrame]:
    """The same for triggers with many phrases, by aggregates that combine before the shuffle."""
    phrases = checkpoint(phrases)
    places = phrases.select("trigger", "phrase", "id", "lo", "n")
    first = checkpoint(places.groupBy("trigger", "phrase").agg(F.min(F.struct("id", "lo")).alias("first")).select(
        "trigger", "phrase", F.col("first.id").alias("i"), F.col("first.lo").alias("l")))
    later = places.join(first, ["trigger", "phrase"]).where("id != i OR lo != l").select(
        "id", "lo", (F.col("lo") + F.col("n") + length - 1).cast("int").alias("hi"))
    kinds = first.toDF("trigger", "phrase", "id", "lo")
    bodies = phrases.join(kinds, ["trigger", "phrase", "id", "lo"], "left_semi").select("trigger", "id", "lo", "n", "body")
    strings = checkpoint(bodies.mapInArrow(_strings(length), "string bigint, id bigint, lo int"))
    least = strings.groupBy("string").agg(F.min(F.struct("id", "lo")).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = strings.join(least, "string").where("id != first.id OR lo != first.lo").select(
        "id", "lo", (F.col("lo") + length).cast("int").alias("hi"))
    return [later, again]


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [], [])
        for text, spans in zip(batch.column(1), batch.column(2)):
            body = text.as_py() or b""
            doc = np.array([[s["lo"], s["hi"]] for s in spans.as_py() or []], np.int64).reshape(-1, 2)
            _, lo, hi = merge_spans(np.zeros(len(doc), np.int64), doc[:, 0], doc[:, 1])
            at = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(body)]
            out[0].append(len(body))
            out[1].append(int((hi - lo).sum()))
            out[2].append(len(lo))
            out[3].append(b"".join(body[a:b] for a, b in zip(at[::2], at[1::2])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining UTF-8 bytes) of every row.

    A byte goes when a string of ``length`` bytes that covers it also starts earlier: in a document
    of smaller id, or earlier in the same one. Strings never cross documents and are judged on the
    input. Null texts are empty; rows without an id are neither compared nor changed. Rows that
    repeat an id should repeat its text: they stand at the same place and don't repeat each other.
    Other columns are ignored; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, doc_id, text, length).groupBy(F.col("id").alias("i")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b"")).alias("body"))
    found = rows.join(spans, F.col("id") == F.col("i"), "left").select("id", "body", "spans")
    return found.mapInArrow(_cut, RESULT).withColumnRenamed("id", doc_id)


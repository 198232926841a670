"""Near-duplicate documents by b-bit MinHash.

Each text becomes the set of its distinct five-word shingles. 128 minima are taken; bands of a few
full minima, as the threshold needs, name candidates, and of each minimum only four bits are kept, packed in eight longs.
Candidates are first judged by the similarity that the packed bits suggest, corrected for chance
collisions, with five standard deviations of slack, then by their whole sets.

* Equal sets are one class from the start, so copies cost one row each.
* In a bucket everything is compared with one pivot; what lies in the pivot's component then needs
  no further comparison. Members too few of whose shingles occur in any other open member drop
  out, exactly. When what is left over is at most linear in the input, each remaining member is
  compared with all of its bucket outside its own component, which makes the components those of
  all candidate pairs. No bucket is gathered in a task, and a pair is only listed where bounds on
  the shared shingles and the packed bits allow a link.
* Bands have as many minima as keep the share of pairs at the threshold that share no band below one
  in a million: at 0.85 twenty-five bands of five (one pair in two million), at 0.8 thirty-two of four
  (one in twenty million). More alike pairs are missed less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from engram.llm import kernels
from engram.llm.components import components, in_tasks
from engram.session import checkpoint

HASHES, BITS = 128, 4
#: Share of the pairs at the threshold that may share no band.
MISSED = 1e-6
#: Standard deviations of slack for the similarity that packed bits suggest.
SLACK = 5
#: Comparisons of packed bits that the closing comparison may make, per document; above it more
#: pivots are tried first, as long as each halves what is left.
LINEAR = 100
#: What a task of a step may hold, where the session has more partitions than that needs: shingles, of which
#: each document counts as some more for its bands.
TASK_SHINGLES, BANDS_AS = 1 << 20, 256

_odd = kernels.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_salt = kernels.mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of non-empty sets under each hash function, a row per set."""
    out = np.empty((len(sets), HASHES), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 1 << 15):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]])]).astype(np.int64)
        hashed = np.empty_like(flat)
        for k in range(HASHES):
            np.multiply(flat, _odd[k], out=hashed)
            out[first:last, k] = np.minimum.reduceat(hashed, at)
        first = last
    return out


def banding(threshold: float) -> tuple[int, int]:
    """Bands, and minima in each: the longest bands that miss few enough pairs at ``threshold``."""
    for rows in range(HASHES, 1, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= MISSED:
            return HASHES // rows, rows
    return HASHES, 1


def _bands(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minima), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(minima), band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = kernels.mix(key * np.uint64(0xD6E8FEB86659FD93) + minima[:, k])
        out[:, band] = key
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    low = kernels.mix(minima ^ _salt[None, :]) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(low.reshape(len(minima), HASHES // per, per) << shifts, axis=2)


FEATURES = "id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>, bands array<bigint>"


def _features(shape: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.texts(batch.column(1))
            for a, b in kernels.pieces(offsets):
                sets = kernels.shingle_sets(data, offsets[a : b + 1])
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                minima = signatures([sets[i] for i in some])
                marks = np.zeros((2, len(sets)), np.uint64)
                for i in some:
                    marks[0, i] = np.bitwise_xor.reduce(sets[i])
                    marks[1, i] = np.add.reduce(kernels.mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)))
                lists = []
                for rows in (_packed(minima), _bands(minima, *shape)):
                    at = np.zeros(len(sets), np.int64)
                    at[some] = rows.shape[1]
                    ends = np.concatenate([[0], np.cumsum(at)]).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.view(np.int64).ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *(pa.array(m.view(np.int64)) for m in marks), *lists],
                    names=["id", "n_shingles", "f1", "f2", "sig", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = kernels.texts(batch.column(1))
        for a, b in kernels.pieces(offsets):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), kernels.as_lists(kernels.shingle_sets(data, offsets[a : b + 1]))],
                names=["id", "shingles"],
            )


def shingle_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, shingles`` (distinct, sorted 64-bit hashes) of each document."""
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        _sets, "id bigint, shingles array<bigint>"
    )


def similarity(a: Column, b: Column) -> Column:
    """The set similarity that two packed signatures suggest, corrected for chance collisions."""
    differing = F.lit(0)
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 2.0**-BITS
    return (1 - differing / HASHES - chance) / (1 - chance)


class _Links:
    """Judges pairs of classes and keeps the links found so far."""

    def __init__(self, sig: DataFrame, sets: DataFrame, threshold: float, size: int):
        self.sig, self.size = sig, size
        self.dealt = partial(in_tasks, count=size, each=TASK_SHINGLES)
        self.sets, self.threshold, self.found, self.forest = sets, threshold, [], None
        p = 2.0**-BITS + (1 - 2.0**-BITS) * threshold
        self.floor = threshold - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - 2.0**-BITS)

    def judge(self, pairs: DataFrame) -> None:
        """``pairs`` has a and b, in any order and repeated."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = (
            self.dealt(self.dealt(pairs).join(self.sig.toDF("a", "sig_a"), "a")).join(self.sig.toDF("b", "sig_b"), "b")
            .where(similarity(F.col("sig_a"), F.col("sig_b")) >= self.floor).select("a", "b")
        )
        both = self.dealt(self.dealt(near).join(self.sets.toDF("b", "set_b"), "b")).join(self.sets.toDF("a", "set_a"), "a")
        shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
        union = F.size("set_a") + F.size("set_b") - shared
        whole = round(self.threshold * 100)
        self.found.append(checkpoint(self.dealt(both.where(100 * shared >= whole * union).select("a", "b"))))

    def components(self) -> DataFrame:
        """Components of all links so far: earlier ones take part as one edge to the component's name."""
        links = self.found[0]
        for more in self.found[1:]:
            links = links.unionByName(more)
        if self.forest is not None:
            links = links.unionByName(self.forest)
        found, self.found = components(self.dealt(links), most=self.size // BANDS_AS), []
        self.forest = found.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a != b")
        return found


def _able(sets: DataFrame, threshold: float) -> DataFrame:
    """``id, n, s`` of the sets of which enough shingles (``s``) occur in another one too.

    No two sets share more than the lesser ``s``, which bounds their similarity from above.
    """
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").select("shingle")
    s = each.join(common, "shingle", "left_semi").groupBy("id").agg(F.count("*").alias("s"))
    n = sets.select("id", F.size("shingles").cast("long").alias("n"))
    return n.join(s, "id").where(F.lit(100) * F.col("s") >= round(threshold * 100) * F.col("n"))


_COMPARED = ("id", "component", "n", "s", "sig", "keys")


def _across(minor: DataFrame, every: DataFrame, links: _Links, last: bool) -> DataFrame:
    """Pairs of a bucket's ``minor`` rows with its rows in other components that may reach the threshold."""
    dealt, threshold, floor = links.dealt, links.threshold, links.floor
    own = dealt(dealt(every.groupBy("id").agg(F.collect_set("key").alias("keys"))).join(links.sig, "id"))
    left = dealt(minor.join(own, "id")).select("key", *(F.col(c).alias(f"{c}_a") for c in _COMPARED))
    right = dealt(every.join(own, "id")).select("key", "main", *(F.col(c).alias(f"{c}_b") for c in _COMPARED))
    least = F.least("s_a", "s_b")
    may = (
        (left["key"] == right["key"]) & (F.col("component_a") != F.col("component_b"))
        & (F.lit(100) * least >= round(threshold * 100) * (F.col("n_a") + F.col("n_b") - least))
        & (similarity(F.col("sig_a"), F.col("sig_b")) >= floor)
    )
    # a pair that shares several of the open buckets is listed in one of them
    may = may & (F.array_min(F.array_intersect("keys_a", "keys_b")) == left["key"])
    if last:  # of two minor rows one order is enough
        may = may & ((F.col("component_b") == F.col("main")) | (F.col("id_a") < F.col("id_b")))
    return left.join(right, may).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    a, b = found.toDF("a", "of_a"), found.toDF("b", "of_b")
    placed = pairs.join(a, "a", "left").join(b, "b", "left")
    return placed.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked when the similarity of their shingle sets is at least ``threshold``
    (whole hundredths); a component is named after its smallest id, and that document is kept.
    Texts that are null, empty or without words have no shingles and link with nothing, nor do
    rows without an id (component null, kept). Rows repeating an id count as one document with
    all their links. Other columns are ignored, whatever their names; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    features = checkpoint(rows.mapInArrow(_features(banding(threshold)), FEATURES))
    n, size = features.agg(F.count("*"), F.coalesce(F.sum(F.col("n_shingles") + BANDS_AS), F.lit(0))).first()
    dealt = partial(in_tasks, count=size, each=TASK_SHINGLES)
    grouped = features.where("n_shingles > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n_shingles").agg(
        F.min("id").alias("id"), F.any_value(F.struct("sig", "bands")).alias("s"))
    classes = checkpoint(dealt(grouped.select("f1", "f2", "n_shingles", "id", "s.sig", "s.bands")))
    banded = classes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("pivot")).where("m > 1")
    members = checkpoint(dealt(banded.join(dealt(shared), "key").select("key", "id", "pivot", "m")))
    wanted = dealt(members.select("id").distinct())
    sets = checkpoint(shingle_table(dealt(rows.join(wanted, "id", "left_semi").dropDuplicates(["id"])), "id", "text"))
    sig = dealt(classes.groupBy("id").agg(F.any_value("sig").alias("sig")))
    links = _Links(sig, sets, threshold, size)
    # one pivot of each member first: in a group of near copies this leaves few of its other pivots to compare with
    pairs = checkpoint(dealt(members.where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()))
    links.judge(dealt(pairs.groupBy("a").agg(F.min("b").alias("b"))))
    found = links.components()
    links.judge(_apart(pairs, found))
    found = links.components()
    able, tried, before = None, 0, None
    while True:
        placed = dealt(members.join(found, "id", "left")).select("key", "id", "m", F.coalesce("component", "id").alias("component"))
        if able is not None:
            placed = dealt(placed.drop("m").join(able, "id"))
        sizes = dealt(placed.groupBy("key", "component").agg(F.count("*").alias("k")))
        split = sizes.groupBy("key").agg(
            F.max("k").alias("most"), F.sum("k").alias("all"), F.max_by("component", F.struct("k", "component")).alias("main")
        ).where("most < all")
        open_ = checkpoint(dealt(placed.join(dealt(split).select("key", "all", "main"), "key")))
        cost = open_.where("component != main").agg(F.sum("all")).first()[0]
        if not cost:
            break
        if able is None:  # now that few are left, drop what can't reach the threshold with any of them
            own = dealt(sets.join(dealt(open_.select("id").distinct()), "id", "left_semi"))
            able = checkpoint(dealt(_able(own, threshold)))
            continue
        last = cost <= LINEAR * n or before is not None and 2 * cost > before
        before = cost
        minor = open_.where("component != main")
        if not last:
            pivots = minor.groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(tried))).alias("pivot"))
            minor = dealt(open_.join(dealt(pivots), "key").where("id = pivot"))
        pairs = _across(minor, open_, links, last)
        links.judge(pairs)
        found = links.components()
        tried += 1
        if last:
            break
    by_class = dealt(classes.join(found, "id", "left")).select(
        "f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
    return (
        features.select("id", "f1", "f2", "n_shingles")
        .join(by_class, ["f1", "f2", "n_shingles"], "left")
        .select(
            F.col("id").alias(doc_id), "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))
    )

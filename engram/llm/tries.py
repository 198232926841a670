"""The prefix trie of conversations, in node tables addressed by minimal perfect hashes.

1. Each turn becomes 128 bits of its role and text. Conversation c begins with the first turns of
   another one (at most three, looked up by a join) and goes on with its own.
2. All turns are range-partitioned by conversation and position, so that a partition is a run of
   conversations of bounded size, whatever one conversation holds; what spans partitions is continued
   by a few numbers per partition. The digest of a prefix is the sum of its turns times powers, in two
   lanes of 64 bits.
3. A partition is a shard. Its distinct prefix digests get slots by a minimal perfect hash; a lookup
   compares the whole digest. Ends of conversations are scattered into flat arrays and summed up
   through the array of parent slots, deepest nodes first. A conversation continued from an earlier
   partition has a shard of its own there.
4. Nodes of the same digest are merged over the shards, which gives members and smallest member. Each
   node's own leaf and tokens are then charged once, in the shard where its smallest member passes,
   and again summed up through parent slots; the sums of the shards are added by node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from engram.llm import kernels
from engram.session import checkpoint

#: Conversations borrow from the one whose id is the next lower multiple, at most ``HEAD`` turns.
FAMILY, HEAD = 20, 3
#: Turns of a partition, about.
SHARD_ROWS = 1 << 16
#: Conversation ids in one piece of a node's list of ends.
ENDS = 1024

_LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_powers = np.ones((1, 2), np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of both lanes' bases."""
    global _powers
    if len(_powers) < n:
        steps = np.broadcast_to(_LANES, (max(n, 1024), 2)).copy()
        steps[0] = 1
        _powers = np.cumprod(steps, axis=0, dtype=np.uint64)
    return _powers[:n]


class Slots:
    """A minimal perfect hash of distinct digests (rows of two words): levels of bits, then ranks.

    On each level the digests left are hashed into twice as many cells; those alone in their cell stay,
    the others go on. A digest's slot is the rank of its bit. ``at`` verifies against the digests stored.
    """

    def __init__(self, digests: np.ndarray):
        self.levels, self.size = [], len(digests)
        left, slots, used = digests, np.empty(len(digests), np.int64), 0
        where = np.arange(len(digests))
        while len(left):
            cells = 2 * len(left) + 1
            cell = self._cell(left, len(self.levels), cells)
            alone = np.bincount(cell, minlength=cells) == 1
            ranks = used + np.cumsum(alone) - 1
            stays = alone[cell]
            slots[where[stays]] = ranks[cell[stays]]
            self.levels.append((alone, ranks))
            used += int(alone.sum())
            left, where = left[~stays], where[~stays]
        self.digests = np.empty_like(digests)
        self.digests[slots] = digests

    @staticmethod
    def _cell(digests: np.ndarray, level: int, cells: int) -> np.ndarray:
        salt = kernels.mix(np.array([level + 1], np.uint64))[0]
        return (kernels.mix(digests[:, 0] ^ kernels.mix(digests[:, 1] + salt)) % np.uint64(cells)).astype(np.int64)

    def at(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for those that are not in the table."""
        slots = np.full(len(digests), -1, np.int64)
        where = np.arange(len(digests))
        for level, (alone, ranks) in enumerate(self.levels):
            cell = self._cell(digests[where], level, len(alone))
            hit = alone[cell]
            slots[where[hit]] = ranks[cell[hit]]
            where = where[~hit]
        known = slots >= 0
        known[known] = (self.digests[slots[known]] == digests[known]).all(axis=1)
        return np.where(known, slots, -1)


def summed_up(parents: np.ndarray, depths: np.ndarray, *values: np.ndarray, by=np.add) -> None:
    """Fold the values of slots into those of their parent slots (-1: none), deepest first, in place."""
    order = np.argsort(-depths, kind="stable")
    order = order[parents[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1):
        for value in values:
            by.at(value, parents[level], value[level])


def _borrowed(c: int) -> int:
    return zlib.crc32(str(c).encode()) % (HEAD + 1)


TURNS = "conv_id bigint, kind int, turn bigint, key binary, words bigint"


def _rebuilt(turns: DataFrame) -> DataFrame:
    """Rows of each conversation in order: a mark (kind 0), borrowed turns (1), all own turns (2)."""
    own = turns.select("conv_id", F.lit(2).alias("kind"), "turn", "key", "words")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    heads = (
        turns.where(F.col("conv_id") % FAMILY == 0).withColumn("at", F.row_number().over(order)).where(F.col("at") <= HEAD)
        .select(F.col("conv_id").alias("family"), "at", "key", "words")
    )
    ids = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    borrowed = ids.join(heads, "family").where(F.col("at") <= taken).select(
        "conv_id", F.lit(1).alias("kind"), F.col("at").cast("long").alias("turn"), "key", "words")
    marks = ids.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"),
                       F.lit(b"").alias("key"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(borrowed).unionByName(marks)


class _Run:
    """The turns of one partition: per row its conversation, kind and number, digests and words."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        found = [[b.column(i) for i in range(4)] for b in batches if b.num_rows]
        columns = [pa.concat_arrays(c) for c in zip(*found)] or [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.int64())]
        self.conv, self.kind, self.words = (columns[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        self.key = np.zeros((len(self.conv), 2), np.uint64)
        data, offsets = kernels.texts(columns[2])
        self.key[self.kind > 0] = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64).reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.conv)

    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.conv[1:] != self.conv[:-1]])) if len(self) else np.zeros(0, np.int64)


def _ends_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the partition's first and last conversation, and what the last one's rows here amount to.

    ``sums`` has, for each number of own turns still to be skipped (0 to 3), both lanes of the digest.
    """
    run = _Run(batches)
    if not len(run):
        return
    first = run.starts()[-1]
    kind, key = run.kind[first:], run.key[first:]
    heads, own = key[kind == 1], key[kind == 2]
    sums = []
    for skipped in range(HEAD + 1):
        kept = np.concatenate([heads, own[skipped:]])
        sums += (kept * _power(len(kept))).sum(axis=0, dtype=np.uint64).view(np.int64).tolist()
    yield pa.RecordBatch.from_pydict({
        "part": [TaskContext.get().partitionId()], "first": [int(run.conv[0])], "last": [int(run.conv[-1])],
        "heads": [len(heads)], "own": [len(own)], "sums": [sums],
    })


ENDS_OF_RUNS = "part long, first long, last long, heads long, own long, sums array<long>"


def _carried(ends: list) -> tuple[dict[int, tuple[int, int, int, int]], set[int]]:
    """What partitions begin with: (own turns seen, depth, both lanes); and those whose last conversation goes on."""
    begins, goes_on, state, of, before = {}, set(), None, None, None
    for row in sorted(ends, key=lambda r: r.part):
        if state is not None and of == row.first:
            begins[row.part] = state
            goes_on.add(before)
        if row.part not in begins or row.last != row.first:
            state = (0, 0, 0, 0)
        seen, depth, *lanes = state
        skip = min(max(_borrowed(row.last) - seen, 0), HEAD)
        powers = [pow(int(base), depth, 1 << 64) for base in _LANES]
        lanes = [(x + p * (s & (1 << 64) - 1)) % (1 << 64) for x, p, s in zip(lanes, powers, row.sums[2 * skip : 2 * skip + 2])]
        state = (seen + row.own, depth + row.heads + max(0, row.own - skip), *lanes)
        of, before = row.last, row.part
    return begins, goes_on


NODES = ("shard bigint, n1 bigint, n2 bigint, p1 bigint, p2 bigint, depth bigint, words bigint, key binary, "
         "members bigint, least bigint, phantom boolean, ends array<bigint>")


def _trie(shard: int, digest, parent, depth, words, key, ends_at, convs, is_end, phantom) -> pa.RecordBatch:
    """The node table of a shard: distinct digests in slots, members summed up from the ends."""
    distinct = np.unique(digest.view([("a", np.uint64), ("b", np.uint64)]).ravel()).view(np.uint64).reshape(-1, 2)
    slots = Slots(distinct)
    n, at = slots.size, slots.at(digest)
    first = np.zeros(n, np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    same = first[at]
    if (at < 0).any() or (depth[same] != depth).any() or (key[same] != key).any() or (parent[same] != parent).any():
        raise ValueError("two different prefixes have the same digest")
    parents = np.where(depth[first] > 0, slots.at(parent[first]), -1)
    unreal = np.zeros(n, bool)
    if phantom:  # the node that the shard continues from comes first
        unreal[at[0]], parents[at[0]] = True, -1
    members, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(members, at[ends_at], 1)
    np.minimum.at(least, at[ends_at], convs)
    depths = depth[first]
    summed_up(parents, depths, members)
    summed_up(parents, depths, least, by=np.minimum)
    order = np.argsort(at[ends_at[is_end]], kind="stable")
    counts = np.bincount(at[ends_at[is_end]], minlength=n)
    ends = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(convs[is_end][order]))
    top = unreal | (depths == 0)
    signed = [pa.array(x.view(np.int64)) for x in np.ascontiguousarray(slots.digests.T)]
    above = [pa.array(x.view(np.int64), mask=top) for x in np.ascontiguousarray(parent[first].T)]
    keys = pa.array([k.tobytes() for k in key[first]], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, shard)), *signed, *above, pa.array(depths), pa.array(words[first]), keys,
        pa.array(np.where(unreal, 0, members)), pa.array(least, mask=unreal), pa.array(unreal), ends,
    ], names=[c.split()[0] for c in NODES.split(", ")])


def _shards(begins: dict, goes_on: set):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Run(batches)
        if not len(rows):
            return
        part = TaskContext.get().partitionId()
        starts = rows.starts()
        n = len(rows)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        seen, depth, one, two = begins.get(part, (0, 0, 0, 0))
        base_seen, base_depth = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        base = np.zeros((len(starts), 2), np.uint64)
        base_seen[0], base_depth[0], base[0] = seen, depth, (one, two)
        own = rows.kind == 2
        running = np.concatenate([[0], np.cumsum(own)])
        number = running[:-1] - running[starts][of] + base_seen[of]
        skipped = np.array([_borrowed(int(c)) for c in rows.conv[starts]])[of]
        is_turn = (rows.kind == 1) | own & (number >= skipped)
        running = np.concatenate([[0], np.cumsum(is_turn)])
        at_depth = running[1:] - running[starts][of] + base_depth[of]
        share = np.zeros((n + 1, 2), np.uint64)
        share[1:][is_turn] = rows.key[is_turn] * _power(int(at_depth.max(initial=0)) + 1)[at_depth[is_turn] - 1]
        running = np.cumsum(share, axis=0, dtype=np.uint64)
        digest = running[1:] - running[starts][of] + base[of]
        parent = digest - share[1:]
        node = is_turn | (rows.kind == 0)
        for carried in (True, False):
            mine = of == 0 if part in begins else np.zeros(n, bool)
            mine = mine if carried else ~mine
            if not mine.any():
                continue
            keep = np.flatnonzero(mine & node)
            columns = [digest[keep], parent[keep], at_depth[keep], rows.words[keep], rows.key[keep]]
            if carried:  # the node reached in earlier partitions stands before those found here
                columns = [np.concatenate([np.asarray(x, c.dtype).reshape((1,) + c.shape[1:]), c])
                           for x, c in zip(((one, two), (0, 0), depth, 0, (0, 0)), columns)]
            runs = np.unique(of[mine])
            # the last node of each run
            counts = np.bincount(of[keep], minlength=len(starts))[runs] + carried
            ends_at = np.cumsum(counts) - 1
            convs = rows.conv[starts[runs]]
            is_end = np.ones(len(runs), bool)
            if part in goes_on and runs[-1] == len(starts) - 1:
                is_end[-1] = False
            yield _trie(2 * part + (not carried), *columns, ends_at, convs, is_end, carried)

    return run


SUMS = "n1 bigint, n2 bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _subtrees(attached: dict[int, tuple[tuple[int, int], int, int]]):
    """For the nodes of a shard: what it adds to the sums of their subtrees."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].combine_chunks()
        array = lambda name, null=0: column(name).fill_null(null).to_numpy(zero_copy_only=False)
        digests = np.stack([array("n1"), array("n2")], axis=1).view(np.uint64)
        above = np.stack([array("p1"), array("p2")], axis=1).view(np.uint64)
        slots = Slots(np.ascontiguousarray(digests))
        at = slots.at(digests)
        parents = np.full(slots.size, -1, np.int64)
        parents[at] = np.where(column("p1").is_null().to_numpy(zero_copy_only=False), -1, slots.at(np.ascontiguousarray(above)))
        put = lambda values: values[np.argsort(at)]  # noqa: E731  slots are a permutation of the rows
        unreal, depths, convs = put(array("phantom", False)), put(array("depth")), put(array("conv_id"))
        charged = ~unreal & (put(array("least", -1)) == convs) & ~put(column("least").is_null().to_numpy(zero_copy_only=False))
        leaves, saved = np.where(charged, put(array("leaf")), 0), np.where(charged, put(array("own_tokens")), 0)
        children = np.zeros(slots.size, np.int64)
        some = charged & (parents >= 0)
        np.add.at(children, parents[some], 1)
        shard = table["shard"][0].as_py()
        if shard in attached:
            digest, more_leaves, more_saved = attached[shard]
            slot = slots.at(np.array([digest], np.uint64))[0]
            leaves[slot] += more_leaves
            saved[slot] += more_saved
        summed_up(parents, depths, leaves, saved)
        signed = slots.digests.view(np.int64)
        return pa.table({
            "n1": signed[:, 0], "n2": signed[:, 1], "conv_id": convs, "depth": depths,
            "parent_conv_id": pa.array(convs[np.maximum(parents, 0)], mask=~some), "n_convs": put(array("n_convs")),
            "n_children": children, "n_leaves": np.where(unreal, 0, leaves), "saved_tokens": np.where(unreal, 0, saved),
        })

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come one after the other, joined by commas."""
    node, sha = None, None
    for batch in batches:
        found = []
        for n1, n2, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (n1, n2) != node:
                if node is not None:
                    found.append((*node, sha.hexdigest()))
                node, sha = (n1, n2), hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["n1", "n2", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, sha.hexdigest())], names=["n1", "n2", "sha"])


def _end_digests(local: DataFrame) -> DataFrame:
    """``n1, n2, ends_sha256`` of the nodes at which conversations end."""
    starts = F.sequence(F.lit(1), F.size("ends"), F.lit(ENDS))
    pieces = local.where(F.size("ends") > 0).select("n1", "n2", "shard", F.posexplode(
        F.transform(starts, lambda i: F.array_join(F.slice("ends", i, ENDS), ","))).alias("k", "piece"))
    # most nodes have one piece; those of several are hashed as a stream, in the order of shards, which is that of ids
    firsts = pieces.groupBy("n1", "n2").agg(F.count("*").alias("m"), F.any_value("piece").alias("piece"))
    many = pieces.join(firsts.where("m > 1").select("n1", "n2"), ["n1", "n2"], "left_semi")
    streamed = many.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "shard", "k").select("n1", "n2", "piece").mapInArrow(
        _hashed, "n1 bigint, n2 bigint, sha string")
    return firsts.where("m = 1").select("n1", "n2", F.sha2("piece", 256).alias("ends_sha256")).unionByName(
        streamed.withColumnRenamed("sha", "ends_sha256"))


def turn_table(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, key, words``: a digest of role and text, and the words of the text, by turn."""
    of, said = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    whole = F.concat(F.length(of).cast("string"), F.lit(":"), of, said)
    return rows.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.unhex(F.md5(whole)).alias("key"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


def prefix_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Turns are ordered by ``turn`` (null first); turns of the same number
    by the digest of role and text. Null roles and texts are empty. Rows without a conversation id belong
    to none and are ignored; repeated rows are turns of their own. Other columns are ignored, whatever
    their names. An empty table has no nodes, not even the root. A conversation may be of any length, and
    a node may have any number of members; the ids that end at one node pass one hash as a stream.
    """
    turns = turn_table(rows, conv_id, turn, role, text)
    rebuilt = _rebuilt(turns)
    parts = 1 + turns.count() // shard_rows
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "key"]
    runs = checkpoint(rebuilt.repartitionByRange(parts, *order).sortWithinPartitions(*order)).select("conv_id", "kind", "key", "words")
    # one row per partition
    ends = sorted(runs.mapInArrow(_ends_of_runs, ENDS_OF_RUNS).collect(), key=lambda r: r.part)
    begins, goes_on = _carried(ends)
    local = checkpoint(runs.mapInArrow(_shards(begins, goes_on), NODES))
    mark = F.when(~F.col("phantom"), F.xxhash64("p1", "p2", "depth", "key"))
    nodes = local.groupBy("n1", "n2").agg(
        F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"), F.sum(F.size("ends")).alias("n_ends"),
        F.max("words").alias("words"), (F.min(mark) == F.max(mark)).alias("sound"),
    ).select("n1", "n2", "n_convs", "conv_id", ((F.col("n_convs") - 1) * F.col("words")).alias("own_tokens"),
             F.when(F.col("sound"), (F.col("n_ends") == F.col("n_convs")).cast("long"))
             .otherwise(F.raise_error(F.lit("two different prefixes have the same digest"))).alias("leaf"))
    placed = checkpoint(local.drop("words", "key", "members", "ends").join(nodes, ["n1", "n2"]))
    attached = {}
    if begins:
        charged = placed.where("shard % 2 = 0 AND NOT phantom AND least = conv_id")
        totals = {r.shard: (r.leaf, r.own) for r in charged.groupBy("shard").agg(F.sum("leaf").alias("leaf"), F.sum("own_tokens").alias("own")).collect()}
        for row, after in reversed(list(zip(ends, ends[1:]))):
            if row.part not in goes_on:
                continue
            more = totals.get(2 * after.part, (0, 0))
            if after.part in goes_on and after.first == after.last:
                later = attached[2 * after.part]
                more = (more[0] + later[1], more[1] + later[2])
            carried = row.part in begins and row.first == row.last
            attached[2 * row.part + (not carried)] = (begins[after.part][2:], *more)
    sums = placed.groupBy("shard").applyInArrow(_subtrees(attached), SUMS)
    whole = sums.groupBy("n1", "n2").agg(
        *(F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(_end_digests(local), ["n1", "n2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

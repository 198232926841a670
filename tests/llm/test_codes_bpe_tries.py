"""Vector codes, byte-level BPE and the prefix trie against brute force and on awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from engram.llm import bpe, codes, queries, tries

VECTORS = "vec_id long, embedding array<float>, label int, codes string, carried string, part string"


# ---- vector codes


def model_codes(rows):
    """Plain Lloyd over all usable rows ``(vec_id, vector, label)`` in order."""
    rows = sorted(((i, np.floor(np.float64(np.float32(v)) * 1024).astype(int), lab) for i, v, lab in rows), key=lambda r: (r[0] is None, r[0], r[1].tolist()))
    parts = np.stack(np.split(np.array([r[1] for r in rows]), 4, axis=1))
    books = parts[:, :256].copy()

    def nearest():
        return [np.argmin(((p[:, None] - b[None]) ** 2).sum(axis=2), axis=1) for p, b in zip(parts, books)]

    for _ in range(4):
        for k, own in enumerate(nearest()):
            for e in range(books.shape[1]):
                if (own == e).any():
                    books[k, e] = parts[k][own == e].sum(axis=0) // (own == e).sum()
    last = nearest()
    errors = sum(((parts[k] - books[k][last[k]]) ** 2).sum(axis=1) for k in range(4))
    return [(r[0], r[2], [int(own[i]) for own in last], int(errors[i])) for i, r in enumerate(rows)], books


def vector_rows(n, dims=16, seed=1):
    """Clusters, repeats, and equal entries among the first."""
    dice = np.random.default_rng(seed)
    centres = dice.normal(0, 0.3, (9, dims))
    rows = [(i, (centres[dice.integers(9)] + dice.normal(0, 0.02, dims)).tolist(), int(dice.integers(3)) or None) for i in range(n)]
    for i in range(0, n, 7):
        rows[i] = (i, rows[0][1], rows[i][2])
    return rows


@pytest.mark.parametrize("n, dims", [(900, 16), (40, 8), (1, 4), (300, 4)])
def test_codes_brute_force(spark, monkeypatch, n, dims):
    rows = vector_rows(n, dims)
    want, books = model_codes(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got, own = codes.compressed(frame)
    assert (own == books).all()
    assert sorted((r.vec_id, r.label, r.codes, r.error) for r in got.collect()) == sorted(want, key=str) or \
        {r.vec_id: (r.label, r.codes, r.error) for r in got.collect()} == {w[0]: w[1:] for w in want}


def test_trees_prune_and_agree():
    dice = np.random.default_rng(2)
    centres = dice.integers(-5000, 5000, (16, 8))
    points = (centres[dice.integers(16, size=3000)] + dice.integers(-20, 20, (3000, 8))).astype(np.int64)
    book = (centres[np.arange(64) % 16] + dice.integers(-20, 20, (64, 8))).astype(np.int64)
    book[40] = book[3]
    data, entries = codes.Tree(points, codes.LEAF), codes.Tree(book, 1)
    alive = codes._candidates(data, entries)
    assert alive.mean() < 0.3  # most pairs of nodes are pruned where points have structure
    nearest, sums, counts = codes.assigned(data, entries, book)
    want = np.argmin(((data.points[:, None] - book[None]) ** 2).sum(axis=2), axis=1)
    assert (nearest == want).all() and (counts == np.bincount(want, minlength=64)).all()
    assert all((sums[e] == data.points[want == e].sum(axis=0)).all() for e in range(64))
    # far apart, whole leaves go to one entry by their cached sums
    apart = codes.Tree(centres.astype(np.int64), 1)
    assert (codes._candidates(data, apart).sum(axis=1) == 1).mean() > 0.3


def test_codes_of_large_components():
    points = np.array([[codes.LARGEST, -codes.LARGEST], [0, 0]] * 40, np.int64)
    nearest, _, _ = codes.assigned(data := codes.Tree(points, 4), codes.Tree(points[:2], 1), points[:2])
    assert (data.points == points[:2][nearest]).all()
    assert codes.integers(np.array([np.float32(3e38), -1e30, 0.5, -0.0001])).tolist() == [1 << 24, -(1 << 24), 512, -1]


def test_codes_awkward(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.1, 0.2, 0.3, 0.4], 5), (2, [0.1, 0.2, 0.3, 0.4], None), (2, [0.5, 0.2, 0.3, 0.4], None), (None, [0.9, 0.9, 0.9, 0.9], 5)]
    bad = [(3, None, 5), (4, [], 5), (5, [0.1, None, 0.3, 0.4], 5), (6, [nan, 0.2, 0.3, 0.4], 5), (7, [inf, 0.2, 0.3, 0.4], 5), (8, [0.1] * 8, 5), (9, [0.1] * 5, 5)]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in good + bad], VECTORS)
    got, books = codes.compressed(frame)
    want, own = model_codes(good)
    assert (books == own).all() and sorted(map(str, got.collect())) == sorted(
        f"Row(vec_id={i}, label={lab}, codes={c}, error={e})" for i, lab, c, e in want)
    empty, none = codes.compressed(frame.limit(0))
    assert empty.columns == got.columns and empty.count() == 0 and none.size == 0


def test_label_errors_put_nulls_together(spark, tmp_path):
    rows = vector_rows(60)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    want, books = model_codes(rows)
    sums = collections.Counter()
    for _, lab, _, error in want:
        sums[lab] += error
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == {
        i: ("".join(f"{c:02x}" for c in cs), e, sums[lab]) for i, lab, cs, e in want}
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


# ---- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_tiktoken(spark, ranks, monkeypatch):
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(3)
    texts = [
        None, "", " ", "\n\n  x", "a", "I'll don't WE'RE", "naïve Ünï 12345 ½ ²", "tab\there    wide　space \u0085", "日本語の文章。" * 9,
        "\U0001f600" * 5 + "\U00010000\U0010fffd\U0010fffe\U0010ffff", "=" * 3000, "a" * 2500, " " * 999 + "x", "aaabaaab" * 40, "<|endoftext|>", "\x00\x01\r\n",
        " ".join("".join(dice.choice("etaoinéß") for _ in range(dice.randrange(1, 14))) for _ in range(4000)),
    ]
    frame = spark.createDataFrame([(i, t, "row", 7, "w") for i, t in enumerate(texts)] + [(0, None, "row", 7, "w"), (4, "a", None, None, None)],
                                  "doc_id long, text string, row string, key int, word string").repartition(2)
    for frequent in (50, 0):
        monkeypatch.setattr(bpe, "FREQUENT", frequent)
        out = bpe.encode(frame, ranks, public_tokenizers.PATTERN)
        assert out.columns == frame.columns + ["ids"]
        rows = out.withColumn("bytes", bpe.decode(F.col("ids"), ranks)).collect()
        assert len(rows) == len(texts) + 2
        for r in rows:
            assert r.ids == model.encode_ordinary(r.text or "")
            assert bytes(r.bytes) == (r.text or "").encode()


def test_bpe_empty_table_and_pattern(spark, ranks):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).collect() == []
    with pytest.raises(ValueError):
        bpe.java_pattern(r"[\S]")
    assert bpe.java_pattern(r"a\[\s]") == rf"a\[[{bpe._SPACE}]]"


def test_bpe_words_of_any_length(spark, ranks):
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(5)
    words = ["".join(dice.choice("etaoinshé") for _ in range(n)) for n in (1, 2, 40, 255, 256, 257, 9000, 200_000)] + ["a" * 70_000]
    for word in words[:-2]:
        raw = word.encode()
        assert raw in ranks or bpe._cuts(raw, ranks) == bpe._cuts_of_long(raw, ranks)
    out = bpe.encode(spark.createDataFrame([(w,) for w in words], "text string"), ranks, public_tokenizers.PATTERN)
    assert {r.text: r.ids for r in out.collect()} == {w: model.encode_ordinary(w) for w in words}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


# ---- prefix trie


def model_trie(rows):
    of = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of[c].append((turn is not None, turn or 0, key, len(re.findall(r"[^\x20\x09-\x0D]+", text))))
    own = {c: [(k, n) for _, _, k, n in sorted(v)] for c, v in of.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]  # SQL's remainder has the sign of c
    nodes = collections.defaultdict(list)
    for c, turns in sorted(built.items()):
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[:-1] == p and q for q in below if len(q) == len(p) + 1)]
        ends = ",".join(str(c) for c in members if len(built[c]) == len(path))
        out[path] = (
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), len(leaves),
            sum((len(nodes[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def conversation_rows(seed, conversations=70, long=60):
    """Common first turns, equal conversations, one long one, null and repeated turn numbers."""
    dice = random.Random(seed)
    texts = ["hello", "hi there you", "", None, "so  what\tnow", "bye"]
    rows = []
    for c in range(conversations):
        if dice.random() < 0.15:
            continue
        for turn in range(dice.randrange(0, 8)):
            rows.append((c, dice.choice([turn] * 9 + [None]), "user" if turn % 2 else None, texts[min(turn, 1) if dice.random() < 0.6 else dice.randrange(6)]))
    rows += [(41, t, "user", f"turn {t % 50}") for t in range(long)] + [(47, t, "user", f"turn {t % 50}") for t in range(long // 2)]
    rows += [(c, t, "system", "same words here") for c in range(500, 560) for t in range(5)] + [(3, 0, "user", "hello")] * 2
    return rows


@pytest.mark.parametrize("shard_rows", [1 << 16, 200, 25])
def test_trie_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(tries, "ENDS", 4)
    rows = conversation_rows(shard_rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = [tuple(r) for r in tries.prefix_trie(frame, shard_rows=shard_rows).collect()]
    assert sorted(got, key=str) == model_trie(rows)


def test_trie_awkward(spark):
    schema = "conv_id long, turn int, role string, text string, shard string, kind int, depth string"
    rows = [(None, 1, "user", "lost"), (-5, None, None, None), (-5, 2, "a", "b c"), (-40, 1, "x", "y"), (-45, 1, "x", "y"), (20, 0, "u", "word " * 50_000), (21, 0, "u", "word " * 50_000), (21, 1, "u", "z")]
    frame = spark.createDataFrame([(*r, "s", 1, "d") for r in rows], schema)
    got = tries.prefix_trie(frame)
    assert sorted((tuple(r) for r in got.collect()), key=str) == model_trie(rows)
    assert tries.prefix_trie(frame.limit(0)).collect() == []
    assert tries.prefix_trie(frame.where("conv_id IS NULL")).collect() == []


def test_slots_are_minimal_and_verified():
    dice = np.random.default_rng(4)
    digests = np.unique(dice.integers(0, 1 << 63, (5000, 2)).astype(np.uint64), axis=0)
    digests[1, 0] = digests[0, 0]
    table = tries.Slots(digests)
    assert sorted(table.at(digests)) == list(range(len(digests)))
    other = digests.copy()
    other[:, 1] ^= np.uint64(1)
    assert (table.at(other) == -1).all() and tries.Slots(digests[:0]).at(digests[:3]).tolist() == [-1] * 3

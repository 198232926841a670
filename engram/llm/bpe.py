"""Byte-level BPE: texts are cut into words by Spark, words become tokens by ranked merges, tokens bytes.

Merging repeats the step *join the pair of lowest rank, leftmost first* until no pair has a rank. The
different words of a batch are merged once each and their ids dealt to the places where they stand; a
task remembers words from batch to batch, so frequent ones are merged once per task. Texts and words
are never shuffled, and nothing is written.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Words that a task remembers, and the longest of them, in characters.
FREQUENT, WORD_CHARS = 1 << 18, 32
#: Bytes from which a word's pairs are kept in a heap; shorter ones are scanned.
LONG = 256
_NEVER = 1 << 62
#: The classes of white space in the pattern, spelled out for Java's regular expressions.
_SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def java_pattern(pattern: str) -> str:
    """``pattern`` with Unicode's white space, which Java's ``\\s`` doesn't mean by default."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
        elif two == r"\S":
            if inside:
                raise ValueError(r"\S within a class")
            out.append(f"[^{_SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at -= 1
        at += 2
    return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of lines ``base64 rank``; every single byte must be one."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("not a byte-level vocabulary")
    return ranks


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of ``word``."""
    if word in ranks:
        return [ranks[word]]
    cuts = _cuts_of_long(word, ranks) if len(word) >= LONG else _cuts(word, ranks)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:])]


def _cuts(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where tokens begin, and the end; ``near`` has the rank of each two tokens side by side."""
    cuts = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
    while near and (least := min(near)) != _NEVER:
        at = near.index(least)
        del cuts[at + 1], near[at]
        if at < len(near):
            near[at] = ranks.get(word[cuts[at] : cuts[at + 2]], _NEVER)
        if at:
            near[at - 1] = ranks.get(word[cuts[at - 1] : cuts[at + 1]], _NEVER)
    return cuts


def _cuts_of_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs, for words of any length; a pair is past when its ends have moved."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = after[at]
        if not middle or middle == n or after[middle] != end:
            continue
        after[at], after[middle] = end, 0
        if end < n:
            before[end] = at
            if (rank := ranks.get(word[at : after[end]])) is not None:
                heapq.heappush(heap, (rank, at, after[end]))
        if at and (rank := ranks.get(word[before[at] : end])) is not None:
            heapq.heappush(heap, (rank, before[at], end))
    return [*(i for i in range(n) if after[i]), n]


def _split(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids of ``text`` as an array of integers.

    ``pattern`` cuts a text into words (``\\s`` is Unicode's white space); each word is a token as a
    whole or is merged by ``ranks``. Special tokens do not exist. A null or empty text has no tokens.
    Rows keep their other columns, whatever their names, and repeats; an empty table gives none. Texts
    are taken whole, and a word may have any length.
    """
    frequent, shared = FREQUENT, docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            words = batch.column(1)
            coded = words.flatten().dictionary_encode()
            each = []
            for word in coded.dictionary.to_pylist():
                ids = known.get(word)
                if ids is None:
                    ids = merged(word.encode(), shared.value)
                    if len(word) <= WORD_CHARS and len(known) < frequent:
                        known[word] = ids
                each.append(ids)
            # ids of the different words in a row, and of every place where one stands
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            pool = np.fromiter((i for ids in each for i in ids), np.int32, sizes.sum())
            place = coded.indices.to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes[place])])
            first = np.cumsum(sizes) - sizes
            ids = pool[np.repeat(first[place] - ends[:-1], sizes[place]) + np.arange(ends[-1])]
            offsets = words.offsets.to_numpy().astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends[offsets - offsets[0]].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["row", "ids"])

    cut = _split(F.coalesce(F.col(f"`{text}`"), F.lit("")), pattern)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.struct("*").alias("row"), cut.alias("words")).mapInArrow(run, schema).select("row.*", F.col("ids").alias(out))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of a column of token ids; null for null, empty for none."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return _let(literal, lambda known: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(known, i)), "")))

"""Splitting of texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Separators from coarse to fine, and Unicode white space.
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", " ", "")
SPACE = (
    "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def _pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Parts of at most ``size`` bytes, each followed by the separator it was cut at."""
    if not separators or _bytes(text) <= size:
        yield text
        return
    cut, finer = separators[0], separators[1:]
    for part in text.split(cut) if cut else text:
        if _bytes(part) <= size:
            yield part + cut
        else:
            yield from _pieces(part, size, finer)


def split_text(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Chunks of about ``size`` bytes that repeat the last ``overlap`` characters.

    The repeated part is not counted again, so a chunk may exceed the size.
    """
    size = size if size > 0 else 1000
    overlap = overlap if 0 <= overlap < size else 200
    chunks: list[str] = []
    held, held_bytes = "", 0
    for piece in _pieces(text, size):
        piece = piece.strip(SPACE)
        if not piece:
            continue
        width = _bytes(piece)
        if held and held_bytes + width > size:
            chunks.append(held.strip(SPACE))
            held = held[max(len(held) - overlap, 0):]
            held_bytes = _bytes(held)
        if held and held[-1] != " ":
            held, held_bytes = held + " ", held_bytes + 1
        held, held_bytes = held + piece, held_bytes + width
    if held:
        chunks.append(held.strip(SPACE))
    return chunks


def chunk_column(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of a text as an array, computed over Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return split(text)

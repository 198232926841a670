"""A deterministic model provider that needs no network."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64


def embed_text(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed counts of words and letter triples."""
    words = re.findall(r"\w+", text.lower())
    tokens = words + [w[i:i + 3] for w in words for i in range(max(len(w) - 2, 1))]
    slots = [zlib.crc32(t.encode()) % dimensions for t in tokens]
    return np.bincount(slots, minlength=dimensions).astype("float32")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _embed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: embed_text(t) if t is not None else None)


def embed(text: Column) -> Column:
    """Hashed bag of words as a vector, over Arrow batches."""
    return _embed(text)


def extract_facts(text: Column) -> Column:
    """Facts stated as "my X is Y", as a JSON array."""
    pattern = r"(?i)\bmy ([a-z][a-z ]*?) (?:is|are) ([^\n.,;!?]+)"
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"),
        F.regexp_extract_all(text, F.lit(pattern), 2).alias("v"),
    )
    return F.to_json(F.transform(pairs, lambda p: F.struct(
        F.regexp_replace(F.lower(F.trim(p["a"])), " +", "_").alias("attribute"),
        F.trim(p["v"]).alias("value"), F.lit(0.9).alias("confidence_score"),
    )))


def extract_relations(text: Column) -> Column:
    """Relations stated as "I know Anna" or "Anna works at Acme", as a JSON array."""
    pattern = r"\b(I|[A-Z][a-z]+) (works? at|lives? in|knows?|likes?|owns?) ([A-Z][A-Za-z]+)"
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), 1).alias("s"),
        F.regexp_extract_all(text, F.lit(pattern), 2).alias("r"),
        F.regexp_extract_all(text, F.lit(pattern), 3).alias("t"),
    )
    return F.to_json(F.transform(found, lambda f: F.struct(
        F.when(f["s"] == "I", "user").otherwise(f["s"]).alias("source_entity"),
        f["t"].alias("target_entity"),
        F.upper(F.regexp_replace(F.regexp_replace(f["r"], r"s?( |\z)", "$1"), " ", "_")).alias("relation_type"),
        F.lit(0.9).alias("confidence"),
    )))


def validate_conflict(candidate: Column, existing: Column) -> Column:
    """A candidate "X: not Y" contradicts an existing "X: Y"."""
    against = F.regexp_replace(candidate, r": not ", ": ")
    hit = (against != candidate) & F.array_contains(existing, against)
    return F.to_json(F.struct(
        hit.alias("has_conflict"), F.when(hit, against).otherwise("").alias("conflicting_fact"),
        F.when(hit, "negation").otherwise("").alias("reason"),
    ))

"""Bounded samples of unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def least_hashed(rows: DataFrame, n: int, total: int, *key: str) -> DataFrame:
    """The ``n`` rows of least hash of ``key``, of ``total`` rows; all where there are fewer.

    A filter on the hash leaves about four times ``n`` rows before they are ordered, so that what
    tasks send on does not grow with the table. Depends on the rows alone, not on their places.
    """
    mark = F.xxhash64(*key, F.lit(1))
    one_of = max(1, total // (4 * n))
    return rows.where(F.pmod(F.xxhash64(*key, F.lit(2)), F.lit(one_of)) == 0).orderBy(mark, *key).limit(n)

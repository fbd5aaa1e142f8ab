"""Bounded samples for fitting models: the ids of the smallest hashes.

A count of the distinct ids gives the share of the range of hashes in which about
twice as many ids lie as are wanted, so what meets in one task to be ordered is
a bounded number of rows at every size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low(h: Column, n: int, known: Column) -> Column:
    """Whether a 64-bit hash is in the lowest share, in which about 2n + 50 of ``known`` evenly spread ones lie."""
    share = F.least(F.lit(1.0), F.lit(2.0 * n + 50) / F.greatest(known.cast("double"), F.lit(1.0)))
    return h.cast("double") <= share * (2.0**64) - 2.0**63


def ids(rows: DataFrame, n: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """At most ``n`` distinct values of a column, those of the smallest hashes; null is left out."""
    rows = rows.where(F.col(key).isNotNull()).select(key)
    known = rows.agg(F.approx_count_distinct(key)).first()[0]
    h = F.xxhash64(F.col(key), F.lit(seed))
    return rows.where(low(h, n, F.lit(known))).distinct().orderBy(h, key).limit(n)

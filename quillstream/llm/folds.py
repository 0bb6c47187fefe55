"""Folds by crc32 of the id, and bounded samples of rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, m: int = 5) -> Column:
    """crc32 of the id's decimal text modulo m; null ids fall in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(-1)).cast("int")


def sample_ids(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most `limit` distinct rows of ids (doc_id, ...), drawn by a seeded hash; the same rows on every run."""
    total = ids.count()
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    if total > limit:
        # a threshold leaves slightly more than needed, so that the order below sees a bounded number of rows
        share = 1.3 * limit / total + 0.001
        if share < 1:  # at 1 the bound would be 2**63, which is no long
            ids = ids.filter(h < F.lit(int(-(2**63) + share * (2**64 - 1))))
    return ids.orderBy(h, "doc_id").limit(limit)

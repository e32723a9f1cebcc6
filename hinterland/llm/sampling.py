"""Bounded samples by the order of a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(rows: DataFrame, hash_col: str, n: int, limit: int) -> DataFrame:
    """At most ``limit`` of the ``n`` rows: those with the smallest 64-bit hashes.

    Hashes that are too large to be among them are dropped where they are read, so about twice
    ``limit`` rows reach the one task that ranks them, however many partitions there are. Equal
    rows share a hash; where they are very many the sample can be smaller.
    """
    share = min(1.0, (2 * limit + 100) / max(n, 1))
    bound = int(share * 2**64) - 2**63 - 1
    return rows.where(F.col(hash_col) <= bound).orderBy(hash_col).limit(limit)

"""Bounded samples for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, most: int, seed: int) -> list[Row]:
    """At most ``most`` rows of ``df``, those of least hash over all columns, in that order.

    Hashes are uniform, so a bound on them that twice as many rows pass lets few rows leave any task; should
    fewer than ``most`` pass (as where rows repeat much), all are considered.
    """
    names = df.columns
    h = df.select(F.xxhash64(F.lit(seed), *names).alias("_h"), *names)
    rows = df.count()
    bound = int(2**64 * min(1.0, 2 * most / rows)) - 2**63 if rows > 2 * most else None
    got = h.where(F.col("_h") < bound).orderBy("_h", *names).limit(most).collect() if bound is not None else []
    return got if len(got) == most else h.orderBy("_h", *names).limit(most).collect()

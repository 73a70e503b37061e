"""Change capture between snapshots by content hash, upserts, and reuse of unchanged sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """One row for each non-blank key, that of the greatest ``order``; combined before the shuffle."""
    rest = [c for c in columns if c != key]
    best = df.where(F.col(key).isNotNull() & (F.trim(key) != "")).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): insert, update, unchanged or delete."""
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    label = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(F.col("o") == F.col("n"), "unchanged").otherwise("update")
    return o.join(n, key, "full_outer").select(key, label.alias("change"))


def upserted(old: DataFrame, new: DataFrame, key: str, keep: list[str], prune: bool = True) -> DataFrame:
    """The next snapshot: new rows win but for the columns ``keep``, which an old row holds on to; with
    ``prune`` rows missing from ``new`` go."""
    cols = old.columns
    o, n = (d.select(key, F.struct(*(c for c in cols if c != key)).alias(a)) for d, a in ((old, "o"), (new, "n")))
    met = o.join(n, key, "right_outer" if prune else "full_outer")
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return met.select(key, *(value(c).alias(c) for c in cols if c != key))

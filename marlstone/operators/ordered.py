"""Row numbers over a whole table, and sequential folds over each key's rows in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import written


_KINDS = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}


def numbered(df: DataFrame, order: list[Column], out: str = "row_no") -> DataFrame:
    """``df`` with its rows' places in a total order from 1, without gathering them in one task.

    Rows are range-partitioned and sorted once and written; the sizes of the ranges, one number each, give offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    sizes = {r.p: r.n for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    pairs, seen = [], 0
    for p in sorted(sizes):
        pairs += [F.lit(p), F.lit(seen)]
        seen += sizes[p]
    before = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return at.withColumn(out, (before + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint")).drop("_id")


def folded(df: DataFrame, key: str, order: list[str], step: Callable[[Any, dict], tuple[Any, tuple]], out: str, start: Callable[[], Any]) -> DataFrame:
    """Runs ``step(state, row) -> (state, output)`` over each key's rows in order and returns the outputs.

    Rows stream through sorted partitions, so a key of any size needs no more memory than its state.
    """
    names = df.columns
    fields = [f.split()[0] for f in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, first = None, None, True
        for b in batches:
            rows = []
            for row in b.to_pylist():
                if first or row[key] != last:
                    state, last, first = start(), row[key], False
                state, o = step(state, row)
                rows.append(dict(zip(fields, o)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in out.split(", ")])
    return df.select(*names).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)


def sliding_log(span: float = 60.0, most: int = 30):
    """A limiter that logs accepted requests only: a request passes while fewer than ``most`` of the last ``span`` seconds are logged."""

    def step(state: list[float], row: dict) -> tuple[list[float], tuple]:
        now = row["t"]
        kept = [x for x in state if now - x <= span]
        ok = len(kept) < most
        return kept + [now] * ok, (row["event_id"], row["user_id"], ok)

    return list, step


def lru_cache_trace(capacity: int = 100, ttl: float = 900.0):
    """A cache of limited size and age: a hit renews an entry's place, not its age; a miss stores the entry."""

    def step(state: dict, row: dict) -> tuple[dict, tuple]:
        now, k = row["t"], row["k"]
        hit = k in state and now - state[k] <= ttl
        at = state.pop(k, now) if hit else now
        state.pop(k, None)
        state[k] = at
        if len(state) > capacity:
            state.pop(next(iter(state)))
        return state, (row["event_id"], row["shard"], hit, len(state))

    return dict, step


def circuit_breaker(failures: int = 3, cooldown: float = 60.0):
    """Opens after so many failures in a row, lets nothing through for the cooldown, then starts again."""

    def step(state: list, row: dict) -> tuple[list, tuple]:
        count, until = state
        now = row["t"]
        if until is not None and now >= until:
            count, until = 0, None
        is_open = until is not None
        if not is_open:
            count = count + 1 if row["failed"] else 0
            if count >= failures:
                until = now + cooldown
        return [count, until], (row["event_id"], row["user_id"], is_open, count)

    return lambda: [0, None], step

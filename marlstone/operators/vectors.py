"""Exact nearest vectors of a stated set of queries, by blocks of matrix products."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.session import ensure_checkpoint_dir

#: Query vectors sent to the executors at a time; more queries are answered in several jobs.
BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of one row; null where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _partial(ids: list, matrix: np.ndarray, k: int, kind: pa.DataType):
    q = _unit(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        for b in batches:
            rows = [(i, v) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if v is not None and len(v) == q.shape[1]]
            if not rows:
                continue
            keys = np.array([r[0] for r in rows], object)
            sims = np.round(_unit(np.array([r[1] for r in rows], float)) @ q.T, 6) + 0.0
            for j in range(len(ids)):
                s = sims[:, j]
                cut = np.partition(s, -k)[-k] if len(s) > k else -2
                best[j] = sorted([*best[j], *zip(-s[s >= cut], keys[s >= cut])])[:k]
        out = [(ids[j], i, -s) for j, x in enumerate(best) for s, i in x]
        a, b_, c = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b_, kind), pa.array(c, pa.float64())], ["query_id", "id", "similarity"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar rows of each query, similarities to six digits, ties by id.

    Each task keeps k rows for each query of a block; only these are shuffled. Null vectors and those of another
    length than the queries' are passed over; a vector without length has a similarity of 0.
    """
    own = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    kind = pa.string() if own.schema["id"].dataType.simpleString() == "string" else pa.int64()
    sql = "string" if kind == pa.string() else "bigint"
    qs = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("v is not null").orderBy("id")
    shape = f"query_id {sql}, id {sql}, similarity double"

    def answered(part: list) -> DataFrame:
        return own.mapInArrow(_partial([r.id for r in part], np.array([r.v for r in part], float), k, kind), shape)

    spark, block, to = own.sparkSession, [], None
    for r in qs.toLocalIterator():  # one block at a time is on the driver
        if len(block) == BLOCK:  # more blocks than one: each is answered and written by a job of its own, so that no plan grows with the queries
            to = to or f"{ensure_checkpoint_dir(spark).rstrip('/')}/marlstone-nearest-{uuid.uuid4().hex}"
            answered(block).write.mode("append").parquet(to)
            block = []
        block.append(r)
    if not block:
        return spark.createDataFrame([], shape + ", rank bigint")
    out = answered(block) if to is None else answered(block).unionAll(spark.read.schema(shape).parquet(to))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def centroids_of(rows: DataFrame, *, vector: str, cells: int = 32, sample: int = 4096, rounds: int = 12) -> np.ndarray:
    """Unit centres of an inverted-file index, fitted on at most ``sample`` vectors (those of least hash)."""
    h = rows.select(F.xxhash64(vector).alias("h"), F.col(vector).alias("v")).where(f"{vector} is not null")
    got = [r.v for r in h.orderBy("h").limit(sample).collect()]
    if not got:
        return np.zeros((0, 0))
    m = _unit(np.array(got, float))
    c = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)].copy()
    for _ in range(rounds):
        at = (m @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, m)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c


def _cells(c: np.ndarray, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column(1).to_pylist()
            ok = [i for i, v in enumerate(vs) if v is not None and c.size and len(v) == c.shape[1]]
            if ok:
                sims = _unit(np.array([vs[i] for i in ok], float)) @ c.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(ok, best.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(best.ravel().astype(np.int32))], ["id", "v", "cell"])

    return run


def nearest_by_cells(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int, centres: np.ndarray, probes: int = 20) -> DataFrame:
    """(query_id, id, similarity, rank): like ``nearest``, but a query is held only against the rows of its ``probes`` nearest cells.

    Every row is in exactly one cell, so nothing is left out of the index; what is lost is measured as recall. Rows and
    queries meet by a join on the cell, which adaptive skew handling splits where a cell is large.
    """
    def own(df: DataFrame, n: int) -> DataFrame:
        d = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return d.mapInArrow(_cells(centres, n), f"id {d.schema['id'].dataType.simpleString()}, v array<double>, cell int")

    q = own(queries, probes).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "cell")
    met = own(rows, 1).join(q, "cell").select("query_id", "id", F.round(F.coalesce(cosine(F.col("q"), F.col("v")), F.lit(0.0)), 6).alias("similarity"))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return met.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)

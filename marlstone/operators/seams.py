"""Places where a model, a search engine or a picture service can be plugged in, and what happens without one.

A plug is a plain function over a list of texts (one Arrow batch at a time) that returns as many values. Without a plug each
operator takes its stated default and stays within built-in expressions.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import one_line
from marlstone.session import written

Plug = Callable[[list[str]], list[Any]]
_KINDS = {"double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64()), "bigint": pa.int64(), "boolean": pa.bool_()}
#: Score of a chunk that no evaluator judges, and the least that is kept. Numbers of a stand-in embedding.
UNJUDGED, LEAST_SCORE, FAKE_SIZE = 10.0, 6.0, 16
#: What a web search gives.
RESULT = "query string, title string, url string, snippet string"


def plugged(df: DataFrame, text: Column, plug: Plug, kind: str, out: str) -> DataFrame:
    """``df`` with ``out``: what ``plug`` says of each row's text; a null text counts as empty. Other columns pass as they are."""
    names = df.columns
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    row = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plug(b.column(1).to_pylist()), _KINDS[kind])], ["row", "said"])

    got = own.mapInArrow(run, f"row {row}, said {kind}")
    return got.select("row.*", F.col("said").alias(out))


def judged(chunks: DataFrame, text: str, evaluator: Plug | None = None) -> DataFrame:
    """Chunks with ``score`` and ``kept``: without an evaluator every chunk has the full score."""
    scored = plugged(chunks, F.col(text), evaluator, "double", "score") if evaluator else chunks.withColumn("score", F.lit(UNJUDGED))
    return scored.withColumn("kept", F.col("score") >= LEAST_SCORE)


def fake_embedding(text: str, size: int = FAKE_SIZE) -> list[float]:
    """Numbers within -1 and 1 drawn from a generator that the text's hash seeds: equal texts get equal vectors."""
    draw = random.Random(int(hashlib.sha1(text.encode()).hexdigest()[:16], 16))
    return [draw.uniform(-1.0, 1.0) for _ in range(size)]


def embedded(df: DataFrame, text: str, model: Plug | None = None, *, allow_fake: bool = False, out: str = "vector") -> DataFrame:
    """``df`` with a vector for each text and its ``provider``: of the model, else a stand-in where that is allowed, else null, on which lexical retrieval takes over."""
    if model:
        return plugged(df, F.col(text), model, "array<double>", out).withColumn("provider", F.lit("model"))
    if allow_fake:
        return plugged(df, F.col(text), lambda xs: [fake_embedding(x) for x in xs], "array<double>", out).withColumn("provider", F.lit("fake"))
    return df.withColumn(out, F.lit(None).cast("array<double>")).withColumn("provider", F.lit(None).cast("string"))


def refreshed(df: DataFrame, text: str, vector: str, size: int, model: Plug | None) -> DataFrame:
    """``df`` with ``vector`` made anew and a ``status``: `skipped` without a model, `dimension_mismatch` for a vector of another length, which is not taken, else `ok`."""
    if model is None:
        return df.withColumn("status", F.lit("skipped"))
    new = plugged(df, F.col(text), model, "array<double>", "_new")
    fits = F.size("_new") == size
    return new.withColumns({vector: F.when(fits, F.col("_new")).otherwise(F.col(vector).cast("array<double>")), "status": F.when(fits, "ok").otherwise("dimension_mismatch")}).drop("_new")


def searched(spark: SparkSession, queries: DataFrame, engine: Callable[[list[str]], list[list[tuple[str, str, str]]]] | None = None) -> DataFrame:
    """(query, title, url, snippet): what an engine finds for ``queries`` (query); nothing without one."""
    if engine is None:
        return spark.createDataFrame([], RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(0).to_pylist()
            rows = [(q, *r) for q, rs in zip(asked, engine(asked)) for r in rs]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["query", "title", "url", "snippet"])

    return queries.select("query").mapInArrow(run, RESULT)


def shown_results(rows: DataFrame, by: str, order: str, most: int = 3) -> DataFrame:
    """(by, text): the first few results (title, url, snippet) as lines for a reader; the few are picked map-side first."""
    from pyspark.sql import Window as W

    top = rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_n") <= most)
    line = F.concat(F.col("_n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("untitled")), F.lit(" ("), F.coalesce("url", F.lit("n/a")), F.lit("): "), F.substring(one_line(F.coalesce("snippet", F.lit(""))), 1, 160))
    each = top.select(by, F.struct("_n", line.alias("x")).alias("s"))
    return each.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "\n").alias("text"))


def unassisted(topic: Column, text: Column) -> dict[str, Column]:
    """What the steps of writing say without a model: no relevance, the topic as the only query, the text's beginning as its summary, no plan, and acceptance with seven points."""
    return {
        "relevance": F.lit(0.0), "queries": F.array(topic), "summary": F.substring(F.coalesce(text, F.lit("")), 1, 500), "plan": F.array().cast("array<string>"), "verdict": F.lit("ACCEPT"), "points": F.lit(7).cast("bigint"),
    }


def written_drafts(df: DataFrame, prompt: str, template: Column, writers: list[tuple[str, Plug]] | None = None) -> DataFrame:
    """``df`` with ``draft`` and ``path``: the first of the writers, in order, that returns one, else the template."""
    out = df
    for i, (_, writer) in enumerate(writers or []):
        out = plugged(out, F.col(prompt), writer, "string", f"_w{i}")
    made = [F.when(F.col(f"_w{i}") != "", F.col(f"_w{i}")) for i in range(len(writers or []))]
    path = F
    for i, (name, _) in enumerate(writers or []):
        path = path.when(F.col(f"_w{i}") != "", name)
    path = path.otherwise("template") if writers else F.lit("template")
    return out.withColumns({"draft": F.coalesce(*made, template), "path": path}).drop(*(f"_w{i}" for i in range(len(writers or []))))


def revised(drafts: DataFrame, review: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], most: int = 3) -> DataFrame:
    """``drafts`` (with a string column draft) after up to ``most`` rounds of review and rewriting, with ``revisions``.

    ``review`` adds ``feedback`` (null or empty: accepted), ``rewrite`` changes ``draft`` of the rows it gets. Each round is written, so
    lineage doesn't grow, and only rows with feedback go on.
    """
    todo, done = drafts.withColumn("revisions", F.lit(0)), None
    for n in range(most + 1):
        seen = written(review(todo), "review")
        wants = (F.coalesce("feedback", F.lit("")) != "") if n < most else F.lit(False)
        ended = seen.where(~wants).drop("feedback")
        done = ended if done is None else done.unionByName(ended)
        if n == most or not seen.where(wants).limit(1).count():
            return done
        todo = rewrite(seen.where(wants)).drop("feedback").withColumn("revisions", F.lit(n + 1))
    return done

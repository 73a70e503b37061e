"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document that its source may give gets a virtual finish time: the tokens of its source up to and including
it, in a seeded shuffled order and pass after pass, divided by the source's target weight. Reading all
sources in the order of virtual finish time serves each in proportion to its weight; a source that runs out
of copies leaves the rest in proportion. The mix is that order, cut where its tokens reach the budget.

Running sums never gather a source in one task: the shuffled order is cut into equal ranges of the hash, sums of
ranges give offsets (at most targets x passes x ranges rows), and a window runs within a range only. The global
running sum works the same way over equal ranges of virtual time, which hold equal numbers of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.tokenizer import TOKENIZERS, VOCABULARY, with_tokens
from marlstone.session import written

#: A table of targets is a setting, not data: more rows than this are refused.
MOST_TARGETS = 10_000
RANGES = 4096


def clean_source(name: Column) -> Column:
    """Lower case, padding off, runs of separators as one underscore; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)^[\s_.\-]+|[\s_.\-]+$", ""), r"(?U)[\s_.\-]+", "_")


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = (
        targets.select(clean_source(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
        .where("s is not null and w > 0 and r > 0").groupBy("s").agg(F.max("w").alias("w"), F.max("r").alias("r")).limit(MOST_TARGETS + 1).collect()
    )
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    return [(x.s, x.w, x.r) for x in sorted(rows)]


def sized(df: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(k, s, th, n): key, clean source, hash of the text and number of tokens of each distinct document that has any, written once."""
    own = df.select(F.col(key).alias("k"), clean_source(F.col(source)).alias("s"), F.xxhash64(text).alias("th"), F.col(text).alias("t")).where("s is not null and t is not null")
    counted = with_tokens(own, text="t", keep=["k", "s", "th"], out="n", count_only=True, tokenizers=tokenizers, vocabulary=vocabulary)
    return written(counted.where("n > 0").distinct(), "sized")


def largest_exact_budget(totals: dict[str, int], targets: list[tuple[str, float, int]]) -> float:
    """The most tokens of a mix in which every source that has documents reaches its share within its repeats."""
    all_ = sum(w for s, w, _ in targets if totals.get(s))
    return min((totals[s] * r * all_ / w for s, w, r in targets if totals.get(s)), default=0.0)


def mix(df: DataFrame, targets: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", budget: float | None = None, seed: int = 7,
        tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None) -> DataFrame:
    """(position, key, copy, source, n_tokens) in mixing order, positions from 1.

    ``budget``: tokens of the whole mix. Without one it is the largest at which no source falls short of its
    share (shares of sources without documents go to the others in proportion); with a larger one, sources that
    run out fall short and the rest fill up. Rows without source, text or tokens, and sources without a target, give
    nothing. Rows equal in key, source and text count once. Empty tables give an empty mix.
    """
    spark = df.sparkSession
    t = _targets(targets)
    own = sizes if sizes is not None else sized(df, text=text, source=source, key=key, tokenizers=tokenizers, vocabulary=vocabulary)
    shape = "s string, w double, r int"
    wanted = own.join(F.broadcast(spark.createDataFrame(t, shape)), "s")  # at most MOST_TARGETS rows
    totals = {x.s: x.n for x in wanted.groupBy("s").agg(F.sum("n").alias("n")).collect()}  # a row for each target
    total = largest_exact_budget(totals, t) if budget is None else float(budget)
    # passes that can be needed: without a budget those of a source's due, else those of a source alone, if all but it were empty
    all_ = sum(w for s, w, _ in t if totals.get(s))
    need = [(s, w, max(1, min(r, -int(-(total if budget is not None else total * w / all_) // totals[s])))) for s, w, r in t if totals.get(s)]
    per = own.join(F.broadcast(spark.createDataFrame(need, shape)), "s")
    h = F.xxhash64(F.lit(seed), F.col("k"), F.col("th"), F.col("copy"))
    copies = per.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).select(
        "k", "s", "th", "w", "n", "copy", h.alias("h"), F.shiftrightunsigned(h, 64 - (RANGES - 1).bit_length()).cast("int").alias("b"))
    at = ["s", "copy", "b"]
    offsets = copies.groupBy(*at).agg(F.sum("n").alias("n")).withColumn(
        "before", F.sum("n").over(W.partitionBy("s").orderBy("copy", "b").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).drop("n")
    within = copies.withColumn("cum", F.sum("n").over(W.partitionBy(*at).orderBy("h", "k", "th").rowsBetween(W.unboundedPreceding, 0)))
    timed = within.join(offsets, at).withColumn("finish", (F.col("before") + F.col("cum")) / F.col("w"))
    last = max((totals[s] * r / w for s, w, r in need), default=1.0)
    bounded = min(last, _finish_of(total, totals, need))
    # past this time the budget is spent, but for one document of each source, which the exact cut below decides
    v = timed.withColumn("v", F.least(F.floor(F.col("finish") / F.lit(bounded or 1.0) * RANGES), F.lit(RANGES * 2)).cast("int"))
    v = written(v.select("k", "s", "th", "n", "copy", "finish", "v"), "timed")
    v_off = v.groupBy("v").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    upto = W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # at most 2 x RANGES + 1 rows
    v_off = v_off.select("v", (F.sum("tokens").over(upto) - F.col("tokens")).alias("t0"), (F.sum("rows").over(upto) - F.col("rows")).alias("p0")).where(F.col("t0") < F.lit(total))
    order = W.partitionBy("v").orderBy("finish", "s", "k", "th", "copy").rowsBetween(W.unboundedPreceding, 0)
    placed = v.join(F.broadcast(v_off), "v").select("k", "s", "n", "copy", "t0", "p0", "finish", F.sum("n").over(order).alias("c"), F.count(F.lit(1)).over(order).alias("p"))
    kept = placed.where(F.col("t0") + F.col("c") <= F.lit(total))
    return kept.select((F.col("p0") + F.col("p")).alias("position"), F.col("k").alias(key), "copy", F.col("s").alias("source"), F.col("n").alias("n_tokens")).orderBy("position")


def _finish_of(total: float, totals: dict[str, int], need: list[tuple[str, float, int]]) -> float:
    """The virtual time by which ``total`` tokens are served, or that by which all are."""
    ends = sorted((totals[s] * r / w, w) for s, w, r in need)
    served, at, weight = 0.0, 0.0, sum(w for _, w in ends)
    for end, w in ends:
        if served + (end - at) * weight >= total:
            return at + (total - served) / weight
        served, at, weight = served + (end - at) * weight, end, max(0.0, weight - w)
    return at


def shares(mixed: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each target: its share, repeats and tokens available, and the records, tokens and share it has in ``mixed``."""
    spark = mixed.sparkSession
    t = spark.createDataFrame(_targets(targets), "source string, target_share double, max_repeats int")
    have = sizes.groupBy(F.col("s").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("mixed_records"), F.sum("n_tokens").alias("mixed_tokens"), (F.max("copy") + 1).alias("most_repeats"))
    zero = {c: 0 for c in ("documents", "tokens", "mixed_records", "mixed_tokens", "most_repeats")}
    all_ = t.join(have, "source", "left").join(got, "source", "left").fillna(zero)
    whole = F.sum("mixed_tokens").over(W.partitionBy(F.lit(0)))  # a row for each target
    return all_.withColumn("share", F.when(whole > 0, F.round(F.col("mixed_tokens") / whole, 6)).otherwise(F.lit(0.0)))

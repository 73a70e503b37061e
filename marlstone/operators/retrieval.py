"""Lexical retrieval with concept similarity, metadata boosts and a confidence decision.

The queries are parameters: what can be known of them is computed before the plan is built, and each document row is
exploded into its scores for the few queries, so nothing is joined. Ranking keeps the best k of each query before the
shuffle (Spark limits window groups map-side).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.text import tokens

# Groups of synonyms, groups of words of one concept, and words of the domain itself.
SYNONYMS = {
    "police": "police background screening", "check": "check verification verify", "employment": "employment employer recruitment onboarding hr",
    "time": "time long processing duration day days", "documents": "documents document required requirements paperwork forms",
    "who": "who needs need applicants applicant job seekers candidates",
}
CONCEPTS = {
    "safety_check": "police check background screening verification", "audience": "applicants candidate candidates job seekers employer hr",
    "time": "time processing duration day days long timeline", "requirements": "required requirements documents document id passport proof",
    "compliance": "compliance policy regulation regulated risk", "workflow": "onboarding process steps guide checklist",
}
DOMAIN = "police check employment recruitment compliance".split()
#: Signs of a query's kind; the words and name parts that such a query favours, with their worth.
KINDS = [
    (("how long", "processing time", "take"), "time processing day days 1 3".split(), 3, ("time", "processing"), 2),
    (("who needs", "for first-time", "for job seekers", "for employment"), "employer recruitment candidate applicants job".split(), 2, (), 0),
    (("documents", "required", "requirements"), "documents required requirements id passport".split(), 4, ("document", "requirement"), 2),
    (("employment",), "employment employer recruitment".split(), 2, (), 0),
]
#: Document types that a kind of query favours.
TYPES = [(("compliance",), ("checklist", "requirements"), 3), (("how long", "processing time", "take"), ("faq",), 2), (("documents", "required", "requirements"), ("requirements",), 3)]


@dataclass(frozen=True)
class Query:
    """One query with what follows from its text alone."""

    name: str
    text: str

    @property
    def tokens(self) -> list[str]:
        own = set(re.findall("[a-z0-9]+", self.text.lower()))
        more = {w for g in SYNONYMS.values() if own & set(g.split()) for w in g.split()}
        return sorted(own | more)

    def has(self, signs: tuple[str, ...]) -> bool:
        return any(s in self.text.lower() for s in signs)

    @property
    def concepts(self) -> list[float]:
        return [float(len(set(self.tokens) & set(g.split()))) for g in CONCEPTS.values()]


def _words(ws: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in ws))


def _score(q: Query) -> Column:
    doc, stem = F.col("toks"), F.col("stem")
    s = F.size(F.array_intersect(doc, _words(q.tokens)))
    for signs, favoured, worth, parts, more in KINDS:
        if q.has(signs):
            s = s + F.when(F.arrays_overlap(doc, _words(favoured)), worth).otherwise(0)
            if parts:
                s = s + F.when(stem.rlike("|".join(parts)), more).otherwise(0)
    s = s + 2 * F.size(F.array_intersect(F.col("topic_toks"), _words(q.tokens))) + F.when(F.col("approved"), 1).otherwise(0) + F.col("authority_points")
    for signs, types, worth in TYPES:
        if q.has(signs):
            s = s + F.when(F.col("document_type").isin(*types), worth).otherwise(0)
    norm = math.sqrt(sum(x * x for x in q.concepts))
    dot = sum((F.col(f"c{i}") * x for i, x in enumerate(q.concepts) if x), F.lit(0.0))
    similarity = F.when(F.col("c_norm") > 0, dot / (F.col("c_norm") * F.lit(norm))) if norm else F.lit(None).cast("double")
    similarity = F.coalesce(similarity, F.lit(0.0))
    return F.struct(F.lit(q.name).alias("query"), (s + F.floor(similarity * 4 + 1e-9)).cast("bigint").alias("score"), F.round(similarity, 6).alias("semantic_score"))


def scored(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """(query, doc_id, score, semantic_score) of every document for every query, scores above 0 only.

    ``docs``: doc_id, text, file_stem, topic, document_type, approved, authority_score; nulls count as empty, not
    approved, and an authority of 0.5.
    """
    authority = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("authority_score", F.lit(0.5))))
    base = docs.select(
        "doc_id", F.array_distinct(tokens(F.coalesce("text", F.lit("")))).alias("toks"), F.coalesce("file_stem", F.lit("")).alias("stem"),
        F.array_distinct(tokens(F.coalesce("topic", F.lit("")))).alias("topic_toks"), F.coalesce("document_type", F.lit("")).alias("document_type"),
        F.coalesce("approved", F.lit(False)).alias("approved"), F.bround(authority * 3).cast("bigint").alias("authority_points"),
    )
    hits = {f"c{i}": F.size(F.array_intersect("toks", _words(g.split()))).cast("double") for i, g in enumerate(CONCEPTS.values())}
    base = base.withColumns(hits)
    base = base.withColumn("c_norm", F.sqrt(sum((F.col(c) * F.col(c) for c in hits), F.lit(0.0))))
    each = base.select("doc_id", F.explode(F.array(*(_score(q) for q in queries))).alias("x"))
    return each.select("x.query", "doc_id", "x.score", "x.semantic_score").where("score > 0")


def top_k(scores: DataFrame, k: int = 3) -> DataFrame:
    """The best k of each query with their rank; equal scores by doc_id."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def in_domain(docs: DataFrame, queries: list[Query]) -> DataFrame:
    """(query, overlap): how many of a query's tokens are words of some topic or document type, or of the domain."""
    words = [w for q in queries for w in q.tokens]
    own = docs.select(F.explode(tokens(F.concat_ws(" ", "topic", "document_type"))).alias("w")).where(F.col("w").isin(words)).distinct()
    spark = docs.sparkSession
    q = spark.createDataFrame([(x.name, t, t in DOMAIN) for x in queries for t in x.tokens], "query string, w string, known boolean")
    met = q.join(own.withColumn("found", F.lit(True)), "w", "left")
    return met.groupBy("query").agg(F.sum((F.col("known") | F.coalesce("found", F.lit(False))).cast("bigint")).alias("overlap"))


def guarded(docs: DataFrame, queries: list[Query], least_score: int = 3, least_confidence: float = 0.35) -> DataFrame:
    """(query, status, confidence, top_score): one row for each query, decided by its two best scores."""
    best = top_k(scored(docs, queries), 2).groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0)).alias("second"))
    all_ = in_domain(docs, queries).join(best, "query", "left")
    confidence = F.round((F.col("first") - F.col("second")) / (F.col("first") + 1), 6)
    status = (
        F.when(F.col("overlap") == 0, "out_of_domain").when(F.col("first").isNull(), "no_match").when(F.col("first") < least_score, "low_confidence")
        .when(confidence < least_confidence, "low_confidence").otherwise("ok")
    )
    scored_at_all = (F.col("overlap") > 0) & F.col("first").isNotNull()
    return all_.select("query", status.alias("status"), F.when(scored_at_all, confidence).otherwise(0.0).alias("confidence"), F.when(scored_at_all, F.col("first")).otherwise(0).cast("bigint").alias("top_score"))


def routed(docs: DataFrame, queries: list[Query], wanted: int, *, rerank=None, fetched: int = 3, most: int = 20) -> DataFrame:
    """(query, route, doc_id, rank): results of each query that is sure of them, `web` without any for the others.

    ``wanted`` is held within 1 and ``most``; so many times ``fetched`` are fetched, ``rerank`` (a transform of query, doc_id, score, rank) may set their ranks anew, and the first are kept.
    """
    k = max(1, min(wanted, most))
    found = top_k(scored(docs, queries), k * fetched)
    first = (rerank(found) if rerank else found).where(F.col("rank") <= k).select("query", F.lit("internal").alias("route"), "doc_id", "rank")
    route = guarded(docs, queries).select("query", F.when(F.col("status") == "ok", "internal").otherwise("web").alias("route"))
    return route.join(first, ["query", "route"], "left")


#: Parts that each group of ``packed`` is cut into.
PARTS = 64


def packed(docs: DataFrame, by: list[str], order: list[Column], estimate: Column, target: int, most: int) -> DataFrame:
    """The longest prefix of each group that fills a token budget: a row stays while the sum before it is under ``target``
    and, but for the first row, the sum with it is at most ``most``. Adds running_tokens. Rows without tokens are left out.

    As a row has a token or more, the first ``target`` rows of a group suffice. They are picked in two steps, first within
    ``PARTS`` parts of each group, so that no task ever holds a whole group.
    """
    w = W.partitionBy(*by).orderBy(*order)
    part = W.partitionBy(*by, "_p").orderBy(*order)
    sized = docs.withColumn("_e", estimate).where("_e > 0").withColumn("_p", F.pmod(F.xxhash64(*docs.columns), F.lit(PARTS)))
    few = sized.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= target).drop("_p")
    run = few.withColumn("_n", F.row_number().over(w)).withColumn("running_tokens", F.sum("_e").over(w.rowsBetween(W.unboundedPreceding, 0)))
    keep = (F.col("running_tokens") - F.col("_e") < target) & ((F.col("_n") == 1) | (F.col("running_tokens") <= most))
    return run.where(keep).drop("_e", "_n")

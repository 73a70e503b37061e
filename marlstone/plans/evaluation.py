"""Queries that hold results against expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import tokens
from marlstone.operators import retrieval as V
from marlstone.operators.changes import latest
from marlstone.plans import search
from marlstone.plans import sql as S
from marlstone.plans.registry import SQL, register
from marlstone.sources.tables import read_table

#: What each query of the benchmark should come to, and how alike a draft must be to its golden one.
EXPECTED = {"police_check": "ok", "documents": "ok", "compliance": "ok", "retention": "low_confidence", "travel": "out_of_domain"}
LEAST_ALIKE = 0.18


@register("retrieval_benchmark", f"""
with e as (select * from (values {', '.join(f'({S.q(k)}, {S.q(v)})' for k, v in EXPECTED.items())}) as t(query, expected)), g as ({SQL['lexical_guard']}), t as (select query, doc_id as top_doc from ({SQL['lexical_top_k']}) where rank = 1)
select e.query, expected, status, confidence, top_doc, expected = status as passed, '| ' || e.query || ' | ' || expected || ' | ' || status || ' | ' || case when expected = status then 'PASS' else 'FAIL' end || ' |' as line
from e left join g on g.query = e.query left join t on t.query = e.query""")
def retrieval_benchmark(spark, folder):
    """Each benchmark query's status against the expected one, with a line for a report."""
    docs = search._docs(spark, folder)
    e = spark.createDataFrame(list(EXPECTED.items()), "query string, expected string")
    top = V.top_k(V.scored(docs, search.QUERIES), 1).select("query", F.col("doc_id").alias("top_doc"))
    j = e.join(V.guarded(docs, search.QUERIES).select("query", "status", "confidence"), "query", "left").join(top, "query", "left").withColumn("passed", F.col("expected") == F.col("status"))
    line = F.concat(F.lit("| "), F.col("query"), F.lit(" | "), F.col("expected"), F.lit(" | "), F.col("status"), F.lit(" | "), F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.lit(" |"))
    return j.withColumn("line", line)


_T = S.tokens("coalesce({0}, '')")


@register("golden_pass_rate", f"""
with r as (select * from {S.latest('resilience_report', 'id', 'run_at desc')}), g as (select name, arg_min(draft, {{'a': run_at, 'b': id}}) as golden from r where draft is not null and draft <> '' group by name),
x as (select r.id, r.name, list_distinct({_T.format('r.draft')}) as a, list_distinct({_T.format('g.golden')}) as b from r left join g on g.name = r.name),
j as (select name, case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end as s from x)
select name, count(*) as cases, count(*) filter (s >= {LEAST_ALIKE}) as passed, round_even(count(*) filter (s >= {LEAST_ALIKE}) * 100.0::double / count(*), 2) as pass_percent, round(avg(s), 6) as mean_similarity from j group by name""")
def golden_pass_rate(spark, folder):
    """Drafts of each kind against the first one of their kind, by token-set similarity."""
    r = latest(read_table(spark, folder, "resilience_report"), "id", F.col("run_at"), ["id", "name", "draft", "run_at"])
    golden = r.where("draft is not null and draft <> ''").groupBy("name").agg(F.min_by("draft", F.struct("run_at", "id")).alias("golden"))
    x = r.join(golden, "name", "left").select("name", *(F.array_distinct(tokens(F.coalesce(c, F.lit("")))).alias(c) for c in ("draft", "golden")))
    s = F.when((F.size("draft") == 0) | (F.size("golden") == 0), 0.0).otherwise(F.size(F.array_intersect("draft", "golden")) / F.size(F.array_union("draft", "golden")))
    j = x.select("name", s.alias("s"))
    n, ok = F.count(F.lit(1)), F.count_if(F.col("s") >= LEAST_ALIKE)
    return j.groupBy("name").agg(n.alias("cases"), ok.alias("passed"), F.bround(ok * 100.0 / n, 2).alias("pass_percent"), F.round(F.avg("s"), 6).alias("mean_similarity"))

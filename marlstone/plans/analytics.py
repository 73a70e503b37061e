"""Queries of operational analytics: sources, embeddings, requests, sessions, reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators.changes import latest
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.sources.tables import read_table

_KNOW = S.latest("validex_knowledge", "chunk_id", "created_at desc, chunk_hash")


def _know(spark, folder, *columns):
    return latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", *columns])


def _percent(part, whole):
    return F.when(whole > 0, F.bround(part * 100.0 / whole, 2)).otherwise(0.0)


@register("source_totals", f"select count(*) as chunks, count(distinct source_url) as sources from {_KNOW} where approved")
def source_totals(spark, folder):
    return _know(spark, folder, "approved", "source_url").where("approved").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_url").alias("sources"))


@register("topic_histogram", f"select topic, count(*) as chunks, count(distinct source_url) as sources from {_KNOW} where approved group by topic")
def topic_histogram(spark, folder):
    return _know(spark, folder, "approved", "topic", "source_url").where("approved").groupBy("topic").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_url").alias("sources")).orderBy(F.desc("chunks"), "topic")


#: Lower bounds of the bands of authority, best first.
BANDS = [(0.9, "0.90-1.00"), (0.8, "0.80-0.89"), (0.7, "0.70-0.79"), (0.6, "0.60-0.69")]


@register("authority_bands", f"""
select case {' '.join(f"when authority_score >= {x} then {S.q(n)}" for x, n in BANDS)} else '<0.60' end as band,
  case {' '.join(f"when authority_score >= {x} then {i}" for i, (x, _) in enumerate(BANDS))} else {len(BANDS)} end as band_rank, count(distinct source_url) as sources, count(*) as chunks
from {_KNOW} where approved group by all""")
def authority_bands(spark, folder):
    a = F.col("authority_score")
    name, rank = F, F
    for i, (x, n) in enumerate(BANDS):
        name, rank = name.when(a >= x, n), rank.when(a >= x, i)
    d = _know(spark, folder, "approved", "authority_score", "source_url").where("approved").groupBy(name.otherwise("<0.60").alias("band"), rank.otherwise(len(BANDS)).alias("band_rank"))
    return d.agg(F.countDistinct("source_url").alias("sources"), F.count(F.lit(1)).alias("chunks")).orderBy("band_rank")


_GENUINE = "coalesce(embedding_provider, 'unknown') in ('openai', 'google')"


@register("provider_health", f"""
with k as (select count(*) as total, count(*) filter ({_GENUINE}) as genuine, count(*) filter (embedding_provider = 'fake') as fake from {_KNOW})
select total, genuine, fake, greatest(0, total - genuine - fake) as other, case when total > 0 then round_even(genuine * 100.0::double / total, 2) else 0 end as genuine_percent,
  case when total > 0 then round_even(fake * 100.0::double / total, 2) else 0 end as fake_percent, genuine > 0 as ready, total - genuine as to_refresh from k""")
def provider_health(spark, folder):
    p = F.coalesce("embedding_provider", F.lit("unknown"))
    k = _know(spark, folder, "embedding_provider").agg(F.count(F.lit(1)).alias("total"), F.count_if(p.isin("openai", "google")).alias("genuine"), F.count_if(p == "fake").alias("fake"))
    return k.select(
        "total", "genuine", "fake", F.greatest(F.lit(0), F.col("total") - F.col("genuine") - F.col("fake")).alias("other"), _percent(F.col("genuine"), F.col("total")).alias("genuine_percent"),
        _percent(F.col("fake"), F.col("total")).alias("fake_percent"), (F.col("genuine") > 0).alias("ready"), (F.col("total") - F.col("genuine")).alias("to_refresh"))


@register("provider_topics", f"select coalesce(embedding_provider, 'unknown') as provider, topic, count(*) as chunks from {_KNOW} group by all")
def provider_topics(spark, folder):
    return _know(spark, folder, "embedding_provider", "topic").groupBy(F.coalesce("embedding_provider", F.lit("unknown")).alias("provider"), "topic").agg(F.count(F.lit(1)).alias("chunks"))


@register("verify_ingest", """
select count(*) as records, count(distinct chunk_id) as chunks, count(distinct doc_id) as docs, count(distinct chunk_hash) as hashes, coalesce(min(authority_score), 0) as least_authority, coalesce(max(authority_score), 0) as most_authority,
  count(*) - count(distinct chunk_id) as repeated from validex_knowledge""")
def verify_ingest(spark, folder):
    d = read_table(spark, folder, "validex_knowledge").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("chunk_hash").alias("hashes"),
        F.coalesce(F.min("authority_score"), F.lit(0.0)).alias("least_authority"), F.coalesce(F.max("authority_score"), F.lit(0.0)).alias("most_authority"))
    return d.withColumn("repeated", F.col("records") - F.col("chunks"))


@register("request_latency", """
with r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events where value is not null),
l as (select event_type, list_sort(list(value)) as v, round(avg(value), 2) as avg_value, count(*) as samples from r where n <= 200 group by event_type)
select event_type, samples, avg_value, v[cast(floor(0.95 * (samples - 1)) as bigint) + 1] as p95 from l""")
def request_latency(spark, folder):
    """Mean and lower-rank 95th percentile of the last 200 values of each kind; only 200 rows a kind are ever gathered."""
    w = W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = read_table(spark, folder, "events").where("value is not null").withColumn("n", F.row_number().over(w)).where("n <= 200")
    v = F.sort_array(F.collect_list("value"))
    at = F.floor(0.95 * (F.count(F.lit(1)) - 1)).cast("int") + 1
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 2).alias("avg_value"), F.element_at(v, at).alias("p95"))


@register("mode_histogram", """
with h as (select event_type as mode, count(*) as requests, count(*) filter (value > 100) as slow from events group by event_type)
select mode, requests, slow, round_even(slow * 100.0::double / requests, 2) as slow_percent, greatest(8.0, round(requests * 100.0::double / max(requests) over (), 2)) as bar from h""")
def mode_histogram(spark, folder):
    h = read_table(spark, folder, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("value") > 100).alias("slow"))
    most = F.max("requests").over(W.partitionBy(F.lit(0)))  # a row for each kind
    return h.select("mode", "requests", "slow", _percent(F.col("slow"), F.col("requests")).alias("slow_percent"), F.greatest(F.lit(8.0), F.round(F.col("requests") * 100.0 / most, 2)).alias("bar"))


@register("pass_rate", f"""
select name, count(*) as reports, count(*) filter (passed) as passed, case when count(*) > 0 then round_even(count(*) filter (passed) * 100.0::double / count(*), 2) else 0 end as pass_percent,
  count(*) filter (error is not null) as failed, min(word_count) as least_words, max(word_count) as most_words
from {S.latest('resilience_report', 'id', 'run_at desc')} group by name""")
def pass_rate(spark, folder):
    cols = ["id", "name", "passed", "error", "word_count"]
    own = latest(read_table(spark, folder, "resilience_report"), "id", F.col("run_at"), cols)
    d = own.groupBy("name").agg(F.count(F.lit(1)).alias("reports"), F.count_if("passed").alias("passed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min("word_count").alias("least_words"), F.max("word_count").alias("most_words"))
    return d.withColumn("pass_percent", _percent(F.col("passed"), F.col("reports")))


_SESS = S.latest("chat_sessions", "session_id", "updated_at desc")


def _sessions(spark, folder):
    return latest(read_table(spark, folder, "chat_sessions"), "session_id", F.col("updated_at"), ["session_id", "user_id", "turns", "created_at", "updated_at"])


@register("session_list", f"""
select user_id, session_id, turns_no as turn_count, case when p is null or trim(p) = '' then 'New Chat' when length(p) > 50 then substr(p, 1, 50) || '...' else p end as title, rank from (
  select *, len(turns) as turns_no, turns[1].user_prompt as p, row_number() over (partition by user_id order by updated_at desc, session_id) as rank from {_SESS}) where rank <= 20""")
def session_list(spark, folder):
    """The 20 sessions of each user saved last, nulls being one user."""
    p = F.try_element_at("turns", F.lit(1))["user_prompt"]
    title = F.when(p.isNull() | (F.trim(p) == ""), "New Chat").when(F.length(p) > 50, F.concat(F.substring(p, 1, 50), F.lit("..."))).otherwise(p)
    w = W.partitionBy("user_id").orderBy(F.desc("updated_at"), "session_id")
    d = _sessions(spark, folder).select("user_id", "session_id", "updated_at", F.size("turns").cast("bigint").alias("turn_count"), title.alias("title"))
    return d.withColumn("rank", F.row_number().over(w)).where("rank <= 20").select("user_id", "session_id", "turn_count", "title", F.col("rank").cast("bigint").alias("rank"))


@register("session_state", f"""
select session_id, len(turns) as turn_count, list_filter(turns, lambda t: t.generated_draft is not null)[-1].generated_draft as draft, turns[1].parsed_topic as first_topic, turns[-1].user_prompt as last_prompt,
  len(list_filter(turns, lambda t: t.generated_draft is not null)) > 0 as continues,
  array_to_string(list_transform(turns[-3:], lambda t: 'User: ' || substr(coalesce(t.user_prompt, ''), 1, 120) || ' | Assistant: ' || substr(coalesce(t.assistant_output, ''), 1, 200)), chr(10)) as summary from {_SESS}""")
def session_state(spark, folder):
    """What a follow-up prompt builds on: the last draft, the first topic, and a summary of the last three turns."""
    drafts = F.filter("turns", lambda t: t["generated_draft"].isNotNull())
    line = lambda t: F.concat(F.lit("User: "), F.substring(F.coalesce(t["user_prompt"], F.lit("")), 1, 120), F.lit(" | Assistant: "), F.substring(F.coalesce(t["assistant_output"], F.lit("")), 1, 200))
    n = F.size("turns")
    return _sessions(spark, folder).select(
        "session_id", n.cast("bigint").alias("turn_count"), F.try_element_at(drafts, F.lit(-1))["generated_draft"].alias("draft"), F.try_element_at("turns", F.lit(1))["parsed_topic"].alias("first_topic"),
        F.try_element_at("turns", F.lit(-1))["user_prompt"].alias("last_prompt"), (F.size(drafts) > 0).alias("continues"),
        F.array_join(F.transform(F.slice("turns", F.greatest(n - 2, F.lit(1)), F.lit(3)), line), "\n").alias("summary"))


@register("session_messages", f"""
with t as (select session_id, unnest(turns[-4:]) as t, unnest(range(1, len(turns[-4:]) + 1)) as n from {_SESS}),
m as (select session_id, n, 'human' as role, t.user_prompt as content from t union all select session_id, n, 'ai', coalesce(substr(nullif(t.generated_draft, ''), 1, 300), substr(t.assistant_output, 1, 300)) from t)
select session_id, n, role, content from m where content is not null and content <> ''""")
def session_messages(spark, folder):
    """The last four turns of each session as messages of both sides, empty ones left out."""
    n = F.size("turns")
    t = _sessions(spark, folder).where(n > 0).select("session_id", F.posexplode(F.slice("turns", F.greatest(n - 3, F.lit(1)), F.lit(4))).alias("n", "t"))
    draft = F.when(F.col("t.generated_draft") != "", F.substring("t.generated_draft", 1, 300))
    sides = F.array(F.struct(F.lit("human").alias("role"), F.col("t.user_prompt").alias("content")), F.struct(F.lit("ai").alias("role"), F.coalesce(draft, F.substring("t.assistant_output", 1, 300)).alias("content")))
    m = t.select("session_id", (F.col("n") + 1).cast("bigint").alias("n"), F.explode(sides).alias("m"))
    return m.select("session_id", "n", "m.role", "m.content").where("content is not null and content <> ''")


@register("session_expiry", f"select session_id from {_SESS} where updated_at < timestamptz '2025-01-01 00:00:00+00' - interval 30 day")
def session_expiry(spark, folder):
    return _sessions(spark, folder).where(F.col("updated_at") < F.expr("timestamp'2025-01-01 00:00:00' - interval 30 days")).select("session_id")


@register("report_list", f"""
select id, name, substr(draft, 1, 180) as preview, rank from (select *, row_number() over (order by run_at desc, id) as rank from {S.latest('resilience_report', 'id', 'run_at desc')}) where rank <= 20""")
def report_list(spark, folder):
    own = latest(read_table(spark, folder, "resilience_report"), "id", F.col("run_at"), ["id", "name", "draft", "run_at"])
    top = own.orderBy(F.desc("run_at"), "id").limit(20)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("run_at"), "id"))  # 20 rows
    return top.select("id", "name", F.substring("draft", 1, 180).alias("preview"), rank.cast("bigint").alias("rank"))

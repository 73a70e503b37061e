"""Queries of change capture: snapshots compared, merged, and sources reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.text import chunk_hash, topic_of_stem
from marlstone.operators import changes as C
from marlstone.operators.ordered import numbered
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.sources.tables import read_table

_FIELDS = ["chunk_id", "doc_id", "topic", "title", "authority_score", "approved"]


def _old(spark, folder):
    cols = [*_FIELDS, "content", "created_at"]
    own = C.latest(read_table(spark, folder, "validex_knowledge").select(*cols), "chunk_id", F.struct("created_at"), cols)
    return own.withColumnRenamed("content", "text").withColumn("digest", chunk_hash(*(F.col(c) for c in [*_FIELDS, "text"])))


def _new(spark, folder):
    cols = [*_FIELDS, "text", "loaded_at"]
    own = C.latest(read_table(spark, folder, "au_blog_chunks").select(*cols), "chunk_id", F.struct("loaded_at"), cols)
    return own.withColumnRenamed("loaded_at", "created_at").withColumn("digest", chunk_hash(*(F.col(c) for c in [*_FIELDS, "text"])))


def _digest(text: str) -> str:
    parts = ", ".join(f"coalesce('=' || cast({c} as varchar), '~')" for c in [*_FIELDS, text])
    return f"sha1(concat_ws(chr(31), {parts}))"


_O = f"(select *, {_digest('content')} as digest from {S.latest('validex_knowledge', 'chunk_id', 'created_at desc, chunk_hash')})"
_N = f"(select *, {_digest('text')} as digest from {S.latest('au_blog_chunks', 'chunk_id', 'loaded_at desc')})"
_LABEL = "case when o.digest is null then 'insert' when n.digest is null then 'delete' when o.digest = n.digest then 'unchanged' else 'update' end"


@register("cdc_changes", f"select coalesce(o.chunk_id, n.chunk_id) as chunk_id, {_LABEL} as change from {_O} o full join {_N} n on o.chunk_id = n.chunk_id")
def cdc_changes(spark, folder):
    """What an ingestion of the crawled chunks changes in the knowledge table."""
    return C.changes(_old(spark, folder), _new(spark, folder), "chunk_id", "digest")


@register("cdc_counts", f"select {_LABEL} as change, count(*) as chunks from {_O} o full join {_N} n on o.chunk_id = n.chunk_id group by 1")
def cdc_counts(spark, folder):
    return cdc_changes(spark, folder).groupBy("change").agg(F.count(F.lit(1)).alias("chunks"))


def _sql_upsert(join: str) -> str:
    pick = ", ".join(f"case when n.chunk_id is not null then n.{c} else o.{c} end as {c}" for c in _FIELDS[1:])
    return f"""select coalesce(n.chunk_id, o.chunk_id) as chunk_id, {pick}, md5(case when n.chunk_id is not null then n.text else o.content end) as text_md5,
  epoch_us(coalesce(o.created_at, n.loaded_at)) as created_us from {_O} o {join} join {_N} n on o.chunk_id = n.chunk_id"""


def _upsert(spark, folder, prune):
    d = C.upserted(_old(spark, folder), _new(spark, folder), "chunk_id", ["created_at"], prune)
    return d.select(*_FIELDS, F.md5("text").alias("text_md5"), F.unix_micros("created_at").alias("created_us"))


@register("cdc_upsert", _sql_upsert("right"))
def cdc_upsert(spark, folder):
    """The next snapshot, rows that the run didn't deliver pruned."""
    return _upsert(spark, folder, True)


@register("cdc_upsert_keep", _sql_upsert("full"))
def cdc_upsert_keep(spark, folder):
    """The next snapshot with rows that the run didn't deliver kept."""
    return _upsert(spark, folder, False)


_PLACE = r"try_cast(regexp_extract(chunk_id, '_([0-9]+)$', 1) as bigint)"


@register("incremental_reuse", f"""
with c as (select distinct source_url, chunk_id, text from au_blog_chunks where source_url is not null),
p as (select source_url, sha1(string_agg(coalesce(text, ''), chr(10) || chr(10) order by {_PLACE}, chunk_id)) as sha1, count(*) as chunks from c group by source_url)
select coalesce(p.source_url, s.source_url) as source_url, coalesce(chunks, 0) as chunks,
  case when p.source_url is null then 'missing' when s.source_url is null then 'new' when p.sha1 = s.sha1 then 'reused' else 'changed' end as state from p full join source_state s on p.source_url = s.source_url""")
def incremental_reuse(spark, folder):
    """Which pages' text is as stored last, so that their chunks can be reused. A page has few chunks."""
    c = read_table(spark, folder, "au_blog_chunks").select("source_url", "chunk_id", "text").where("source_url is not null").distinct()
    place = F.regexp_extract("chunk_id", "_([0-9]+)$", 1).try_cast("bigint")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), "chunk_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    p = c.groupBy("source_url").agg(F.sha1(text).alias("own"), F.count(F.lit(1)).alias("chunks"))
    s = read_table(spark, folder, "source_state").select("source_url", F.col("sha1").alias("stored"))
    state = F.when(F.col("own").isNull(), "missing").when(F.col("stored").isNull(), "new").when(F.col("own") == F.col("stored"), "reused").otherwise("changed")
    return p.join(s, "source_url", "full_outer").select("source_url", F.coalesce("chunks", F.lit(0)).alias("chunks"), state.alias("state"))


_STEM_TOPIC = "coalesce(nullif(lower(array_to_string(list_filter(string_split(replace(stem, '-', '_'), '_'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+'))[1:4], ' ')), ''), 'general')"


@register("metadata_merge", f"""
with v as (select doc_id, coalesce(topic, '') as topic, authority_score, epoch_us(created_at)::varchar || chunk_id as o from validex_knowledge where doc_id is not null),
m as (select doc_id, max_by(topic, o) as topic, max_by(coalesce(authority_score, 0.5), o) as authority from v group by doc_id),
u as (select doc_id, regexp_extract(source_url, '([^/?#]+)/*$', 1) as stem from au_blog_chunks where doc_id is not null and source_url is not null),
n as (select doc_id, min({_STEM_TOPIC}) as topic from u group by doc_id)
select coalesce(m.doc_id, n.doc_id) as doc_id, coalesce(nullif(m.topic, ''), n.topic, 'general') as topic, least(1.0, greatest(0.0, coalesce(m.authority, 0.5))) as authority,
  case when m.doc_id is null then 'added' when n.doc_id is null then 'kept' else 'updated' end as state from m full join n on m.doc_id = n.doc_id""")
def metadata_merge(spark, folder):
    """Stored metadata of all documents (the last chunk ingested wins) merged with what the page names of a delivery say, both tables whole."""
    v = read_table(spark, folder, "validex_knowledge").where("doc_id is not null")
    o = F.concat(F.unix_micros("created_at").cast("string"), F.col("chunk_id"))
    m = v.groupBy("doc_id").agg(F.max_by(F.coalesce("topic", F.lit("")), o).alias("a"), F.max_by(F.coalesce("authority_score", F.lit(0.5)), o).alias("authority"), F.lit(1).alias("old"))
    u = read_table(spark, folder, "au_blog_chunks").where("doc_id is not null and source_url is not null")
    n = u.groupBy("doc_id").agg(F.min(topic_of_stem(F.regexp_extract("source_url", "([^/?#]+)/*$", 1))).alias("b"), F.lit(1).alias("new"))
    j = m.join(n, "doc_id", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").otherwise("updated")
    topic = F.coalesce(F.when(F.col("a") != "", F.col("a")), F.col("b"), F.lit("general"))
    return j.select("doc_id", topic.alias("topic"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("authority", F.lit(0.5)))).alias("authority"), state.alias("state"))


@register("session_upsert", """
select session_id, max_by(user_id, updated_at) filter (user_id is not null) as user_id, len(max_by(turns, updated_at)) as turn_count, epoch_us(min(created_at)) as created_us, epoch_us(max(updated_at)) as updated_us from chat_sessions group by session_id""")
def session_upsert(spark, folder):
    """Sessions saved again: the last turns win, a known user stays known."""
    d = read_table(spark, folder, "chat_sessions").select("session_id", "user_id", "created_at", "updated_at", F.size("turns").alias("n"))
    user = F.max_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("updated_at")))
    return d.groupBy("session_id").agg(user.alias("user_id"), F.max_by("n", "updated_at").cast("bigint").alias("turn_count"), F.unix_micros(F.min("created_at")).alias("created_us"), F.unix_micros(F.max("updated_at")).alias("updated_us"))


@register("refresh_batches", f"""
with k as (select chunk_id from {S.latest('validex_knowledge', 'chunk_id', 'created_at desc, chunk_hash')} where coalesce(embedding_provider, 'unknown') not in ('openai', 'google'))
select chunk_id, row_number() over (order by chunk_id) as row_no, cast(floor((row_number() over (order by chunk_id) - 1) / 12) as bigint) as batch from k""")
def refresh_batches(spark, folder):
    """Chunks whose embedding must be made again, in batches of twelve by key."""
    cols = ["chunk_id", "embedding_provider"]
    k = C.latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), cols).where("coalesce(embedding_provider, 'unknown') not in ('openai', 'google')")
    n = numbered(k.select("chunk_id"), [F.col("chunk_id").asc()])
    return n.withColumn("batch", F.floor((F.col("row_no") - 1) / 12).cast("bigint"))


@register("known_domains", """
with a as (select distinct regexp_replace(lower(source_domain), '^www\\.', '') as domain from validex_knowledge where source_domain is not null), c as (select distinct source_url, regexp_replace(lower(source_domain), '^www\\.', '') as domain from au_blog_chunks where source_url is not null and source_domain is not null)
select c.domain, count(*) as pages, a.domain is not null as known from c left join a on a.domain = c.domain group by c.domain, a.domain""")
def known_domains(spark, folder):
    """Crawled pages by domain, and whether the knowledge table has the domain."""
    domain = F.regexp_replace(F.lower("source_domain"), r"^www\.", "")
    a = read_table(spark, folder, "validex_knowledge").select(domain.alias("domain")).where("domain is not null").distinct().withColumn("k", F.lit(True))
    c = read_table(spark, folder, "au_blog_chunks").select("source_url", domain.alias("domain")).where("source_url is not null and domain is not null").distinct()
    return c.groupBy("domain").agg(F.count(F.lit(1)).alias("pages")).join(a, "domain", "left").select("domain", "pages", F.coalesce("k", F.lit(False)).alias("known"))

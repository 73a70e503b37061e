"""Queries that route, join and assemble: what retrieval returns, outlines, contexts, records for sinks, listings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import links as L
from marlstone.functions import text as T
from marlstone.operators import documents as D
from marlstone.operators import retrieval as V
from marlstone.operators import seams as M
from marlstone.operators.changes import latest
from marlstone.plans import sql as S
from marlstone.plans.changes import incremental_reuse
from marlstone.plans.corpus import OVERLAP, WINDOW
from marlstone.plans.publishing import _BASE, _sectioned
from marlstone.plans.registry import SQL, register
from marlstone.plans.requests import LIMIT_PER_MINUTE, _events
from marlstone.plans.search import _DOMAIN, QUERIES, SCORED, _docs
from marlstone.session import ship_package
from marlstone.sources.tables import read_table

# --- what retrieval returns


_STATUS = f"""f as (select query, max(score) filter (rank = 1) as first, coalesce(max(score) filter (rank = 2), 0) as second from k group by query),
j as (select o.query, case when overlap = 0 then 'out_of_domain' when first is null then 'no_match' when first < 3 or round((first - second) / (first + 1), 6) < 0.35 then 'low_confidence' else 'ok' end as status from o left join f using (query))"""


@register("guarded_documents", f"with {SCORED}, {_DOMAIN}, {_STATUS} select j.query, status, k.doc_id, k.score, k.rank from j left join k on k.query = j.query and j.status = 'ok' and k.rank <= 3")
def guarded_documents(spark, folder):
    """Each query's status with its best documents; a query that isn't sure of them keeps one row without any."""
    docs = _docs(spark, folder)
    best = V.top_k(V.scored(docs, QUERIES), 3)
    status = V.guarded(docs, QUERIES).select("query", "status")
    return status.join(best.select("query", F.lit("ok").alias("status"), "doc_id", "score", "rank"), ["query", "status"], "left")


#: Words of the two forms of what is said where retrieval isn't sure.
WARNING, BLOCKED = "> Not grounded in internal sources: ", "No draft: "
REASONS = {"out_of_domain": "the topic is not covered", "no_match": "no source matches", "low_confidence": "sources are not sure enough"}


@register("fallback_payloads", f"""
with {SCORED}, {_DOMAIN}, {_STATUS}
select query, allowed, status, case when status = 'ok' then '' else (case when allowed then {S.q(WARNING)} else {S.q(BLOCKED)} end) || (case {' '.join(f"when status = {S.q(k)} then {S.q(v)}" for k, v in REASONS.items())} end) end as notice,
  status = 'ok' or allowed as drafts, status = 'ok' as cites from j, (values (true), (false)) as a(allowed)""")
def fallback_payloads(spark, folder):
    """What each status leads to, where an ungrounded draft is allowed and where it isn't."""
    g = V.guarded(_docs(spark, folder), QUERIES).select("query", "status", F.explode(F.array(F.lit(True), F.lit(False))).alias("allowed"))
    ok, reason = F.col("status") == "ok", F
    for k, v in REASONS.items():
        reason = reason.when(F.col("status") == k, v)
    notice = F.when(ok, "").otherwise(F.concat(F.when(F.col("allowed"), WARNING).otherwise(BLOCKED), reason))
    return g.select("query", "allowed", "status", notice.alias("notice"), (ok | F.col("allowed")).alias("drafts"), ok.alias("cites"))


_KNOWN = S.latest("validex_knowledge", "chunk_id", "created_at desc, chunk_hash")
_BEST = f"(select *, row_number() over (partition by topic order by authority_score desc nulls last, chunk_id) as n from {_KNOWN} where topic is not null and content is not null)"


def _best(spark, folder, most):
    cols = ["chunk_id", "doc_id", "topic", "title", "source_url", "region", "content", "authority_score"]
    k = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), cols).where("topic is not null and content is not null")
    w = W.partitionBy("topic").orderBy(F.desc_nulls_last("authority_score"), "chunk_id")
    return k.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)  # the best few of each topic, ranked map-side first


#: Documents of a context, and characters of each.
CONTEXT, SNIPPET = 4, 220


def _or(x: str, other: str) -> str:
    return f"coalesce(nullif({S.strip(f'coalesce({x}, {chr(39) * 2})')}, ''), {S.q(other)})"


@register("context_blocks", f"""
select topic, string_agg('[Document ' || n || ']' || chr(10) || 'Content: ' || substr({S.one_line('content')}, 1, {SNIPPET}) || chr(10) || 'Metadata: title=' || {_or('title', 'untitled')} || '; url=' || {_or('source_url', 'n/a')} || '; region=' || {_or('region', 'AU')}
  || '; doc_id=' || doc_id || '; page=' || chunk_id, chr(10) || chr(10) order by n) as context from {_BEST} where n <= {CONTEXT} group by topic""")
def context_blocks(spark, folder):
    """Of each topic its best chunks as one numbered context."""
    filled = lambda c, other: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", T.strip(F.col(c))).otherwise(other)
    block = F.concat(
        F.lit("[Document "), F.col("n").cast("string"), F.lit("]\nContent: "), F.substring(T.one_line(F.col("content")), 1, SNIPPET), F.lit("\nMetadata: title="), filled("title", "untitled"), F.lit("; url="), filled("source_url", "n/a"),
        F.lit("; region="), filled("region", "AU"), F.lit("; doc_id="), F.col("doc_id"), F.lit("; page="), F.col("chunk_id"))
    each = _best(spark, folder, CONTEXT).select("topic", F.struct("n", block.alias("b")).alias("x"))
    return each.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


@register("source_references", f"""
with r as (select topic, n, {_or('title', '')} as t, doc_id, {_or('source_url', 'khong_co')} as u from {_BEST} where n <= 12),
f as (select topic, case when t <> '' then t else doc_id end || ' | URL: ' || u as line, min(n) as n from r group by 1, 2), p as (select *, row_number() over (partition by topic order by n) as place from f)
select topic, place, line from p where place <= 3""")
def source_references(spark, folder):
    """The first three distinct reference lines of each topic's dozen best chunks."""
    lines = _best(spark, folder, 12).select("topic", "n", T.reference_line(F.col("title"), F.col("doc_id"), F.col("source_url")).alias("line"))
    first = lines.groupBy("topic", "line").agg(F.min("n").alias("n"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("n")).cast("bigint"))
    return placed.where("place <= 3").select("topic", "place", "line")


# --- joins, unions and records for sinks


@register("with_metadata", """
with m as (select file_stem, max_by(coalesce(title, ''), doc_id) as title, max_by(coalesce(topic, ''), doc_id) as topic, max_by(coalesce(jurisdiction, ''), doc_id) as region, max_by(coalesce(approved, false), doc_id) as approved from documents where file_stem is not null group by file_stem)
select d.doc_id, coalesce(nullif(m.title, ''), 'Untitled') as title, coalesce(nullif(m.topic, ''), 'general') as topic, coalesce(nullif(m.region, ''), 'AU') as region, coalesce(m.approved, false) as approved, md5(d.text) as text_md5
from documents d left join m on d.file_stem = m.file_stem where d.text is not null and trim(d.text) <> ''""")
def with_metadata(spark, folder):
    """Filled documents with the last metadata of their file stem and defaults, as a vector store takes them."""
    d = read_table(spark, folder, "documents")
    last = lambda c, none: F.max_by(F.coalesce(F.col(c), none), "doc_id")
    m = d.where("file_stem is not null").groupBy("file_stem").agg(last("title", F.lit("")).alias("t"), last("topic", F.lit("")).alias("p"), last("jurisdiction", F.lit("")).alias("r"), last("approved", F.lit(False)).alias("a"))
    own = d.select("doc_id", "file_stem", "text").where("text is not null and trim(text) <> ''")
    filled = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    return own.join(m, "file_stem", "left").select("doc_id", filled("t", "Untitled").alias("title"), filled("p", "general").alias("topic"), filled("r", "AU").alias("region"), F.coalesce("a", F.lit(False)).alias("approved"), F.md5("text").alias("text_md5"))


@register("grouped_records", """
with c as (select distinct source_url, chunk_id, coalesce(text, '') as text from au_blog_chunks where source_url is not null and source_url <> '')
select source_url, count(*) as records, sum(length(text))::bigint as chars, string_agg(chunk_id, ' ' order by chunk_id, text) as chunk_ids from c group by source_url""")
def grouped_records(spark, folder):
    """Stored records by page. A page has few."""
    c = read_table(spark, folder, "au_blog_chunks").where("source_url is not null and source_url <> ''").select("source_url", "chunk_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["chunk_id"])
    return c.groupBy("source_url").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("text")).alias("chars"), F.array_join(ids, " ").alias("chunk_ids"))


_STATES = f"({SQL['incremental_reuse']})"

@register("reused_rows", f"""
with s as (select source_url, state from {_STATES}), c as (select distinct source_url, chunk_id, text from au_blog_chunks where source_url is not null and text is not null),
t as (select c.*, s.state, length(text) as n from c join s using (source_url)),
w as (select source_url, chunk_id, state, text, unnest(generate_series(0, case when state = 'reused' or n <= {WINDOW} then 0 else cast(ceil((n - {OVERLAP}) / {WINDOW - OVERLAP}.0) as bigint) - 1 end)) as i from t)
select source_url, chunk_id, i + 1 as piece_no, state = 'reused' as reused, md5(piece) as piece_md5 from (select *, case when state = 'reused' then text else {S.strip(f"substr(text, i * {WINDOW - OVERLAP} + 1, {WINDOW})")} end as piece from w) where state = 'reused' or piece <> ''""")
def reused_rows(spark, folder):
    """The rows of the next run: stored rows of unchanged pages as they are, with those of all other pages cut anew."""
    s = incremental_reuse(spark, folder).select("source_url", "state")
    c = read_table(spark, folder, "au_blog_chunks").select("source_url", "chunk_id", "text").where("source_url is not null and text is not null").distinct()
    t, step, reused = c.join(s, "source_url"), WINDOW - OVERLAP, F.col("state") == "reused"
    kept = t.where(reused).select("source_url", "chunk_id", F.lit(1).cast("bigint").alias("piece_no"), F.lit(True).alias("reused"), F.md5("text").alias("piece_md5"))
    n = F.length("text")
    last = F.when(n <= WINDOW, 0).otherwise(F.ceil((n - OVERLAP) / step) - 1).cast("bigint")
    cut = t.where(~reused).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    cut = cut.withColumn("piece", T.strip(F.substring(F.col("text"), (F.col("i") * step + 1).cast("int"), F.lit(WINDOW)))).where("piece <> ''")
    return kept.unionByName(cut.select("source_url", "chunk_id", (F.col("i") + 1).alias("piece_no"), F.lit(False).alias("reused"), F.md5("piece").alias("piece_md5")))


#: Addresses that a crawl always starts from.
SEEDS = ["https://start.gov.au/", "https://start.example/"]
_HOSTED = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"


@register("crawl_targets", f"""
with u as (select unnest([{', '.join(map(S.q, SEEDS))}]) as url, true as seed union all select distinct source_url, false from documents where source_url is not null and approved)
select url, max(seed) as seed, max(case when regexp_matches({_HOSTED}, '(^|\\.)gov(\\.|$)') then 0.95 else 0.8 end)::double as authority from u group by url""")
def crawl_targets(spark, folder):
    """What the next crawl visits: the seeds and every approved address, with the authority of their hosts."""
    seeds = spark.createDataFrame([(x, True) for x in SEEDS], "url string, seed boolean")
    found = read_table(spark, folder, "documents").where("source_url is not null and approved").select(F.col("source_url").alias("url"), F.lit(False).alias("seed")).distinct()
    authority = F.when(T.host(F.col("url")).rlike(r"(^|\.)gov(\.|$)"), 0.95).otherwise(0.8)
    return seeds.unionByName(found).groupBy("url").agg(F.max("seed").alias("seed")).withColumn("authority", authority)


# --- listings and counts


@register("crawl_history", """
with d as (select date_trunc('day', loaded_at) as day, count(*) as chunks, count(distinct source_url) as pages, count(*) filter (approved) as approved, count(*) filter (text is null) as errors from au_blog_chunks where loaded_at is not null group by 1)
select epoch_us(day) as day_us, chunks, pages, approved, errors from d order by day desc limit 100""")
def crawl_history(spark, folder):
    """The last hundred days of loading, newest first."""
    c = read_table(spark, folder, "au_blog_chunks").where("loaded_at is not null")
    d = c.groupBy(F.unix_micros(F.date_trunc("day", F.col("loaded_at").cast("timestamp"))).alias("day_us")).agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_url").alias("pages"), F.count_if(F.coalesce("approved", F.lit(False))).alias("approved"), F.count_if(F.col("text").isNull()).alias("errors"))
    return d.orderBy(F.desc("day_us")).limit(100)


@register("user_list", "select user_id, count(distinct session_id) as sessions, epoch_us(max(updated_at)) as seen_us from chat_sessions where user_id is not null group by user_id order by user_id")
def user_list(spark, folder):
    u = read_table(spark, folder, "chat_sessions").where("user_id is not null")
    return u.groupBy("user_id").agg(F.countDistinct("session_id").alias("sessions"), F.unix_micros(F.max("updated_at")).alias("seen_us")).orderBy("user_id")


@register("discovery_counts", "select source_type, count(*) filter (approved) as approved, count(*) filter (not approved) as rejected, count(*) filter (approved is null) as undecided from au_blog_chunks group by source_type")
def discovery_counts(spark, folder):
    a = F.col("approved")
    return read_table(spark, folder, "au_blog_chunks").groupBy("source_type").agg(F.count_if(a).alias("approved"), F.count_if(~a).alias("rejected"), F.count_if(a.isNull()).alias("undecided"))


@register("refresh_progress", f"""
with k as (select coalesce(embedding_provider, 'unknown') in ('openai', 'google') as done from {_KNOWN})
select count(*) filter (not done) as to_do, count(*) as chunks, case when count(*) = 0 then 100.0 else round(100.0 * count(*) filter (done) / count(*), 2) end as percent from k""")
def refresh_progress(spark, folder):
    """How many chunks still need a genuine embedding."""
    k = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "embedding_provider"])
    done = F.coalesce("embedding_provider", F.lit("unknown")).isin("openai", "google")
    n = k.agg(F.count_if(~done).alias("to_do"), F.count(F.lit(1)).alias("chunks"))
    return n.withColumn("percent", F.when(F.col("chunks") == 0, 100.0).otherwise(F.round(100.0 * (F.col("chunks") - F.col("to_do")) / F.col("chunks"), 2)))


@register("rate_by_minute", f"""
select user_id, epoch_us(date_trunc('minute', ts)) as bucket_us, count(*) as requests, greatest(0, count(*) - {LIMIT_PER_MINUTE}) as rejected from events group by 1, 2""")
def rate_by_minute(spark, folder):
    """Requests of each client in fixed minutes; those beyond the limit are rejected but still counted."""
    e = _events(spark, folder).groupBy("user_id", F.unix_micros(F.date_trunc("minute", "ts")).alias("bucket_us")).agg(F.count(F.lit(1)).alias("requests"))
    return e.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - LIMIT_PER_MINUTE))


#: Stages that a request passes, in order.
STAGES = ["parse", "research", "write", "edit", "meta", "done"]


@register("stage_events", f"""
with s as (select distinct session_id, turn_no, t.generated_draft as draft from (select session_id, unnest(turns) as t, unnest(range(0, len(turns))) as turn_no from chat_sessions) where t is not null),
e as (select *, unnest([{', '.join(map(S.q, STAGES))}]) as stage, unnest(range(1, {len(STAGES) + 1})) as event_no from s)
select session_id, turn_no::bigint as turn_no, event_no::bigint as event_no, stage, case when stage = 'done' then length(coalesce(draft, '')) end as chars from e""")
def stage_events(spark, folder):
    """The events that a client of each turn sees, one for each stage."""
    t = read_table(spark, folder, "chat_sessions").select("session_id", F.posexplode("turns").alias("n", "t")).where("t is not null").select("session_id", F.col("n").cast("bigint").alias("turn_no"), F.col("t.generated_draft").alias("draft")).distinct()
    e = t.select("*", F.posexplode(F.array(*map(F.lit, STAGES))).alias("i", "stage"))
    return e.select("session_id", "turn_no", (F.col("i") + 1).cast("bigint").alias("event_no"), "stage", F.when(F.col("stage") == "done", F.length(F.coalesce("draft", F.lit("")))).cast("bigint").alias("chars"))


# --- drafts: scopes, checks, pictures


@register("section_scopes", f"""
with u as (select id, list_transform(secs, lambda s: s.h) as hs, unnest(range(1, len(secs) + 1)) as n from {_BASE})
select id, n::bigint as n, hs[n] as heading, 'Section ' || n || ' of ' || len(hs) as position, array_to_string(list_filter(hs, lambda x, i: i <> n), ' / ') as others from u""")
def section_scopes(spark, folder):
    """Each section of a draft with all its other headings, by place, so that equal headings stay apart."""
    d = _sectioned(spark, folder).select("id", F.transform("sections", lambda s: s["heading"]).alias("hs"))
    u = d.select("id", "hs", F.posexplode("hs").alias("i", "heading"))
    others = F.filter("hs", lambda x, j: j != F.col("i"))
    return u.select("id", (F.col("i") + 1).cast("bigint").alias("n"), "heading", F.format_string("Section %d of %d", F.col("i") + 1, F.size("hs")).alias("position"), F.array_join(others, " / ").alias("others"))


#: Bounds of a structured article, and what a draft must have to pass.
TITLE, SECTIONS, HEADING, LEAST_BODY = (8, 140), (3, 10), (3, 120), 40
LEAST_SECTIONS, LEAST_CHARS = 3, 700


@register("structure_checks", f"""
select id, length(title) between {TITLE[0]} and {TITLE[1]} as title_fits, len(secs) between {SECTIONS[0]} and {SECTIONS[1]} as sections_fit, len(list_filter(secs, lambda s: length(s.h) not between {HEADING[0]} and {HEADING[1]} or length(s.b) < {LEAST_BODY})) as bad_sections,
  case when len(secs) < {LEAST_SECTIONS} then 'insufficient sections' when length({S.strip('draft')}) < {LEAST_CHARS} then 'draft length under threshold' else 'passed' end as gate from {_BASE}""")
def structure_checks(spark, folder):
    """Whether drafts are within the bounds of a structured article, and the first reason why one would be held back."""
    n, bad = F.size("sections"), F.filter("sections", lambda s: ~F.length(s["heading"]).between(*HEADING) | (F.length(s["body"]) < LEAST_BODY))
    gate = F.when(n < LEAST_SECTIONS, "insufficient sections").when(F.length(T.strip(F.col("draft"))) < LEAST_CHARS, "draft length under threshold").otherwise("passed")
    return _sectioned(spark, folder).select("id", F.length("title").between(*TITLE).alias("title_fits"), n.between(*SECTIONS).alias("sections_fit"), F.size(bad).cast("bigint").alias("bad_sections"), gate.alias("gate"))


_PLAIN_BODY = S.one_line(S.sub(S.sub(S.sub("b", r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]+)\]\([^)]*\)", r"\1"), "[#>*_`~]", " "))


@register("described_sections", f"""
with b as (select id, title, coalesce(list_filter(secs, lambda s: s.b <> '')[1].b, '') as b from {_BASE}), p as (select id, {S.one_line('title')} as t, {_PLAIN_BODY} as d from b)
select id, regexp_replace(substr(case when length(t) >= 60 then t when length(d) >= 60 then d else t end, 1, 160), '[ .]+$', '') as description from p""")
def described_sections(spark, folder):
    """The description of a draft of which only title and sections are known: the title, if long enough, else its first filled section."""
    d = _sectioned(spark, folder)
    body = F.coalesce(F.get(F.filter(F.transform("sections", lambda s: s["body"]), lambda x: x != ""), F.lit(0)), F.lit(""))
    t, p = T.one_line(F.col("title")), T.without_markdown(body)
    first = F.when(F.length(t) >= 60, t).when(F.length(p) >= 60, p).otherwise(t)
    return d.select("id", F.regexp_replace(F.substring(first, 1, 160), "[ .]+$", "").alias("description"))


_HEAD = r"(?:^|\n)[ \t]*# [^\n]+"


@register("hero_pictures", f"""
with p as (select id, draft, regexp_extract(draft, {S.q(_HEAD)}) as head, {S.q(L.PICTURES)} || replace(url_encode(title || ' hero editorial'), '%20', '+') || {S.q(L.PICTURE_SIZE)} as picture, title from {_BASE})
select id, case when head = '' or regexp_matches(draft, '!\\[[^\\]]*\\]\\(https?://') then draft else substr(draft, 1, instr(draft, head) + length(head) - 1) || chr(10) || chr(10) || '![' || title || ' hero image](' || picture || ')' || chr(10) || substr(draft, instr(draft, head) + length(head)) end as document from p""")
def hero_pictures(spark, folder):
    """Drafts with one picture after the title, unless they have one or no title."""
    d = _sectioned(spark, folder)
    return d.select("id", D.with_hero(F.col("draft"), F.concat(F.col("title"), F.lit(" hero image")), L.picture_of(F.col("title"), F.lit("hero"))).alias("document"))


def _titled(x: str) -> str:
    t = f"regexp_replace({S.one_line(x)}, '^[ .,!?:;]+|[ .,!?:;]+$', '', 'g')"
    return f"""case when lower({t}) in ('', 'current draft') then 'Current Draft Update' else array_to_string(list_transform(string_split({t}, ' ')[1:{T.MOST_TITLE_WORDS}], lambda x, i: case when i > 1 and i < len(string_split({t}, ' ')[1:{T.MOST_TITLE_WORDS}]) and lower(x) in ({', '.join(map(S.q, T.SMALL))}) then lower(x) else upper(x[1]) || lower(x[2:]) end), ' ') end"""


_SCREENING = S.has("lower(topic)", D.SCREENING)


@register("outlines", f"""
with t as (select distinct parsed_topic as topic from (select unnest(turns).parsed_topic as parsed_topic from chat_sessions) where parsed_topic is not null), h as (select topic, array_to_string(string_split({_titled('topic')}, ' ')[1:8], ' ') as short from t),
o as (select topic, case when {S.has('short', D.QUESTION)} then {_titled(f"regexp_replace(short, {S.q(D.QUESTION)}, '')")} else short end as s from h)
select topic, length, array_to_string(list_concat(list_concat(list_transform(case when {_SCREENING} then [{', '.join(map(S.q, D.FRAME_SCREENING))}] else [{', '.join(map(S.q, D.FRAME_GENERAL))}] end, lambda x: replace(x, '%', s)), case when length = 'long' then [{S.q(D.EXTRA)}] else [] end), [{S.q(D.CONCLUSION[3:])}]), ' / ') as outline
from o, (values ('medium'), ('long')) as l(length)""")
def outlines(spark, folder):
    """Outlines of every topic asked for, in two lengths."""
    t = read_table(spark, folder, "chat_sessions").select(F.explode("turns").alias("t")).select(F.col("t.parsed_topic").alias("topic")).where("topic is not null").distinct()
    each = t.select("topic", F.explode(F.array(F.lit("medium"), F.lit("long"))).alias("length"))
    return each.select("topic", "length", F.array_join(D.outline(F.col("topic"), F.col("length")), " / ").alias("outline"))


@register("drafts_of_topics")
def drafts_of_topics(spark, folder):
    """A draft for every topic of the knowledge table: its outline, a fact of its best chunks for each section, references. The words are our own."""
    facts = _best(spark, folder, 6).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("n", F.substring(T.one_line(F.col("content")), 1, 200).alias("fact"), "chunk_id"))).alias("xs"))
    d = facts.select("topic", D.outline(F.col("topic"), F.lit("medium")).alias("outline"), F.transform("xs", lambda x: x["fact"]).alias("facts"), F.transform("xs", lambda x: x["chunk_id"]).alias("sources"))
    sections = D.drafted_sections(F.col("outline"), F.col("facts"), F.col("topic"))
    return d.select("topic", "sources", sections.alias("sections"), D.markdown(T.title_case(F.col("topic")), sections).alias("draft"))


@register("fake_embeddings")
def fake_embeddings(spark, folder):
    """Stand-ins for the embeddings of all chunks where no model is at hand."""
    ship_package(spark)
    k = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "content"])
    return M.embedded(k.select("chunk_id", "content"), "content", allow_fake=True, out="embedding").select("chunk_id", "embedding", "provider")


# --- without models and services


@register("unassisted_steps", """
select distinct chunk_id, 10.0::double as score, true as kept, 0.0::double as relevance, coalesce(topic, '') as queries, substr(coalesce(content, ''), 1, 500) as summary, 0::bigint as plan, 'ACCEPT' as verdict, 7::bigint as points from validex_knowledge""")
def unassisted_steps(spark, folder):
    """What every step that a model could take says without one."""
    k = read_table(spark, folder, "validex_knowledge").select("chunk_id", "topic", "content").distinct()
    own = M.unassisted(F.col("topic"), F.col("content"))
    own = {**own, "queries": F.coalesce(F.element_at(own["queries"], 1), F.lit("")), "plan": F.size(own["plan"]).cast("bigint")}
    return M.judged(k, "content").withColumns(own).drop("topic", "content").distinct()


@register("shown_sources", f"""
with r as (select topic, n, n || '. ' || coalesce(title, 'untitled') || ' (' || coalesce(source_url, 'n/a') || '): ' || substr({S.one_line('content')}, 1, 160) as x from {_BEST} where n <= 3)
select topic, string_agg(x, chr(10) order by n) as text from r group by topic""")
def shown_sources(spark, folder):
    """Each topic's three best chunks as lines for a reader."""
    return M.shown_results(_best(spark, folder, 3).withColumn("snippet", F.col("content")).withColumnRenamed("source_url", "url"), "topic", "n")


@register("quality_estimates", """
with r as (select id, passed, row_number() over (partition by id order by run_at, word_count) as revision from (select distinct id, passed, run_at, word_count from resilience_report))
select id, revision, case when not coalesce(passed, false) then 4 else greatest(5, 10 - 2 * (revision - 1)) end::bigint as points from r""")
def quality_estimates(spark, folder):
    """Points of each run: few for one that failed, less with each further run of the same test."""
    r = read_table(spark, folder, "resilience_report").select("id", "passed", "run_at", "word_count").distinct()
    n = F.row_number().over(W.partitionBy("id").orderBy(F.col("run_at").asc_nulls_last(), F.col("word_count").asc_nulls_last()))
    r = r.withColumn("revision", n.cast("bigint"))
    return r.select("id", "revision", F.when(~F.coalesce("passed", F.lit(False)), F.lit(4)).otherwise(F.greatest(F.lit(5), 10 - 2 * (F.col("revision") - 1))).cast("bigint").alias("points"))


#: Results of a request, and how many are fetched to choose them from.
WANTED, FETCHED, MOST_WANTED = 4, 3, 20


@register("routed_results", f"""
with {SCORED}, {_DOMAIN}, {_STATUS}, z as (select query, doc_id, score, rank from k where rank <= {WANTED * FETCHED})
select j.query, case when status = 'ok' then 'internal' else 'web' end as route, z.doc_id, z.rank from j left join z on z.query = j.query and j.status = 'ok' and z.rank <= {WANTED}""")
def routed_results(spark, folder):
    """Where each query is answered: from the documents, of which more are fetched than wanted and the first kept where nothing reranks them, or from the web, which is empty without an engine."""
    return V.routed(_docs(spark, folder), QUERIES, WANTED)


@register("turn_records", """
select distinct session_id, turn_no::bigint as turn_no, t.user_prompt as prompt, t.parsed_topic as topic, substr(t.generated_draft, 1, 500) as draft from (select session_id, unnest(turns) as t, unnest(range(0, len(turns))) as turn_no from chat_sessions) where t is not null""")
def turn_records(spark, folder):
    """Turns stored as JSON, drafts cut to 500 characters, and read back."""
    t = read_table(spark, folder, "chat_sessions").select("session_id", F.posexplode("turns").alias("n", "t")).where("t is not null")
    stored = t.select("session_id", F.col("n").cast("bigint").alias("turn_no"), F.to_json(F.struct(
        F.col("t.user_prompt").alias("user_prompt"), F.col("t.parsed_topic").alias("parsed_topic"), F.substring("t.generated_draft", 1, 500).alias("generated_draft"))).alias("j"))
    back = stored.select("session_id", "turn_no", F.from_json("j", "user_prompt string, parsed_topic string, generated_draft string").alias("t"))
    return back.select("session_id", "turn_no", F.col("t.user_prompt").alias("prompt"), F.col("t.parsed_topic").alias("topic"), F.col("t.generated_draft").alias("draft")).distinct()


#: Answers of a model that should hold one object.
ANSWERS = [(1, '{"a": 1}'), (2, ' {"a": {"b": 2}} '), (3, 'Here: {"a": 3} - done'), (4, "[1, 2]"), (5, "none"), (6, '{"a": '), (7, "{a} and {b}"), (8, ""), (9, None)]


@register("json_blocks", "select n::bigint as n, json_extract_string(x, '$.a') as a from (values (1, '{\"a\": 1}'), (2, '{\"a\": {\"b\": 2}}'), (3, '{\"a\": 3}'), (4, null), (5, null), (6, null), (7, null), (8, null), (9, null)) as v(n, x)")
def json_blocks(spark, folder):
    """The object in an answer: the whole answer, else from its first to its last brace; null where that is none."""
    d = spark.createDataFrame(ANSWERS, "n bigint, answer string")
    inner = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    return d.select("n", F.get_json_object(inner, "$.a").alias("a"))


#: Lines of a console for one result, and messages of a refresh.
@register("console_blocks", f"""
select id, array_to_string(['TITLE', title, '', 'SECTIONS', case when len(secs) = 0 then '-' else array_to_string(list_transform(secs, lambda s: '- ' || s.h), chr(10)) end, '', 'WORDS', cast(len({S.words('draft')}) as varchar)], chr(10)) as console from {_BASE}""")
def console_blocks(spark, folder):
    """A draft as labelled blocks for a console."""
    d = _sectioned(spark, folder)
    heads = F.when(F.size("sections") == 0, "-").otherwise(F.array_join(F.transform("sections", lambda s: F.concat(F.lit("- "), s["heading"])), "\n"))
    blocks = F.array(F.lit("TITLE"), F.col("title"), F.lit(""), F.lit("SECTIONS"), heads, F.lit(""), F.lit("WORDS"), F.size(T.words(F.col("draft"))).cast("string"))
    return d.select("id", F.array_join(blocks, "\n").alias("console"))


@register("dimension_messages", f"""
select len(embedding) as dimensions, count(*) as chunks, 'stored vectors have ' || len(embedding) || ' numbers, the model makes {M.FAKE_SIZE}' as message, len(embedding) <> {M.FAKE_SIZE} as mismatch from {_KNOWN} where embedding is not null group by 1""")
def dimension_messages(spark, folder):
    """Whether stored vectors fit those of a model."""
    k = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct("created_at"), ["chunk_id", "embedding"]).where("embedding is not null")
    n = k.groupBy(F.size("embedding").cast("bigint").alias("dimensions")).agg(F.count(F.lit(1)).alias("chunks"))
    return n.select("dimensions", "chunks", F.format_string(f"stored vectors have %d numbers, the model makes {M.FAKE_SIZE}", "dimensions").alias("message"), (F.col("dimensions") != M.FAKE_SIZE).alias("mismatch"))


#: Requests shown as a start: so many, chosen anew by each seed.
SHOWN, SEED = 3, 11


@register("sample_prompts", f"select prompt from (select distinct user_prompt as prompt from (select unnest(turns).user_prompt as user_prompt from chat_sessions) where user_prompt is not null) order by md5('{SEED}' || prompt), prompt limit {SHOWN}")
def sample_prompts(spark, folder):
    """A few of all prompts, in an order that a seed gives."""
    p = read_table(spark, folder, "chat_sessions").select(F.explode("turns").alias("t")).select(F.col("t.user_prompt").alias("prompt")).where("prompt is not null").distinct()
    return p.orderBy(F.md5(F.concat(F.lit(str(SEED)), "prompt")), "prompt").limit(SHOWN)


#: Settings of an engine's parts, as a health check shows them.
@register("runtime_flags", "select * from (values ('embedding_model', false), ('lexical_retrieval', true), ('reranker', false), ('template_writer', true), ('web_search', false)) as v(part, available)")
def runtime_flags(spark, folder):
    """Which parts answer without anything plugged in."""
    return spark.createDataFrame([("embedding_model", False), ("lexical_retrieval", True), ("reranker", False), ("template_writer", True), ("web_search", False)], "part string, available boolean")

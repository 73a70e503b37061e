"""Queries of small forms: addresses, scores, log lines, names, markup, checks of drafts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import filters as P
from marlstone.functions import links as L
from marlstone.functions import prompts as R
from marlstone.functions import text as T
from marlstone.operators.changes import latest
from marlstone.plans import sql as S
from marlstone.plans.prompts import _P, _prompts
from marlstone.plans.registry import register
from marlstone.sources.tables import read_table

#: Links as pages hold them, resolved against every page.
LINKS = ["/faq", "../guides/b.html#top", "c?x=1", "//cdn.example/d/", "#end", "./e/../f", "https://other.example/g/", ""]


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "null" if v is None else S.q(v) if isinstance(v, str) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as v({names})"


_SITE = "regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
_FOLDER = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(b, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[^/]*$', ''), ''), '/')"
_JOINED = {
    "/faq": f"{_SITE} || '/faq'", "../guides/b.html#top": f"{_SITE} || regexp_replace({_FOLDER}, '[^/]+/$', '') || 'guides/b.html'", "c?x=1": f"{_SITE} || {_FOLDER} || 'c?x=1'", "//cdn.example/d/": "regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*:') || '//cdn.example/d'",
    "#end": "regexp_replace(regexp_replace(b, '#.*$', ''), '/+$', '')", "./e/../f": f"{_SITE} || {_FOLDER} || 'f'", "https://other.example/g/": "'https://other.example/g'", "": "regexp_replace(regexp_replace(b, '#.*$', ''), '/+$', '')",
}


@register("relative_links", "with u as (select distinct source_url as b from au_blog_chunks where source_url is not null) " + " union all ".join(
    f"select b as page, {S.q(x)} as link, {y} as address from u" for x, y in _JOINED.items()))
def relative_links(spark, folder):
    """Every page's address with each of a few forms of link, resolved and canonical."""
    u = read_table(spark, folder, "au_blog_chunks").select(F.col("source_url").alias("page")).where("page is not null").distinct()
    each = u.select("page", F.explode(F.array(*map(F.lit, LINKS))).alias("link"))
    return each.withColumn("address", L.resolved(F.col("page"), F.col("link")))


@register("score_forms", """
select doc_id, cast(case when authority_score is null then 0 when authority_score <= 1 then round_even(authority_score * 100, 0) else round_even(authority_score, 0) end as bigint) as percent,
  case when authority_score is null then 0.0 when authority_score <= 1 then greatest(0.0, authority_score) else least(1.0, authority_score / 100) end as share from documents""")
def score_forms(spark, folder):
    s = F.col("authority_score")
    return read_table(spark, folder, "documents").select("doc_id", T.score_percent(s).alias("percent"), T.score_share(s).alias("share"))


@register("log_lines", f"""
select distinct id, case when length(x) <= 400 then x else substr(x, 1, 400) || ' ...[truncated]' end as line from (select id, {S.one_line("coalesce(draft, '')")} as x from resilience_report)""")
def log_lines(spark, folder):
    """Drafts as lines of a log: one line each, cut at 400 characters."""
    return read_table(spark, folder, "resilience_report").select("id", T.log_line(F.col("draft"), 400).alias("line")).distinct()


#: Messages of failures as services give them.
MESSAGES = ["429 Too Many Requests", "RESOURCE_EXHAUSTED: quota", "HTTP 403 Forbidden", "Read Timeout after 30 s", "401 unauthenticated", "all good", "", None]


@register("failure_signs", f"select message, {S.has('lower(message)', T.QUOTA)} as quota, {S.has('lower(message)', T.BLOCKING)} as blocking, case when message is not null then {S.case('lower(message)', T.ERROR_KINDS, 'invoke_error')} end as kind from {_values([(m,) for m in MESSAGES], 'message')}")
def failure_signs(spark, folder):
    m = spark.createDataFrame([(x,) for x in MESSAGES], "message string")
    c = F.col("message")
    return m.select("message", T.is_quota_error(c).alias("quota"), T.is_blocking_error(c).alias("blocking"), T.error_kind(c).alias("kind"))


@register("picture_addresses", f"""
select distinct doc_id, {S.q(L.PICTURES)} || replace(url_encode(concat_ws(' ', topic, title, 'editorial')), '%20', '+') || {S.q(L.PICTURE_SIZE)} as picture from documents where title is not null""")
def picture_addresses(spark, folder):
    d = read_table(spark, folder, "documents").where("title is not null")
    return d.select("doc_id", L.picture_of(F.col("topic"), F.col("title")).alias("picture")).distinct()


@register("table_names", "select distinct source as name, regexp_full_match(source, '[a-z][a-z0-9_]{0,62}') as plain from documents where source is not null")
def table_names(spark, folder):
    """Source names as they are written, and whether each could name a table."""
    return read_table(spark, folder, "documents").select(F.col("source").alias("name")).where("name is not null").distinct().withColumn("plain", L.is_table_name(F.col("name")))


@register("document_ids", """
select distinct chunk_id, coalesce(nullif(doc_id, ''), nullif(title, ''), nullif(replace(regexp_extract(source_url, '([^/\\\\]*)$', 1), '.txt', ''), ''), 'unknown') as name,
  coalesce(nullif(replace(regexp_extract(source_url, '([^/\\\\]*)$', 1), '.txt', ''), ''), 'unknown') as stem from validex_knowledge""")
def document_ids(spark, folder):
    """The id that names a chunk's document, and what its source alone would give."""
    k, none = read_table(spark, folder, "validex_knowledge"), F.lit(None).cast("string")
    url, unknown = F.col("source_url"), F.lit("unknown")
    return k.select("chunk_id", L.document_id(F.col("doc_id"), F.col("title"), url, unknown).alias("name"), L.document_id(none, none, url, unknown).alias("stem")).distinct()


#: Pages as they are fetched.
PAGES = [
    ("plain", "<html><body><h1>Checks</h1><p>One &amp; two&nbsp;three</p></body></html>"), ("script", "<p>a</p><script type='x'>var b = '<p>';</script><style>p { c: d }</style><p>e</p>"),
    ("furniture", "<nav><a href='/'>Home</a></nav><main>Body &lt;x&gt; &quot;y&quot; &#39;z&#39;</main><footer class='f'>End</footer>"), ("open", "<p>never closed <b>bold"), ("blank", " \n "), ("none", None),
]
_TEXT = "html"
for _t in ("script", "style"):
    _TEXT = S.sub(_TEXT, rf"(?is)<{_t}\b[^>]*>.*?</{_t}\s*>", " ")
for _t in ("nav", "header", "footer", "aside", "iframe"):
    _TEXT = S.sub(_TEXT, rf"(?is)<{_t}\b[^>]*>.*?</{_t}\s*>", " ")
_TEXT = S.sub(_TEXT, "(?s)<[^>]+>", " ")
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, {S.q(_a)}, {S.q(_b)})"
_TEXT = S.one_line(_TEXT)


@register("markup_text", f"select name, {_TEXT} as text, substr({_TEXT}, 1, 12) as clip from {_values(PAGES, 'name, html')}")
def markup_text(spark, folder):
    """Text of markup, whole and clipped."""
    d = spark.createDataFrame(PAGES, "name string, html string").withColumn("text", T.html_text(F.col("html")))
    return d.select("name", "text", F.substring("text", 1, 12).alias("clip"))


_INTRO = r"(?:^|\n)# [^\n]*\n"


@register("draft_intros", f"""
with d as (select distinct id, coalesce(draft, '') as draft from resilience_report), r as (select id, case when regexp_matches(draft, {S.q(_INTRO)}) then substr(draft, instr(draft, regexp_extract(draft, {S.q(_INTRO)})) + length(regexp_extract(draft, {S.q(_INTRO)}))) else '' end as rest from d)
select id, {S.one_line("string_split(chr(10) || rest, chr(10) || '## ')[1]")} as intro from r""")
def draft_intros(spark, folder):
    """What stands between a draft's title and its first section, on one line."""
    d = read_table(spark, folder, "resilience_report").select("id", F.coalesce("draft", F.lit("")).alias("draft")).distinct()
    return d.select("id", T.intro(F.col("draft")).alias("intro"))


#: Terms that drafts for applicants mustn't use, and the words that such a draft must have.
FORBIDDEN = ["onboarding", "hiring", "recruitment", "candidate", "talent acquisition", "employer"]
LEAST_DRAFT_WORDS = 500


@register("forbidden_terms", f"""
select distinct id, array_to_string(list_filter([{', '.join(map(S.q, FORBIDDEN))}], lambda x: contains(lower(coalesce(draft, '')), x)), ', ') as terms,
  len(regexp_extract_all(coalesce(draft, ''), '[\\p{{L}}\\p{{N}}_]+')) >= {LEAST_DRAFT_WORDS} as long_enough from resilience_report""")
def forbidden_terms(spark, folder):
    d = F.coalesce("draft", F.lit(""))
    terms = F.filter(F.array(*map(F.lit, FORBIDDEN)), lambda x: F.contains(F.lower(d), x))
    words = F.regexp_count(d, F.lit(r"[\p{L}\p{N}_]+"))
    return read_table(spark, folder, "resilience_report").select("id", F.array_join(terms, ", ").alias("terms"), (words >= LEAST_DRAFT_WORDS).alias("long_enough")).distinct()


_MATCHED = "[" + ", ".join(f"case when {S.has('prompt', '(?im)' + p.replace(chr(92) + 's', '[ \t\r\n]'))} then {i} end" for i, p in enumerate(P.INJECTIONS)) + "]"


@register("injection_matches", f"select prompt, array_to_string(list_filter({_MATCHED}, lambda x: x is not null)[1:3], ',') as patterns, len(list_filter({_MATCHED}, lambda x: x is not null)) as matches from {_P}")
def injection_matches(spark, folder):
    """Which patterns of injected instructions a prompt matches: the first three by number, and how many there are."""
    return _prompts(spark, folder).select("prompt", P.injections(F.col("prompt")).alias("m")).select(
        "prompt", F.array_join(F.slice("m", 1, 3), ",").alias("patterns"), F.size("m").cast("bigint").alias("matches"))


@register("picture_counts", f"select prompt, try_cast(nullif(regexp_extract(lower(prompt), {S.q(R.PICTURE_COUNT)}, 1), '') as bigint) as pictures from {_P}")
def picture_counts(spark, folder):
    """How many pictures a prompt names with a number, if it does."""
    return _prompts(spark, folder).select("prompt", R.picture_count(F.col("prompt")).alias("pictures"))


#: Answers of a parser as it words them.
PARSED = [
    (1, " Edit ", "the  Policy.", "Friendly Tone", " HR ", "LONG"), (2, "summary", " ", None, None, "huge"), (3, None, None, "", "", None), (4, "create", "Police check", "formal", "new  starters", "short"), (5, "Condense", "x", "a b\tc", "All", " Medium "),
]
_KIND = "replace(lower(" + S.one_line("coalesce(intent, '')") + "), ' ', '_')"


@register("parsed_forms", f"""
with v as (select *, case when {_KIND} in ({', '.join(map(S.q, R.INTENT_NAMES['rewrite']))}) then 'rewrite' when {_KIND} in ({', '.join(map(S.q, R.INTENT_NAMES['shorten']))}) then 'shorten' else 'create_blog' end as kind from {_values(PARSED, 'n, intent, topic, tone, audience, length')})
select n::bigint as n, kind as intent, case when {S.bare(S.one_line("coalesce(topic, '')"))} <> '' then {S.bare(S.one_line("coalesce(topic, '')"))} when kind in ('rewrite', 'shorten') then 'current draft' else 'general topic' end as topic,
  coalesce(nullif(replace(lower({S.one_line("coalesce(tone, '')")}), ' ', '_'), ''), 'clear_professional') as tone, coalesce(nullif(lower({S.one_line("coalesce(audience, '')")}), ''), 'general audience') as audience,
  case when lower({S.strip("coalesce(length, '')")}) in ('short', 'medium', 'long') then lower({S.strip("coalesce(length, '')")}) else 'medium' end as length from v""")
def parsed_forms(spark, folder):
    """A parser's answers in their domains, with defaults for what is missing or out of them."""
    d = spark.createDataFrame(PARSED, "n bigint, intent string, topic string, tone string, audience string, length string")
    kind = R.intent_of_name(F.col("intent"))
    return d.select("n", kind.alias("intent"), R.topic_of_name(F.col("topic"), kind).alias("topic"), R.tone_of_name(F.col("tone")).alias("tone"), R.audience_of_name(F.col("audience")).alias("audience"), R.length_of_name(F.col("length")).alias("length"))


_TURNS = "(select session_id, turn_no, t.user_prompt as prompt, t.parsed_intent as intent, t.parsed_topic as topic, t.generated_draft as draft from (select session_id, unnest(turns) as t, unnest(range(0, len(turns))) as turn_no from (select * exclude (_r) from (select *, row_number() over (partition by session_id order by updated_at desc) as _r from chat_sessions) where _r = 1)) where t is not null)"


@register("continued_prompts", f"""
with p as (select *, lag(draft) over w as before_draft, lag(topic) over w as before_topic, first_value(topic) over w as first_topic from {_TURNS} window w as (partition by session_id order by turn_no rows between unbounded preceding and current row)),
c as (select *, coalesce(before_draft, '') <> '' as continues from p)
select session_id, turn_no::bigint as turn_no, continues, case when continues and coalesce(intent, 'create_blog') = 'create_blog' then 'rewrite' else coalesce(intent, 'create_blog') end as intent,
  case when continues and coalesce(topic, '') in ('', 'current draft') then coalesce(nullif(first_topic, ''), before_topic, topic)
       when not continues and (topic = 'current draft' or intent in ('rewrite', 'shorten')) and coalesce(before_topic, '') <> '' then before_topic else topic end as topic,
  case when continues and {S.strip("string_split(coalesce(prompt, ''), chr(10))[1]")} <> '' then 'USER EDIT REQUEST: ' || {S.strip("string_split(coalesce(prompt, ''), chr(10))[1]")} end as instruction from c""")
def continued_prompts(spark, folder):
    """Turns that go on from an earlier draft: they keep its topic, become rewrites and carry the request's first line. A session has few turns."""
    s = latest(read_table(spark, folder, "chat_sessions"), "session_id", F.struct("updated_at"), ["session_id", "turns"])
    t = s.select("session_id", F.posexplode("turns").alias("n", "t")).where("t is not null").select(
        "session_id", F.col("n").cast("bigint").alias("turn_no"), F.col("t.user_prompt").alias("prompt"), F.col("t.parsed_intent").alias("intent"), F.col("t.parsed_topic").alias("topic"), F.col("t.generated_draft").alias("draft"))
    w = W.partitionBy("session_id").orderBy("turn_no")
    p = t.withColumns({"b_draft": F.lag("draft").over(w), "b_topic": F.lag("topic").over(w), "f_topic": F.first("topic").over(w)})
    p = p.withColumn("continues", F.coalesce("b_draft", F.lit("")) != "")
    intent, line = F.coalesce("intent", F.lit("create_blog")), T.strip(F.split_part(F.coalesce("prompt", F.lit("")), F.lit("\n"), F.lit(1)))
    refers = (F.col("topic") == "current draft") | F.col("intent").isin("rewrite", "shorten")
    topic = (
        F.when(F.col("continues") & F.coalesce("topic", F.lit("")).isin("", "current draft"), F.coalesce(F.when(F.col("f_topic") != "", F.col("f_topic")), "b_topic", "topic"))
        .when(~F.col("continues") & refers & (F.coalesce("b_topic", F.lit("")) != ""), F.col("b_topic")).otherwise(F.col("topic"))
    )
    return p.select(
        "session_id", "turn_no", "continues", F.when(F.col("continues") & (intent == "create_blog"), "rewrite").otherwise(intent).alias("intent"), topic.alias("topic"),
        F.when(F.col("continues") & (line != ""), F.concat(F.lit("USER EDIT REQUEST: "), line)).alias("instruction"))


#: Lines of an event stream.
STREAM = [(1, "event: thinking"), (2, 'data: {"step": 1}'), (3, ""), (4, "event: meta"), (5, 'data: {"k": 2}'), (6, ""), (7, ": note"), (8, "data: alone"), (9, ""), (10, "event: done"), (11, "data: {}")]


@register("stream_frames", f"""
with v as (select n, line, count(*) filter (line = '') over (order by n rows between unbounded preceding and 1 preceding) as frame from {_values(STREAM, 'n, line')})
select frame::bigint as frame, coalesce(max(trim(substr(line, 7))) filter (line like 'event:%'), 'message') as event, string_agg(trim(substr(line, 6)), chr(10) order by n) filter (line like 'data:%') as data from v where line like 'event:%' or line like 'data:%' group by frame""")
def stream_frames(spark, folder):
    """Lines of an event stream, paired frame by frame; a blank line ends a frame. (One stream: its order is its own.)"""
    s = spark.createDataFrame([("s", *x) for x in STREAM], "stream string, n int, line string")
    frame = F.sum((F.col("line") == "").cast("bigint")).over(W.partitionBy("stream").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    v = s.withColumn("frame", F.coalesce(frame, F.lit(0))).where("line like 'event:%' or line like 'data:%'")
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith("data:"), F.struct("n", F.trim(F.expr("substr(line, 6)")).alias("d"))))), lambda x: x["d"]), "\n")
    return v.groupBy("frame").agg(F.coalesce(F.max(F.when(F.col("line").startswith("event:"), F.trim(F.expr("substr(line, 7)")))), F.lit("message")).alias("event"), data.alias("data"))

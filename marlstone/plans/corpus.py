"""Queries over the corpus: text forms, filters, windows of text, profiles of addresses, exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.functions import filters as P
from marlstone.functions import text as T
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.session import spread
from marlstone.sources.tables import read_table as _read

WINDOW, OVERLAP = 1800, 220


def read_table(spark, folder, name):
    """These queries work on texts, so a table in one file is spread over the cores first."""
    return spread(_read(spark, folder, name))


def _draft(spark, folder):
    return read_table(spark, folder, "resilience_report").select("id", F.coalesce("draft", F.lit("")).alias("draft"), "name", "prompt", "error", "run_at").distinct()


_DRAFT = "(select distinct id, coalesce(draft, '') as draft, name, prompt, error, run_at from resilience_report)"


@register("text_forms", f"""
select doc_id, md5({S.one_line('text')}) as one_line, md5({S.normal('text')}) as normal,
  md5({S.strip("regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) as cleaned,
  case when length({S.one_line('text')}) <= 180 then {S.one_line('text')}
    when trim(regexp_replace(substr({S.one_line('text')}, 1, 180), ' [^ ]*$', '')) = '' then substr({S.one_line('text')}, 1, 180)
    else trim(regexp_replace(substr({S.one_line('text')}, 1, 180), ' [^ ]*$', '')) || '...' end as clipped
from documents""")
def text_forms(spark, folder):
    t = F.col("text")
    return read_table(spark, folder, "documents").select("doc_id", F.md5(T.one_line(t)).alias("one_line"), F.md5(T.normal(t)).alias("normal"), F.md5(T.cleaned(t)).alias("cleaned"), T.clipped(t).alias("clipped"))


@register("token_counts", f"""
select doc_id, len({S.tokens('text')}) as tokens, len(list_distinct({S.tokens('text')})) as distinct_tokens,
  cast(ceil(length({S.one_line('text')}) / 4.0) as bigint) as estimate from documents""")
def token_counts(spark, folder):
    t = F.col("text")
    return read_table(spark, folder, "documents").select(
        "doc_id", F.when(t.isNotNull(), F.size(T.tokens(t))).cast("bigint").alias("tokens"), F.when(t.isNotNull(), F.size(F.array_distinct(T.tokens(t)))).cast("bigint").alias("distinct_tokens"), T.token_estimate(t).alias("estimate"))


_PARTS = "list_filter(string_split(replace(file_stem, '-', '_'), '_'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+'))"


@register("stem_titles", f"""
select doc_id, coalesce(nullif(array_to_string(list_transform({_PARTS}, lambda x: upper(x[1]) || lower(x[2:])), ' '), ''), case when file_stem is not null then 'Untitled' end) as title,
  coalesce(nullif(lower(array_to_string({_PARTS}[1:4], ' ')), ''), case when file_stem is not null then 'general' end) as topic from documents""")
def stem_titles(spark, folder):
    s = F.col("file_stem")
    return read_table(spark, folder, "documents").select("doc_id", F.when(s.isNotNull(), T.title_of_stem(s)).alias("title"), F.when(s.isNotNull(), T.topic_of_stem(s)).alias("topic"))


_HOST = r"lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_PATH = r"regexp_replace(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g')"


@register("url_profile", f"""
select distinct source_url, {S.case('lower(source_url)', T.URL_TOPICS, 'compliance')} as topic, {S.case('lower(source_url)', T.URL_KINDS, 'webpage')} as kind,
  regexp_replace({S.strip("regexp_replace(source_url, '#.*$', '')")}, '/+$', '') as canonical, {_HOST} as host, regexp_replace({_HOST}, '^www\\.', '') as domain,
  case when {_PATH} <> '' then {_PATH} else {_HOST} end as title
from au_blog_chunks where source_url is not null""")
def url_profile(spark, folder):
    u = F.col("source_url")
    return read_table(spark, folder, "au_blog_chunks").select("source_url").where(u.isNotNull()).distinct().select(
        "source_url", T.url_topic(u).alias("topic"), T.url_kind(u).alias("kind"), T.canonical_url(u).alias("canonical"), T.host(u).alias("host"), T.without_www(T.host(u)).alias("domain"), T.title_of_url(u).alias("title"))


@register("fixed_windows", f"""
with d as (select doc_id, text, length(text) as n from documents where text is not null),
w as (select doc_id, text, unnest(generate_series(0, case when n <= {WINDOW} then 0 else cast(ceil((n - {OVERLAP}) / {WINDOW - OVERLAP}.0) as bigint) - 1 end)) as i from d),
p as (select doc_id, i, {S.strip(f"substr(text, i * {WINDOW - OVERLAP} + 1, {WINDOW})")} as piece from w)
select doc_id, i + 1 as window_no, length(piece) as chars, sha1(piece) as digest, substr(sha1(concat_ws(':', cast(doc_id as varchar), cast(i + 1 as varchar), substr(piece, 1, 120))), 1, 16) as chunk_key
from p where piece <> ''""")
def fixed_windows(spark, folder):
    """Windows of fixed size and overlap in closed form, with their content hash and key."""
    d = read_table(spark, folder, "documents").select("doc_id", "text", F.length("text").alias("n")).where("text is not null")
    step = WINDOW - OVERLAP
    last = F.when(F.col("n") <= WINDOW, 0).otherwise(F.ceil((F.col("n") - OVERLAP) / step) - 1).cast("bigint")
    w = d.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    p = w.select("doc_id", "i", T.strip(F.substring(F.col("text"), (F.col("i") * step + 1).cast("int"), F.lit(WINDOW))).alias("piece")).where("piece <> ''")
    no = (F.col("i") + 1).alias("window_no")
    key = F.substring(F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("i") + 1).cast("string"), F.substring("piece", 1, 120))), 1, 16)
    return p.select("doc_id", no, F.length("piece").cast("bigint").alias("chars"), F.sha1("piece").alias("digest"), key.alias("chunk_key"))


_HITS = " + ".join(f"cast({S.has('lower(text)', f'(^|[^a-z0-9]){k}($|[^a-z0-9])')} as bigint)" for k in P.KEYWORDS)
_COUNT = "len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''\\-]*'))"


@register("quality_chunks", f"""
select chunk_id, {_COUNT} as words, {_HITS} as hits, {_COUNT} >= 28 and ({_HITS}) >= 2 as kept
from (select distinct chunk_id, text from au_blog_chunks where text is not null)""")
def quality_chunks(spark, folder):
    d = read_table(spark, folder, "au_blog_chunks").select("chunk_id", "text").where("text is not null").distinct()
    counted = d.select("chunk_id", P.word_count(F.col("text")).alias("words"), P.keyword_hits(F.col("text")).alias("hits"))
    return counted.withColumn("kept", (F.col("words") >= 28) & (F.col("hits") >= 2))


@register("quality_summary", f"""
select source_type, count(*) as chunks, count(*) filter ({_COUNT} >= 28 and ({_HITS}) >= 2) as kept, count(*) filter (not ({_COUNT} >= 28 and ({_HITS}) >= 2)) as rejected,
  count(distinct source_url) as sources
from (select distinct chunk_id, source_type, source_url, text from au_blog_chunks where text is not null) group by source_type""")
def quality_summary(spark, folder):
    """Counters of one ingestion run."""
    d = read_table(spark, folder, "au_blog_chunks").select("chunk_id", "source_type", "source_url", "text").where("text is not null").distinct()
    k = d.withColumn("kept", P.is_quality(F.col("text")))
    return k.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.countDistinct("source_url").alias("sources"))


_UP, _LOW = "length(regexp_replace(line, '[^A-Z]', '', 'g'))", "length(regexp_replace(line, '[^a-z]', '', 'g'))"
_SEMANTIC = f"(len(list_filter(regexp_split_to_array(line, '[.!?]+'), lambda x: {S.strip('x')} <> '')) >= 2 and not {S.has('line', '[-*_=#]{4,}')} and {_LOW} > 0 and {_UP} <= 0.45 * ({_UP} + {_LOW}))"


@register("line_checks", f"""
with l as (select chunk_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from (select distinct chunk_id, text from au_blog_chunks where text is not null))
select chunk_id, line_no, case when {S.has('lower(line)', '|'.join(P.NOISE))} then 'noise_phrase' when not {_SEMANTIC} then 'semantic_paragraph' else 'kept' end as stage
from l where {S.strip('line')} <> ''""")
def line_checks(spark, folder):
    """Each non-blank line kept, or the first check that rejects it."""
    d = read_table(spark, folder, "au_blog_chunks").select("chunk_id", "text").where("text is not null").distinct()
    lines = d.select("chunk_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(T.strip(F.col("line")) != "")
    stage = F.when(P.has_noise(F.col("line")), "noise_phrase").when(~P.is_semantic(F.col("line")), "semantic_paragraph").otherwise("kept")
    return lines.select("chunk_id", F.col("line_no").cast("bigint").alias("line_no"), stage.alias("stage"))


_EW = "regexp_extract_all(lower(text), '[a-z][a-z''\\-]*')"
_EN = f"len(list_filter({_EW}, lambda w: w in ({', '.join(map(S.q, P.ENGLISH))})))"
_VI = f"len(list_filter({_EW}, lambda w: w in ({', '.join(map(S.q, P.ROMANISED))})))"


@register("language_heuristic", f"""
select lower(substr(lang, 1, 2)) as lang, not {S.has('lower(text)', P.ACCENTED)} and len({_EW}) >= 6 and {_EN} >= 1 and not ({_VI} >= 2 and {_EN} <= 1) as english, count(*) as documents
from documents where text is not null group by 1, 2""")
def language_heuristic(spark, folder):
    d = read_table(spark, folder, "documents").where("text is not null")
    return d.groupBy(F.lower(F.substring("lang", 1, 2)).alias("lang"), P.looks_english(F.col("text")).alias("english")).agg(F.count(F.lit(1)).alias("documents"))


_CLIP = f"case when length({S.one_line('content')}) <= 180 then {S.one_line('content')} else trim(regexp_replace(substr({S.one_line('content')}, 1, 180), ' [^ ]*$', '')) || '...' end"
_DATED = S.q(P.DATED + r"[ \t]*")
_GARBAGE = (
    f"({S.has('lower(s)', '|'.join(P.NO_EVIDENCE))} or ({S.strip('s')} like '%...' and len({S.words('s')}) < 15) or ({S.has('s', P.DATED)} and len({S.words(f"regexp_replace(s, {_DATED}, '')")}) < 10) or len({S.words('s')}) < 8)"
)


@register("supporting_facts", f"""
with c as (select chunk_id, topic, {_CLIP} as s from {S.latest('validex_knowledge', 'chunk_id', 'created_at desc, chunk_hash')} where content is not null),
e as (select chunk_id, topic, s, {_EW.replace('text', 's')} as w from c),
k as (select chunk_id, topic, {S.strip(f"regexp_replace({S.strip(f"regexp_replace(s, {_DATED}, '')")}, '\\.\\.\\.$', '.')")} as fact from e
  where not {S.has('lower(s)', P.ACCENTED)} and len(w) >= 6 and {_EN.replace(_EW, 'w')} >= 1 and not ({_VI.replace(_EW, 'w')} >= 2 and {_EN.replace(_EW, 'w')} <= 1) and not {_GARBAGE}),
f as (select topic, fact, min(chunk_id) as chunk_id from k group by topic, fact)
select topic, fact, chunk_id, rank from (select *, row_number() over (partition by topic order by chunk_id, fact) as rank from f) where rank <= 6""")
def supporting_facts(spark, folder):
    """Up to six distinct usable snippets for each topic, in order of their chunk."""
    from marlstone.operators.changes import latest

    own = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct(F.col("created_at")), ["chunk_id", "topic", "content"]).where("content is not null")
    usable = F.filter(F.array(T.clipped(F.col("content"))), lambda x: P.looks_english(x) & ~P.is_garbage(x))
    s = own.select("chunk_id", "topic", F.explode(usable).alias("s"))
    first = s.select("chunk_id", "topic", P.as_evidence(F.col("s")).alias("fact")).groupBy("topic", "fact").agg(F.min("chunk_id").alias("chunk_id"))
    w = W.partitionBy("topic").orderBy("chunk_id", "fact")
    return first.withColumn("rank", F.row_number().over(w)).where("rank <= 6").withColumn("rank", F.col("rank").cast("bigint"))


@register("draft_shape", f"""
select distinct id, len({S.words('draft')}) as words, len(regexp_extract_all(draft, '(?m)^## ')) as headings, len(regexp_extract_all(draft, '!\\[')) as images, len(regexp_extract_all(draft, '(?m)^- ')) as items,
  len({S.words('draft')}) >= 700 as long_enough, {S.has('draft', '(?m)^## *(Conclusion|Closing)')} as concludes, len(regexp_extract_all(draft, '(?m)^## ')) > 0 or len({S.words('draft')}) >= 120 as shaped
from {_DRAFT}""")
def draft_shape(spark, folder):
    d = _draft(spark, folder).select("id", "draft", P.shape_of_draft(F.col("draft")).alias("s")).select("id", "draft", "s.*")
    return d.select(
        "id", "words", "headings", "images", "items", (F.col("words") >= 700).alias("long_enough"), F.col("draft").rlike("(?m)^## *(Conclusion|Closing)").alias("concludes"),
        ((F.col("headings") > 0) | (F.col("words") >= 120)).alias("shaped")).distinct()


@register("export_lines", f"""
with l as (select id, unnest(string_split(draft, chr(10))) as line, unnest(range(1, len(string_split(draft, chr(10))) + 1)) as line_no from (select distinct id, draft from {_DRAFT}))
select id, line_no, case when line like '### %' then 3 when line like '## %' then 2 when line like '# %' then 1 else 0 end as level, {S.strip("regexp_replace(line, '^#{1,3} ', '')")} as content
from l where {S.strip('line')} <> ''""")
def export_lines(spark, folder):
    d = _draft(spark, folder).select("id", "draft").distinct().select("id", F.posexplode(F.split("draft", "\n")).alias("n", "line")).where(T.strip(F.col("line")) != "")
    return d.select("id", (F.col("n") + 1).cast("bigint").alias("line_no"), T.line_kind(F.col("line")).alias("level"), T.strip(F.regexp_replace("line", "^#{1,3} ", "")).alias("content"))


_NOMD = S.one_line(S.sub(S.sub(S.sub('draft', r'!\[[^\]]*\]\([^)]*\)', ' '), r'\[([^\]]+)\]\([^)]*\)', r'\1'), '[#>*_`~]', ' '))


@register("meta_descriptions", f"""
select distinct id, coalesce(regexp_replace(substr(case when length({S.one_line('name')}) >= 60 then {S.one_line('name')} when length({_NOMD}) >= 60 then {_NOMD} end, 1, 160), '[ .]+$', ''),
  case when {S.one_line('name')} <> '' then {S.one_line('name')} end, 'Article') as description from {_DRAFT}""")
def meta_descriptions(spark, folder):
    return _draft(spark, folder).select("id", T.meta_description(F.col("name"), F.col("draft")).alias("description")).distinct()


@register("sentence_dedup", f"""
with b as (select id, unnest(regexp_split_to_array(draft, '\\n\\n+')) as body, unnest(range(0, len(regexp_split_to_array(draft, '\\n\\n+')))) as sec from (select distinct id, draft from {_DRAFT})),
m as (select id, sec, string_split(regexp_replace(body, '([.!?])[ \\n]+', '\\1' || chr(1), 'g'), chr(1)) as ss from b),
s as (select id, sec, unnest(ss) as sentence, unnest(range(0, len(ss))) as pos from m),
n as (select *, {S.normal('sentence')} as k from s),
r as (select *, row_number() over (partition by id, k order by sec, pos) as seen from n)
select id, sec, string_agg(sentence, ' ' order by pos) filter (length(k) < 25 or seen = 1) as body from r group by id, sec having count(*) filter (length(k) < 25 or seen = 1) > 0""")
def sentence_dedup(spark, folder):
    """Sections of each draft without the sentences of 25 characters or more that an earlier section has."""
    d = _draft(spark, folder).select("id", "draft").distinct()
    b = d.select("id", F.posexplode(F.split("draft", "\n\n+")).alias("sec", "body"))
    s = b.select("id", "sec", F.posexplode(F.split(F.regexp_replace("body", "([.!?])[ \n]+", "$1\x01"), "\x01")).alias("pos", "sentence")).withColumn("k", T.normal(F.col("sentence")))
    seen = F.row_number().over(W.partitionBy("id", "k").orderBy("sec", "pos"))
    kept = s.withColumn("seen", seen).where((F.length("k") < 25) | (F.col("seen") == 1))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")
    return kept.groupBy("id", F.col("sec").cast("bigint").alias("sec")).agg(joined.alias("body"))


@register("markdown_sections", r"""
with d as (select distinct id, draft from (select distinct id, coalesce(draft, '') as draft from resilience_report)),
p as (select id, string_split(regexp_replace(chr(10) || draft, '\n[ \t]*##[ \t]+', chr(1), 'g'), chr(1)) as parts from d),
s as (select id, unnest(parts[2:]) as part, unnest(range(1, len(parts))) as n from p),
x as (select id, n, trim(string_split(part, chr(10))[1]) as heading, regexp_replace(regexp_replace(part, '^[^\n]*', ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') as body from s)
select id, n as section_no, heading, length(body) as chars, sha1(body) as digest, regexp_extract(body, '!\[[^\]]*\]\(([^)]+)\)', 1) as image from x where heading <> '' and body <> ''""")
def markdown_sections(spark, folder):
    d = _draft(spark, folder).select("id", "draft").distinct()
    parts = F.split(F.regexp_replace(F.concat(F.lit("\n"), F.col("draft")), "\n[ \t]*##[ \t]+", "\x01"), "\x01")
    s = d.select("id", F.posexplode(parts).alias("n", "part")).where("n > 0")
    x = s.select("id", "n", F.trim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("heading"), F.regexp_replace(F.regexp_replace("part", "^[^\n]*", ""), "^[ \t\n\r]+|[ \t\n\r]+$", "").alias("body"))
    return x.where("heading <> '' and body <> ''").select(
        "id", F.col("n").cast("bigint").alias("section_no"), "heading", F.length("body").cast("bigint").alias("chars"), F.sha1("body").alias("digest"), F.regexp_extract("body", r"!\[[^\]]*\]\(([^)]+)\)", 1).alias("image"))


@register("reference_lines", f"""
select chunk_id, coalesce(nullif({S.strip("coalesce(title, '')")}, ''), doc_id) || ' | URL: ' || coalesce(nullif({S.strip("coalesce(source_url, '')")}, ''), 'khong_co') as reference,
  replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html_title,
  '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::double)), ',') || ']' as vector
from {S.latest('validex_knowledge', 'chunk_id', 'created_at desc, chunk_hash')}""")
def reference_lines(spark, folder):
    from marlstone.operators.changes import latest

    own = latest(read_table(spark, folder, "validex_knowledge"), "chunk_id", F.struct(F.col("created_at")), ["chunk_id", "title", "doc_id", "source_url", "embedding"])
    return own.select("chunk_id", T.reference_line(F.col("title"), F.col("doc_id"), F.col("source_url")).alias("reference"), T.html_escaped(F.coalesce("title", F.lit(""))).alias("html_title"), T.vector_literal(F.col("embedding")).alias("vector"))

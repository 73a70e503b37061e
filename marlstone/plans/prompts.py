"""Queries over prompts: what they ask for, and whether they are safe to run."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import filters as P
from marlstone.functions import prompts as R
from marlstone.functions import text as T
from marlstone.functions.text import AFTER, BEFORE, WS
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.session import spread
from marlstone.sources.tables import read_table


def _prompts(spark, folder):
    chat = read_table(spark, folder, "chat_sessions").select("session_id", F.posexplode("turns").alias("n", "t")).select(F.col("t.user_prompt").alias("prompt"))
    return spread(chat.unionAll(read_table(spark, folder, "resilience_report").select("prompt"))).where("prompt is not null").distinct()


_P = "(select distinct prompt from (select unnest(turns).user_prompt as prompt from chat_sessions union all select prompt from resilience_report) where prompt is not null)"
_LOW = "lower(prompt)"
_GAP = r"(?:.*[^\p{L}\p{N}_])?"


def _any(words: list[str]) -> str:
    return S.has(_LOW, "|".join(words))


_INTENT = f"""case when {S.whole(_LOW, '|'.join(R.EDITS))} or {S.has(_LOW, f'{BEFORE}{R.IMAGE_VERBS}{AFTER}{_GAP}{R.IMAGES}{AFTER}')} or {S.has(_LOW, f'{BEFORE}{R.IMAGES}{AFTER}{_GAP}{R.IMAGE_VERBS}{AFTER}')}
  or {S.has(_LOW, f'{BEFORE}{R.IMAGE_VERBS_VI}{AFTER}{_GAP}(?:anh|ảnh|hinh|hình){AFTER}')} or {_any(R.REWRITES)} then 'rewrite' when {_any(R.SHORTENS)} then 'shorten' else 'create_blog' end"""
_N = f"try_cast(replace(regexp_extract({_LOW}, {S.q(f'{BEFORE}([0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]{{3,4}}){WS}*(?:chu|tu|words?){AFTER}')}, 1), ',', '') as bigint)"
_LENGTH = f"case when {_N} <= 500 then 'short' when {_N} <= 1000 then 'medium' when {_N} > 1000 then 'long' when {S.has(_LOW, R.SHORT)} then 'short' when {S.has(_LOW, R.LONG)} then 'long' else 'medium' end"
_AUDIENCE = f"""coalesce(nullif({S.bare(f"regexp_extract({_LOW}, {S.q(f'target_audience{WS}*:{WS}*([^{chr(13)}{chr(10)}]+)')}, 1)")}, ''),
  case {' '.join(f"when contains({_LOW}, {S.q(a)}) then {S.q(a)}" for a in R.AUDIENCES)} end,
  nullif({S.strip(f"regexp_extract({_LOW}, {S.q(f'for{WS}+([a-z{chr(92)}- {chr(9)}{chr(13)}{chr(10)}]{{3,40}})')}, 1)")}, ''), 'general audience')"""


def _marked(m: str) -> str:
    t = S.bare(f"regexp_extract(prompt, {S.q(f'(?i){BEFORE}{m}{WS}+([^{chr(13)}{chr(10)}]+)')}, 1)")
    return f"case when {S.has(f'lower({t})', R.PRONOUNS)} then 'current draft' else nullif({t}, '') end"


_LINE = f"trim(regexp_extract(regexp_replace(prompt, {S.q(f'^{WS}+')}, ''), {S.q(f'^([^{chr(13)}{chr(10)}]*)')}, 1))"
_SHORT = S.bare(
    f"regexp_replace(regexp_replace({_LINE}, {S.q(f'(?i)^(write|create|generate|draft|viet|viết|soan|soạn){WS}+')}, ''), {S.q(f'(?i)^(a{WS}+|an{WS}+)?(blog|article|post|bai{WS}+blog|bài{WS}+blog){WS}+')}, '')"
)
_RAW = f"""coalesce({', '.join(_marked(m) for m in R.MARKERS)}, case when ({_INTENT}) in ('shorten', 'rewrite') then 'current draft' end,
  case when length({_SHORT}) >= 2 then {_SHORT} when length({S.bare(_LINE)}) >= 2 then {S.bare(_LINE)} end, 'current draft')"""
_TONE_END = S.q(f"(?i),?{WS}*in{WS}+(a{WS}+)?(clear|professional|friendly|casual)[\\p{{L}}\\p{{N}}_ \t\r\n\\-]*tone\\.?$")
_FOR_END = S.q(f"(?i){WS}+for{WS}+({'|'.join(R.AUDIENCES)})\\.?$")
_TOPIC = f"coalesce(nullif({S.bare(f'regexp_replace(regexp_replace(raw0, {_TONE_END}, {chr(39) * 2}), {_FOR_END}, {chr(39) * 2})')}, ''), 'current draft')"


@register("prompt_parse", f"""
with r as (select prompt, {_INTENT} as intent, {S.case(_LOW, R.TONES, 'clear_professional')} as tone, {_LENGTH} as length, {_AUDIENCE} as audience, {S.bare(_RAW)} as raw0 from {_P})
select prompt, intent, tone, length, audience, {_TOPIC} as topic from r""")
def prompt_parse(spark, folder):
    p = F.col("prompt")
    return _prompts(spark, folder).select("prompt", R.intent(p).alias("intent"), R.tone(p).alias("tone"), R.length(p).alias("length"), R.audience(p).alias("audience"), R.topic(p).alias("topic"))


_URLS = "regexp_extract_all(prompt, '(?i)https?://[^\t-\r ,\"''<>]+')"
_IMAGE = S.q(R._IMAGE)
_ONE = f"lower({S.one_line('prompt')})"
_NUMBER = f"([0-9]+|{'|'.join(R.NUMBERS)})"
_KEPT = f"regexp_extract({_ONE}, {S.q(f'{BEFORE}(?:keep|show|use|retain|limit(?:ed)? to|only|chi|chỉ|giu|giữ) (?:only )?{_NUMBER} {R.IMAGES_ALL}{AFTER}')}, 1)"
_SAID = f"coalesce(nullif({_KEPT}, ''), regexp_extract({_ONE}, {S.q(f'{BEFORE}{_NUMBER} {R.IMAGES_ALL}{AFTER}')}, 1))"
_NONE = " or ".join(S.has(_ONE, f"{BEFORE}{p} {R.IMAGES_ALL}{AFTER}".replace("  ", " ")) for p in ("(?:no|without)(?: any)?", "(?:khong|không)(?: co)?", "(?:remove|delete|drop)(?: all)?", "(?:xoa|xóa|bo|bỏ)(?: het| toan bo| tat ca)?"))


@register("prompt_modifiers", f"""
select prompt, array_to_string(list_filter({_URLS}, lambda u: not regexp_matches(u, {_IMAGE})), ' ') as web_urls, array_to_string(list_filter({_URLS}, lambda u: regexp_matches(u, {_IMAGE})), ' ') as image_urls,
  case when {_NONE} then 0 {' '.join(f"when {_SAID} = {S.q(w)} then {n}" for w, n in R.NUMBERS.items())} else try_cast({_SAID} as bigint) end as image_limit from {_P}""")
def prompt_modifiers(spark, folder):
    p = F.col("prompt")
    return _prompts(spark, folder).select("prompt", F.array_join(R.web_urls(p), " ").alias("web_urls"), F.array_join(R.image_urls(p), " ").alias("image_urls"), R.image_limit(p).alias("image_limit"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_C = S.sub(S.sub(S.sub("s", _CTRL, ""), "[ \t]{10,}", "  "), "\n{4,}", "\n\n\n")
_ATTACK = " or ".join(S.has("c", "(?im)" + p.replace(r"\s", "[ \t\r\n]")) for p in P.INJECTIONS)


@register("prompt_guard", f"""
with s as (select prompt, {S.strip('prompt')} as s from {_P}), c as (select *, {_C} as c from s),
r as (select *, case when s = '' then 'empty' when length(s) > {P.MOST_PROMPT} then 'too_long' when {_ATTACK} then 'unsafe' when {S.strip('c')} = '' then 'empty_after_cleaning' else '' end as reason from c)
select prompt, reason = '' as valid, reason, case when s = '' then '' when length(s) > {P.MOST_PROMPT} then substr(s, 1, {P.MOST_PROMPT}) when {S.strip('c')} = '' then '' else c end as cleaned,
  case when reason in ('empty', 'too_long') then 0 else len(regexp_extract_all(s, {S.q(_CTRL)})) end as removed from r""")
def prompt_guard(spark, folder):
    return _prompts(spark, folder).select("prompt", P.guarded_prompt(F.col("prompt")).alias("g")).select("prompt", "g.*")


@register("topic_labels", f"""
with t as (select distinct parsed_topic as topic, parsed_intent as intent from (select unnest(turns).parsed_topic as parsed_topic, unnest(turns).parsed_intent as parsed_intent from chat_sessions) where parsed_topic is not null)
select topic, intent, case {' '.join(f"when {S.normal('topic')} = {S.q(k)} then {S.q(v)}" for k, v in T.AUDIENCES.items())}
  else array_to_string(list_transform(string_split({S.normal('topic')}, ' '), lambda w: case when w = 'hr' then 'HR' else upper(w[1]) || w[2:] end), ' ') end as label,
  substr(sha256(concat_ws('|', lower(trim(topic)), intent, 'medium')), 1, 24) as cache_key from t""")
def topic_labels(spark, folder):
    t = read_table(spark, folder, "chat_sessions").select(F.explode("turns").alias("t")).select(F.col("t.parsed_topic").alias("topic"), F.col("t.parsed_intent").alias("intent")).where("topic is not null").distinct()
    return t.select("topic", "intent", T.audience_label(F.col("topic")).alias("label"), T.cache_key(F.col("topic"), F.col("intent"), F.lit("medium")).alias("cache_key"))


@register("error_classes", f"""
select {S.case('lower(error)', T.ERROR_KINDS, 'invoke_error')} as kind, count(*) as failures, count(distinct id) as reports from resilience_report where error is not null group by 1""")
def error_classes(spark, folder):
    d = read_table(spark, folder, "resilience_report").where("error is not null")
    return d.groupBy(T.error_kind(F.col("error")).alias("kind")).agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("id").alias("reports"))


@register("title_forms", f"""
with b as (select doc_id, file_stem, regexp_replace({S.one_line("coalesce(title, '')")}, '^[ .,!?:;]+|[ .,!?:;]+$', '', 'g') as t from documents), w as (select *, string_split(t, ' ')[1:{T.MOST_TITLE_WORDS}] as ws from b)
select doc_id, case when lower(t) in ('', 'current draft') then 'Current Draft Update' else array_to_string(list_transform(ws, lambda x, i: case when i > 1 and i < len(ws) and lower(x) in ({', '.join(map(S.q, T.SMALL))}) then lower(x) else upper(x[1]) || lower(x[2:]) end), ' ') end as title,
  case when file_stem is not null then {S.case('lower(file_stem)', T.STEM_TOPICS, 'compliance')} end as topic from w""")
def title_forms(spark, folder):
    return read_table(spark, folder, "documents").select("doc_id", T.title_case(F.col("title")).alias("title"), T.filename_topic(F.col("file_stem")).alias("topic"))


def _in(k: str) -> str:
    return ", ".join(map(S.q, R.INTENT_NAMES[k]))


_NAME = "replace(lower(trim(coalesce(intent, ''))), ' ', '_')"


@register("request_forms", f"""
with t as (select distinct unnest(turns).parsed_intent as intent, unnest(turns).parsed_topic as topic, unnest(turns).user_prompt as prompt from chat_sessions),
n as (select *, case when {_NAME} in ({_in('rewrite')}) then 'rewrite' when {_NAME} in ({_in('shorten')}) then 'shorten' else 'create_blog' end as kind, {S.bare(S.one_line("coalesce(topic, '')"))} as tt from t where prompt is not null)
select intent, topic, prompt, kind, case when tt <> '' then tt when kind in ('rewrite', 'shorten') then 'current draft' else 'general topic' end as named_topic,
  not {S.has(f"lower({S.one_line('prompt')})", R.NO_STEPS)} and {S.has(f"lower({S.one_line('prompt')})", R.STEPS)} as steps,
  (case when {_NONE} then 0 {' '.join(f"when {_SAID} = {S.q(w)} then {n}" for w, n in R.NUMBERS.items())} else try_cast({_SAID} as bigint) end) is not null and ({_INTENT}) = 'create_blog' as edits_images from n""")
def request_forms(spark, folder):
    """Requests as the parser's names put them, with what their wording adds."""
    t = read_table(spark, folder, "chat_sessions").select(F.explode("turns").alias("t")).select(F.col("t.parsed_intent").alias("intent"), F.col("t.parsed_topic").alias("topic"), F.col("t.user_prompt").alias("prompt")).where("prompt is not null").distinct()
    k = t.withColumn("kind", R.intent_of_name(F.col("intent")))
    return k.select("intent", "topic", "prompt", "kind", R.topic_of_name(F.col("topic"), F.col("kind")).alias("named_topic"), R.prefers_steps(F.col("prompt")).alias("steps"), R.edits_images(F.col("prompt")).alias("edits_images"))


@register("editor_notes", f"""
with r as (select distinct id, prompt, coalesce(draft, '') as draft from resilience_report where prompt is not null), p as (select id, draft, {_INTENT} as intent, {_LENGTH} as length, len({S.words('draft')}) as words from r)
select id, intent, length, words, concat_ws(' ', case when length = 'long' and words < 400 then 'too_short' when length = 'short' and words > 300 then 'too_long' end, case when intent = 'create_blog' and not contains(draft, '##') then 'no_headings' end) as notes from p""")
def editor_notes(spark, folder):
    """What a draft must be sent back for, given the length and kind that its prompt asks for."""
    r = read_table(spark, folder, "resilience_report").where("prompt is not null").select("id", "prompt", F.coalesce("draft", F.lit("")).alias("draft")).distinct()
    p = r.select("id", "draft", R.intent(F.col("prompt")).alias("intent"), R.length(F.col("prompt")).alias("length"), F.size(T.words(F.col("draft"))).cast("bigint").alias("words"))
    size = F.when((F.col("length") == "long") & (F.col("words") < 400), "too_short").when((F.col("length") == "short") & (F.col("words") > 300), "too_long")
    heads = F.when((F.col("intent") == "create_blog") & ~F.contains("draft", F.lit("##")), "no_headings")
    return p.select("id", "intent", "length", "words", F.concat_ws(" ", size, heads).alias("notes"))

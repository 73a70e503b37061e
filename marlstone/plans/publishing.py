"""Queries that assemble, ground and publish drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.display import with_shown
from marlstone.functions.text import one_line, strip
from marlstone.operators import documents as D
from marlstone.plans import sql as S
from marlstone.plans.registry import register
from marlstone.session import ship_package
from marlstone.sources.tables import read_table


def _sectioned(spark, folder):
    d = read_table(spark, folder, "resilience_report").select("id", "name", F.coalesce("draft", F.lit("")).alias("draft")).distinct()
    parts = F.split(F.regexp_replace(F.concat(F.lit("\n"), F.col("draft")), "\n##[ \t]+", "\x01"), "\x01")
    sec = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.trim(F.split_part(x, F.lit("\n"), F.lit(1))).alias("heading"), strip(F.regexp_replace(x, "^[^\n]*", "")).alias("body")))
    title = strip(F.regexp_extract("draft", "(?m)^# (.+)$", 1))
    return d.select("id", "draft", F.when(title != "", title).otherwise(one_line(F.col("name"))).alias("title"), F.filter(sec, lambda s: (s["heading"] != "") & (s["body"] != "")).alias("sections"))


_T = f"coalesce(nullif({S.strip(chr(114) + 'egexp_extract(draft, ' + S.q('(?m)^# (.+)$') + ', 1)')}, ''), {S.one_line('name')})"
_PARTS = "string_split(regexp_replace(chr(10) || draft, '\\n##[ \\t]+', chr(1), 'g'), chr(1))[2:]"
_SECS = f"list_filter(list_transform({_PARTS}, lambda x: {{'h': trim(string_split(x, chr(10))[1]), 'b': {S.strip(S.sub('x', '^[^' + chr(10) + ']*', '', ''))}}}), lambda s: s.h <> '' and s.b <> '')"
_BASE = f"(select distinct id, draft, {_T} as title, {_SECS} as secs from (select id, name, coalesce(draft, '') as draft from resilience_report))"
_NOMD = S.one_line(S.sub(S.sub(S.sub("draft", r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]+)\]\([^)]*\)", r"\1"), "[#>*_`~]", " "))
_META = f"coalesce(regexp_replace(substr(case when length({S.one_line('title')}) >= 60 then {S.one_line('title')} when length({_NOMD}) >= 60 then {_NOMD} end, 1, 160), '[ .]+$', ''), nullif({S.one_line('title')}, ''), 'Article')"


@register("publish_markdown", f"""
select id, {S.strip(f"'---' || chr(10) || 'title: ' || title || chr(10) || 'meta_description: ' || {_META} || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || case when len(secs) > 0 then array_to_string(list_transform(secs, lambda s: '## ' || s.h || chr(10) || chr(10) || s.b), chr(10) || chr(10)) else {S.strip('draft')} end || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || '- report ' || id")} || chr(10) as document from {_BASE}""")
def publish_markdown(spark, folder):
    d = _sectioned(spark, folder)
    return d.select("id", D.published_markdown(F.col("title"), F.col("draft"), F.col("sections"), F.array(F.concat(F.lit("report "), F.col("id")))).alias("document"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register("publish_html", f"""
select id, '<!doctype html><html lang="en"><head><meta charset="utf-8" /><title>' || {_esc('title')} || '</title><meta name="description" content="' || {_esc(_META)} || '" /></head><body><article><h1>' || {_esc('title')} || '</h1>' ||
  case when len(secs) > 0 then array_to_string(list_transform(secs, lambda s: '<section><h2>' || {_esc('s.h')} || '</h2>' || array_to_string(list_transform(list_filter(string_split(s.b, chr(10)), lambda x: trim(x) <> ''), lambda x: '<p>' || {_esc('trim(x)')} || '</p>'), '') || '</section>'), '')
  else '<section><p>' || {_esc(_NOMD)} || '</p></section>' end || '<section><h2>Sources</h2><ul><li>' || {_esc("'report ' || id")} || '</li></ul></section></article></body></html>' as document from {_BASE}""")
def publish_html(spark, folder):
    d = _sectioned(spark, folder)
    return d.select("id", D.published_html(F.col("title"), F.col("draft"), F.col("sections"), F.array(F.concat(F.lit("report "), F.col("id")))).alias("document"))


@register("grounded_sections", f"""
with u as (select id, unnest(secs) as s, unnest(range(1, len(secs) + 1)) as section_no from {_BASE}),
b as (select id, section_no, s.h as heading, {S.strip("array_to_string(list_filter(string_split(s.b, chr(10)), lambda x: not regexp_matches(lower(trim(x)), '^(source:|\\[source:)')), chr(10))")} as own from u)
select id, section_no, heading, case when own = '' then {S.q(D.MISSING)} else own end || chr(10) || chr(10) || '[Source: report ' || id || ']' as body from b""")
def grounded_sections(spark, folder):
    d = _sectioned(spark, folder).select("id", F.posexplode(D.grounded(F.col("sections"), F.array(F.concat(F.lit("report "), F.col("id"))))).alias("n", "s"))
    return d.select("id", (F.col("n") + 1).cast("bigint").alias("section_no"), "s.heading", "s.body")


_FOUND = f"regexp_extract(draft, {S.q(f'(?mi)^##[ {chr(9)}]*(?:{D.CLOSINGS})[^{chr(10)}]*$')})"


@register("conclusion_heading", f"""
select id, case when contains(draft, {S.q(D.CONCLUSION)}) then draft when {_FOUND} <> '' then substr(draft, 1, instr(draft, {_FOUND}) - 1) || {S.q(D.CONCLUSION)} || substr(draft, instr(draft, {_FOUND}) + length({_FOUND}))
  else {S.sub('draft', '[' + chr(92) + 's]+$')} || chr(10) || chr(10) || {S.q(D.CONCLUSION)} || chr(10) || chr(10) || 'The points above sum up what is known about ' || {S.one_line('title')} || '.' end as document from {_BASE}""")
def conclusion_heading(spark, folder):
    """Drafts with the closing heading in its one form."""
    d = _sectioned(spark, folder)
    return d.select("id", D.with_conclusion(F.col("draft"), F.col("title")).alias("document"))


@register("shown_drafts")
def shown_drafts(spark, folder):
    """Drafts as HTML for display."""
    ship_package(spark)
    d = read_table(spark, folder, "resilience_report").select("id", "draft").distinct()
    return with_shown(d, text="draft", key="id")

"""Column expressions over text. All are built-in expressions, null in gives null out unless said otherwise.

White space is what Unicode calls so, as in Python's ``\\s``; Java's own ``\\s`` and ``trim`` know less.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A class that Java's and RE2's regular expressions read alike.
WS = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What may stand before and after a whole word.
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def one_line(c: Column) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normal(c: Column) -> Column:
    return F.lower(one_line(c))


def cleaned(c: Column) -> Column:
    """LF line ends, runs of blanks as one space, at most one blank line in a row, ends trimmed."""
    lf = F.regexp_replace(c, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lf, "[ \t]+", " "), "\n{3,}", "\n\n"))


def clipped(c: Column, most: int = 180) -> Column:
    """One line of at most ``most`` characters; a longer one loses its last, partial word and gets an ellipsis."""
    def cut(one: Column) -> Column:
        short = F.trim(F.regexp_replace(F.substring(one, 1, most), " [^ ]*$", ""))
        return F.when(F.length(one) <= most, one).when(short == "", F.substring(one, 1, most)).otherwise(F.concat(short, F.lit("...")))

    return bound(one_line(c), cut)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; other letters part them."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters of the one-line form, rounded up."""
    return F.ceil(F.length(one_line(c)) / 4).cast("bigint")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(one_line(c), " "), lambda x: x != "")


def _stem_parts(stem: Column) -> Column:
    return F.filter(F.split(F.replace(stem, F.lit("-"), F.lit("_")), "_"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))


def title_of_stem(stem: Column) -> Column:
    """Parts of a file stem but for numbers, each with a capital; ``Untitled`` if none is left."""
    t = F.array_join(F.transform(_stem_parts(stem), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))), " ")
    return F.when(t == "", "Untitled").otherwise(t)


def topic_of_stem(stem: Column) -> Column:
    t = F.lower(F.array_join(F.slice(_stem_parts(stem), 1, 4), " "))
    return F.when(t == "", "general").otherwise(t)


def _case(c: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F
    for pattern, name in rules:
        out = out.when(c.rlike(pattern), name)
    return out.otherwise(other)


#: Ordered rules for a page's topic and kind by its URL.
URL_TOPICS = [("privacy|oaic", "privacy"), ("police", "police_check"), ("background", "background_check"), ("how-it-works", "process"), ("faq", "faq")]
URL_KINDS = [(r"\.pdf$", "pdf"), ("faq", "faq"), ("blog", "blog"), ("how-it-works", "guide")]
#: Ordered rules for a failure's class by its message.
ERROR_KINDS = [("resource_exhausted|quota|rate limit|429", "quota_exhausted"), ("unauthenticated|auth|api key|401", "auth_error"), ("timeout|deadline|504", "timeout"), ("invalid_argument|400", "invalid_request")]
#: Ordered rules for a document's topic by its file stem, and signs of a failure that more requests make worse or that blocks a site.
STEM_TOPICS = [("privacy", "privacy"), ("processing|time", "processing_time"), ("document|requirement", "requirements"), ("police", "police_check"), ("background", "background_check")]
QUOTA, BLOCKING = "429|resource_exhausted|quota", "403|forbidden|timeout"
#: Words that stay small inside a title, and how many words a title has at most.
SMALL, MOST_TITLE_WORDS = "a an the and or for to of in on with".split(), 14


def url_topic(url: Column) -> Column:
    return F.when(url.isNotNull(), _case(F.lower(url), URL_TOPICS, "compliance"))


def url_kind(url: Column) -> Column:
    return F.when(url.isNotNull(), _case(F.lower(url), URL_KINDS, "webpage"))


def error_kind(message: Column) -> Column:
    return F.when(message.isNotNull(), _case(F.lower(message), ERROR_KINDS, "invoke_error"))


def filename_topic(stem: Column) -> Column:
    return F.when(stem.isNotNull(), _case(F.lower(stem), STEM_TOPICS, "compliance"))


def is_quota_error(message: Column) -> Column:
    return F.lower(message).rlike(QUOTA)


def is_blocking_error(message: Column) -> Column:
    return F.lower(message).rlike(BLOCKING)


def log_line(c: Column, most: int = 7000) -> Column:
    return bound(one_line(F.coalesce(c, F.lit(""))), lambda x: F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit(" ...[truncated]"))))


def title_case(topic: Column) -> Column:
    """At most 14 words, each with a capital but for small words inside; a topic that says nothing gets a fixed title."""
    bare = F.regexp_replace(one_line(F.coalesce(topic, F.lit(""))), "^[ .,!?:;]+|[ .,!?:;]+$", "")
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))

    def made(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w, i: F.when((i > 0) & (i < F.size(ws) - 1) & F.lower(w).isin(SMALL), F.lower(w)).otherwise(cap(w))), " ")

    def whole(x: Column) -> Column:
        return F.when(F.lower(x).isin("", "current draft"), "Current Draft Update").otherwise(bound(F.slice(F.split(x, " "), 1, MOST_TITLE_WORDS), made))

    return bound(bare, whole)


def host(url: Column) -> Column:
    """Lower-case network location, empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def without_www(h: Column) -> Column:
    return F.regexp_replace(F.lower(h), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Without fragment, outer white space and closing slashes."""
    return F.regexp_replace(strip(F.regexp_replace(url, "#.*$", "")), "/+$", "")


def title_of_url(url: Column) -> Column:
    """The path without outer slashes, else the network location."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    return F.when(path != "", path).otherwise(host(url))


def chunk_hash(*columns: Column) -> Column:
    """SHA-1 over the values joined by U+001F, nulls marked; equal exactly if all values are."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]
    return F.sha1(F.concat_ws("\x1f", *parts))


def cache_key(topic: Column, intent: Column, length: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lower(F.trim(topic)), intent, length), 256), 1, 24)


def score_percent(score: Column) -> Column:
    """0 for null, a share up to 1 as percent, otherwise the rounded score."""
    return F.when(score.isNull(), 0).when(score <= 1, F.bround(score * 100)).otherwise(F.bround(score)).cast("bigint")


def score_share(score: Column) -> Column:
    return F.when(score.isNull(), 0.0).when(score <= 1, F.greatest(F.lit(0.0), score)).otherwise(F.least(F.lit(1.0), score / 100))


#: Labels of audiences that aren't made word by word.
AUDIENCES = {"hr": "HR professionals", "hr professionals": "HR professionals", "backoffice": "backoffice teams", "": "general audience"}


def audience_label(audience: Column) -> Column:
    n = normal(audience)
    by_word = F.array_join(F.transform(F.split(n, " "), lambda w: F.when(w == "hr", "HR").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))), " ")
    out = F
    for k, v in AUDIENCES.items():
        out = out.when(n == k, v)
    return out.otherwise(by_word)


def without_markdown(c: Column) -> Column:
    """Plain text on one line: images and marks go, links keep their wording."""
    x = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", " ")
    x = F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1")
    return one_line(F.regexp_replace(x, "[#>*_`~]", " "))


def meta_description(title: Column, draft: Column) -> Column:
    """The first of title and plain draft with 60 characters or more, cut to 160; else the title or a default."""
    def first(d: Column) -> Column:
        t = one_line(title)
        long = F.when(F.length(t) >= 60, t).when(F.length(d) >= 60, d)
        return F.coalesce(F.regexp_replace(F.substring(long, 1, 160), "[ .]+$", ""), F.when(t != "", t), F.lit("Article"))

    return bound(without_markdown(draft), first)


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def reference_line(title: Column, key: Column, url: Column) -> Column:
    t, u = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(url, F.lit("")))
    return F.concat(F.when(t != "", t).otherwise(key), F.lit(" | URL: "), F.when(u != "", u).otherwise(F.lit("khong_co")))


def line_kind(line: Column) -> Column:
    """Of an exported draft's line: heading level 1 to 3, else 0."""
    return F.when(line.startswith("### "), 3).when(line.startswith("## "), 2).when(line.startswith("# "), 1).otherwise(0)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def intro(draft: Column) -> Column:
    """On one line, what stands between the title and the first section; empty without a title."""
    title = F.regexp_extract(draft, r"(?:^|\n)# [^\n]*\n", 0)
    rest = F.substring(draft, F.instr(draft, title) + F.length(title), F.length(draft))
    return one_line(F.when(title == "", "").otherwise(F.split_part(F.concat(F.lit("\n"), rest), F.lit("\n## "), F.lit(1))))


def html_text(html: Column) -> Column:
    """Visible text of markup by regular expressions: scripts, styles and page furniture elements go."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    for tag in ("nav", "header", "footer", "aside", "iframe"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return one_line(x)

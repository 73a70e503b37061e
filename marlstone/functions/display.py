"""Markdown shown as HTML, line by line, for previews."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Occurrences of one link text after which it is shown as plain text.
MOST_LINKS = 2
_LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)")
_INLINE = [(re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"), (re.compile(r"(?<!\*)\*([^*\n]+)\*(?!\*)"), r"<em>\1</em>"), (re.compile(r"`([^`\n]+)`"), r"<code>\1</code>")]


def _inline(text: str, seen: Counter) -> str:
    t = html.escape(text, quote=False)
    t = _IMAGE.sub(lambda m: f'<img src="{html.escape(m[2])}" alt="{html.escape(m[1])}" loading="lazy" />', t)

    def link(m: re.Match) -> str:
        seen[m[1]] += 1
        return m[1] if seen[m[1]] > MOST_LINKS else f'<a href="{html.escape(m[2])}" rel="noopener">{m[1]}</a>'

    t = _LINK.sub(link, t)
    for pattern, to in _INLINE:
        t = pattern.sub(to, t)
    return t


def shown(text: str | None) -> str | None:
    """Headings, lists, quotes, rules, images, links and emphasis of a markdown text as HTML; everything else is escaped."""
    if text is None:
        return None
    seen: Counter = Counter()
    out: list[str] = []
    kind = ""

    def to(new: str) -> None:
        nonlocal kind
        if kind and kind != new:
            out.append(f"</{kind}>")
        if new and kind != new:
            out.append(f"<{new}>")
        kind = new

    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        if m := re.match(r"(#{1,6})\s+(.*)", line):
            to("")
            out.append(f"<h{len(m[1])}>{_inline(m[2], seen)}</h{len(m[1])}>")
        elif m := re.match(r"[-*•]\s+(.*)", line):
            to("ul")
            out.append(f"<li>{_inline(m[1], seen)}</li>")
        elif m := re.match(r"\d+[.)]\s+(.*)", line):
            to("ol")
            out.append(f"<li>{_inline(m[1], seen)}</li>")
        elif m := re.match(r">\s?(.*)", line):
            to("blockquote")
            out.append(f"<p>{_inline(m[1], seen)}</p>")
        elif re.fullmatch(r"-{3,}|\*{3,}", line):
            to("")
            out.append("<hr />")
        elif line:
            to("")
            out.append(f"<p>{_inline(line, seen)}</p>")
        else:
            to("")
    to("")
    return "".join(out)


def with_shown(df: DataFrame, *, text: str, key: str, out: str = "html") -> DataFrame:
    """(key, out): each row's markdown as HTML. That a repeated link loses its address is a rule over the whole text, so it is Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(t) for t in b.column(1).to_pylist()], pa.string())], ["k", "h"])

    return df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, "k string, h string").toDF(key, out)

"""Splitting oversized texts at natural boundaries.

A recursive separator hierarchy: section, paragraph, line, sentence, word, then character. A
stretch that still exceeds the limit is split at the next finer level; the resulting pieces are
packed greedily up to the limit, and each piece but the first starts with a tail of the one before it,
cut at the coarsest natural boundary that the overlap allows.

Texts within the limit never leave the JVM; only oversized ones go through Arrow to Python.
Each row is handled by itself, so there is no shuffle apart from dropping repeated deliveries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1800
OVERLAP = 220
_TRIM = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

#: The levels from coarse to fine, each with the white space that is its boundary. A section boundary is a
#: paragraph boundary before a heading, so it counts as `paragraph` where a level is reported.
LEVELS = [
    ("paragraph", re.compile(r"\n(?:[^\S\n]*\n)+\s*(?=#{1,6} )")),
    ("paragraph", re.compile(r"\n(?:[^\S\n]*\n)+\s*")),
    ("line", re.compile(r"\s*\n\s*")),
    ("sentence", re.compile(r"(?<=[.!?])\s+")),
    ("space", re.compile(r"\s+")),
]
_NAMES = [name for name, _ in LEVELS] + ["none"]
_SENTENCE, _WORD = LEVELS[3][1], LEVELS[4][1]


def atoms_of(text: str, limit: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of at most ``limit`` characters at natural boundaries, and the finest level used."""
    deepest, spans, todo = 0, [], [(0, len(text), 0)]
    while todo:  # depth first, left to right
        start, end, level = todo.pop()
        if end - start <= limit:
            if end > start:
                spans.append((start, end))
                deepest = max(deepest, level - 1)
            continue
        if level == len(LEVELS):
            deepest = level
            spans += [(i, min(i + limit, end)) for i in range(start, end, limit)]
            continue
        cuts, at = [], start
        for m in LEVELS[level][1].finditer(text, start, end):
            cuts.append((at, m.start(), level + 1))
            at = m.end()
        todo += reversed([*cuts, (at, end, level + 1)])
    return spans, deepest


def _tail(text: str, low: int, end: int) -> int:
    """Where an overlap that may begin at ``low`` begins: at a sentence, else at a word, else at ``low``."""
    if low >= end:
        return end
    for boundary in (_SENTENCE, _WORD):
        if low and (m := boundary.search(text, low - 1, end)) and m.end() < end:
            return max(low, m.end())
    return low


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], str]:
    """Spans of the pieces of ``text``, each of at most ``limit`` characters, and the boundary level needed."""
    spans, deepest = atoms_of(text, limit)
    out, start, i = [], 0, 0
    while i < len(spans):
        start = min(start, spans[i][0]) if out else spans[i][0]
        j = i
        while j + 1 < len(spans) and spans[j + 1][1] - start <= limit:
            j += 1
        end = spans[j][1]
        out.append((start, end))
        i = j + 1
        if i < len(spans):
            start = _tail(text, max(out[-1][0] + 1, end - overlap, spans[i][1] - limit), end)
            if start >= end:
                start = spans[i][0]
    return out, _NAMES[deepest]


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), _TRIM, "")


_LONG = "d string, k string, piece_no int, boundary string, s int, e int, t string"


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, k, t in zip(*(b.column(c).to_pylist() for c in ("d", "k", "t"))):
                spans, level = pieces_of(t, limit, overlap)
                rows += [(d, k, n, level, s, e, t[s:e]) for n, (s, e) in enumerate(spans)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["d", "k", "piece_no", "boundary", "s", "e", "t"])

    return run


def oversized(df: DataFrame, *, text: str = "text", doc: str = "doc_id", key: str = "chunk_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the records longer than ``limit``, with the internal columns d, k, piece_no, boundary, s, e, t."""
    own = df.select(F.col(doc).cast("string").alias("d"), F.col(key).cast("string").alias("k"), _normal(F.col(text)).alias("t"))
    long = own.where(F.length("t") > limit).dropDuplicates(["d", "k", "t"])
    return long.mapInArrow(_split_batches(limit, overlap), _LONG)


def split_oversized(df: DataFrame, *, text: str = "text", doc: str = "doc_id", key: str = "chunk_id", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc, key, parent, piece_no, boundary, start_at, end_at, text): every record as its pieces.

    CRLF and CR become LF and outer white space goes. A record within the limit, blank or null
    comes out as one piece with a null boundary; its key is kept, and the pieces of an oversized record get the key
    with ``_p`` and their place. Repeated deliveries of the same record and text come out once; where
    one key has several texts, each is split. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    own = df.select(F.col(doc).cast("string").alias("d"), F.col(key).cast("string").alias("k"), _normal(F.col(text)).alias("t"))
    short = own.where(F.coalesce(F.length("t") <= limit, F.lit(True))).distinct().select(
        "d", F.col("k").alias("piece"), "k", F.lit(0).alias("piece_no"), F.lit(None).cast("string").alias("boundary"),
        F.lit(0).alias("s"), F.coalesce(F.length("t"), F.lit(0)).alias("e"), "t",
    )
    long = oversized(df, text=text, doc=doc, key=key, limit=limit, overlap=overlap).select(
        "d", F.concat_ws("_p", F.coalesce("k", F.lit("")), F.col("piece_no").cast("string")).alias("piece"), "k", "piece_no", "boundary", "s", "e", "t",
    )
    return short.unionAll(long).select(
        F.col("d").alias("doc_id"), F.col("piece").alias("chunk_id"), F.col("k").alias("parent_chunk_id"), "piece_no", "boundary",
        F.col("s").alias("start_at"), F.col("e").alias("end_at"), F.col("t").alias("text"),
    )


def oversized_boundaries(df: DataFrame, *, text: str = "text", doc: str = "doc_id", key: str = "chunk_id", limit: int = LIMIT) -> DataFrame:
    """(key, boundary) of each record that had to be split: the coarsest level that suffices."""
    return oversized(df, text=text, doc=doc, key=key, limit=limit, overlap=0).where("piece_no = 0").select(F.col("k").alias(key), "boundary").distinct()


SQL_FOUND = r"""
with c as (select distinct chunk_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
       '^[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') as t from au_blog_chunks),
l as (select chunk_id, t, regexp_replace(t, '\n([^\S\n]*\n)+\s*', chr(1), 'g') as p from c where length(t) > 1800),
m as (select chunk_id, p, regexp_replace(p, '\s*\n\s*', chr(1), 'g') as ln from l),
s as (select chunk_id, p, ln, regexp_replace(ln, '([.!?])[\s\x0b\x{0085}\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g') as se from m),
w as (select chunk_id, p, ln, se, regexp_replace(se, '[\s\x0b\x{0085}\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', chr(1), 'g') as sp from s)
select chunk_id, case when list_max(list_transform(string_split(p, chr(1)), lambda x: length(x))) <= 1800 then 'paragraph'
  when list_max(list_transform(string_split(ln, chr(1)), lambda x: length(x))) <= 1800 then 'line'
  when list_max(list_transform(string_split(se, chr(1)), lambda x: length(x))) <= 1800 then 'sentence'
  when list_max(list_transform(string_split(sp, chr(1)), lambda x: length(x))) <= 1800 then 'space' else 'none' end as boundary
from w
"""

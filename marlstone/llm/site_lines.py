"""Lines repeated across one site's documents.

Lines are normalised and hashed, the distinct documents of each source and line hash are
counted, lines above a share of their source's documents are frequent, and the frequent
lines are joined back so that documents can be rebuilt without them.

Everything runs as built-in expressions. What is shuffled is two hashes for each distinct
line of a document, not text; counts are combined before the shuffle. A line that stands in a
third of all documents is one row of the frequent side; the other side of that join is split by
adaptive skew handling, because a semi join needs no buffering of either side's equal rows. Lines are
normalised once: their hashes are written, a row of arrays for each record, and counted and joined from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import written

MIN_DOCS = 5
MIN_SHARE = 0.05
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def source_of(domain: Column) -> Column:
    """Lower case, without a leading ``www.``; null stays null."""
    return F.regexp_replace(F.lower(domain), r"^www\.", "")


def line_like(line: Column) -> Column:
    """The form under which two lines count as the same: lower case, runs of white space as one
    space, ends trimmed, runs of digits as one number. Blank lines become the empty string."""
    one = F.regexp_replace(F.lower(line), _SPACE, " ")
    return F.regexp_replace(F.trim(one), "[0-9]+", "0")


def _prepared(df: DataFrame, text: str, source: str, doc: str, key: str) -> DataFrame:
    """(k, r1, r2, dh, sh, likes) of each row with source, document and text: the row's identity (its key and text), hashes
    of document and source, and of each line two hashes, null for a blank one. Written once, so that lines are normalised once."""
    own = df.select(
        F.col(key).cast("string").alias("k"), F.col(doc).alias("d"), source_of(F.col(source)).alias("s"), F.col(text).cast("string").alias("t")
    ).where("s is not null and s <> '' and d is not null and t is not null")
    like = F.transform(F.split("t", "\n"), line_like)
    both = F.transform(like, lambda x: F.when(x != "", F.struct(F.xxhash64("s", x).alias("h1"), F.hash(x, F.col("s")).alias("h2"))))
    return written(own.select("k", *_identity(), F.xxhash64("d").alias("dh"), F.xxhash64("s").alias("sh"), both.alias("likes")), "lines")


def _identity() -> list[Column]:
    """Of rows (k, t), nulls included: 96 bits of hash by which equal keys with equal texts are one row."""
    none = [F.col(c).isNull() for c in ("k", "t")]
    return [F.xxhash64(*none, "k", "t").alias("r1"), F.hash("t", "k", *none).alias("r2")]


def _repeated(prepared: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """(k, r1, r2, line_no) of the lines of ``prepared`` repeated too often in their source."""
    once = prepared.select("sh", "dh", F.explode("likes").alias("x")).where("x is not null").select("sh", "x.h1", "x.h2", "dh").distinct()
    n_of = once.groupBy("sh", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    filled = prepared.where(F.exists("likes", lambda x: x.isNotNull()))
    docs = filled.select("sh", "dh").distinct().groupBy("sh").agg(F.count(F.lit(1)).alias("docs"))
    often = n_of.join(docs, "sh").where(F.col("n") >= F.col("docs") * F.lit(min_share)).select("h1", "h2")
    lines = prepared.select("k", "r1", "r2", F.posexplode("likes").alias("line_no", "x")).where("x is not null")
    return lines.select("k", "r1", "r2", "line_no", "x.h1", "x.h2").join(often, ["h1", "h2"], "left_semi").drop("h1", "h2")


def repeated_lines(
    df: DataFrame, *, text: str = "text", source: str = "source_domain", doc: str = "doc_id", key: str = "chunk_id",
    min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """(key, line_no) of each non-blank line repeated too often in its source.

    A document counts once however often it is delivered. Rows without source, document or
    text, and blank lines, give nothing; an empty table gives an empty result; other columns of
    ``df`` are never touched, whatever their names. A key with several texts gives the lines of each; a null ``key`` stays null.
    """
    found = _repeated(_prepared(df, text, source, doc, key), min_docs, min_share)
    return found.select(F.col("k").alias(key), "line_no").distinct()


def without_repeated_lines(
    df: DataFrame, *, text: str = "text", source: str = "source_domain", doc: str = "doc_id", key: str = "chunk_id",
    min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, out: str = "clean_text",
) -> DataFrame:
    """(key, ``out``): one row for each distinct key and text, the text without its repeated lines.

    Lines go by the text they stand in, so a key with several texts, or several rows without a key, lose only their own.
    A row delivered under several sources loses what is repeated in any of them. Null texts stay null; a text all of whose
    lines are repeated becomes empty; rows without source or document keep all lines.
    """
    found = _repeated(_prepared(df, text, source, doc, key), min_docs, min_share)
    drop = found.groupBy("r1", "r2").agg(F.collect_set("line_no").alias("gone"))  # at most the lines of one text
    own = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).select("k", "t", *_identity())
    joined = own.groupBy("r1", "r2").agg(F.first("k").alias("k"), F.first("t").alias("t")).join(drop, ["r1", "r2"], "left")
    kept = F.filter(F.split("t", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i))
    clean = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("k").alias(key), clean.alias(out))


_SQL = r"""
with c as (select distinct chunk_id, doc_id, regexp_replace(lower(source_domain), '^www\.', '') as s, text
           from au_blog_chunks where source_domain is not null and source_domain <> '' and text is not null and doc_id is not null),
l as (select chunk_id, doc_id, s, text, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from c),
n as (select chunk_id, doc_id, s, text, line_no,
        regexp_replace(trim(regexp_replace(lower(line), '[\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '[0-9]+', '0', 'g') as k from l),
b as (select * from n where k <> ''),
d as (select s, count(distinct doc_id) as docs from b group by s),
f as (select s, k, count(distinct doc_id) as n from b group by s, k),
g as (select distinct b.chunk_id, b.text, b.line_no from b join f on b.s = f.s and b.k = f.k join d on d.s = b.s where f.n >= 5 and f.n >= 0.05 * d.docs)
"""
SQL_FOUND = _SQL + "select distinct chunk_id, cast(line_no as integer) as line_no from g"
SQL_CLEAN = _SQL + """,
r as (select row_number() over () as r, chunk_id, text from (select distinct chunk_id, text from au_blog_chunks)),
p as (select r, chunk_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from r where text is not null),
kept as (select p.r, string_agg(p.line, chr(10) order by p.line_no) as clean from p
         where not exists (select 1 from g where g.chunk_id is not distinct from p.chunk_id and g.text = p.text and g.line_no = p.line_no) group by p.r)
select r.chunk_id, case when r.text is null then null else coalesce(kept.clean, '') end as clean_text from r left join kept on kept.r = r.r
"""

"""Near-duplicate records by Golay-code fuzzy hashing.

1. Fingerprint. Each text gets segments of 23 bits. A bit is one bit of a minimum hash over the text's words, so
   equal words flip few bits. Beside each segment stands the minimum hash of the text's word sequences
   (shingles), and there is a sketch of one bit each of such minimum hashes.
2. Keys. The binary Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of exactly one
   codeword. A segment gives that codeword's 12-bit index, and where it lies at 3 bits also the five
   codewords at 4 bits: six keys or one. Two segments that differ in at most 2 bits always share a key,
   and beyond that often do. The syndrome of a segment (11 bits) tells its error patterns, so decoding
   is a join with a fixed table of 2048 rows. The index alone would have 4096 values for the whole corpus; the
   key therefore also holds the segment's number and its minimum hash.
3. Pigeonhole. The errors of a similar pair spread over the segments; one segment with few errors is enough.
4. Join on keys, keep pairs whose sketches agree, and verify the rest exactly on the whole texts.

Exact copies (equal word sequences) are one class before any key is made, so a group of copies, however
large, costs one row for each copy. A segment takes 16 bytes of hash, two longs of sketch and its bits; how many classes have its minimum
hashes decides whether its codewords are compared after the join or split it before. Texts are read again only for classes in candidate pairs. One segment, with two minimum
hashes in its key, finds 0.33 to 0.36 of the pairs at a similarity of 0.6 where single words differ, but 0.15 where all that
differs is a block of new words (a word overlap of 0.6; simulated), so all 28 miss less than 0.01 % and 1 % of those. There is no exact way for the rest. A larger corpus keeps its keys
selective by a greater ``exact``, which needs more ``segments`` for the same recall.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import written

THRESHOLD = 0.6
SHINGLE = 3
LEAST_WORDS = 40
#: Segments of a fingerprint, and minimum hashes folded into each segment's key.
SEGMENTS, EXACT = 28, 2
BITS = 23
#: Minimum hashes in the sketch, of one bit each: two longs.
SKETCH = 128
#: A table of up to so many bytes (as counted) is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 32_000_000
#: Classes with the same minimum hashes of a segment that are held against each other; more are split by codewords first.
MANY = 64

_WORD = re.compile(r"[^\W_]+")
#: The code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters or digits, in lower case."""
    return _WORD.findall(text.lower())


def syndrome(word: int) -> int:
    """The remainder of a 23-bit word by the generator."""
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def decoding_table() -> dict[int, list[int]]:
    """For each syndrome the error patterns that lead to nearby codewords: the one of weight 3 or less, and
    where that has weight 3, the five of weight 4."""
    table: dict[int, list[int]] = {}
    for weight in range(5):
        for places in itertools.combinations(range(BITS), weight):
            e = sum(1 << i for i in places)
            have = table.setdefault(syndrome(e), [])
            if weight <= 3 or have[0].bit_count() == 3:
                have.append(e)
    return table


def codewords_near(word: int, table: dict[int, list[int]]) -> set[int]:
    """The indices of the codewords that a segment gives as keys."""
    return {(word ^ e) >> 11 for e in table[syndrome(word)]}


def jaccard(a: str, b: str, shingle: int = SHINGLE) -> float:
    """Distinct shingles in common over distinct shingles in either; 0 if neither has any."""
    x, y = ({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for w in (words_of(a), words_of(b)))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 0.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Fingerprints:
    """Segments, segment hashes and sketches of many texts at a time."""

    def __init__(self, segments: int, exact: int, shingle: int, least_words: int):
        self.segments, self.exact, self.shingle, self.least = segments, exact, shingle, max(least_words, shingle)
        odd = np.random.default_rng(20260101).integers(1, 2**63, segments * BITS + max(SKETCH, segments * exact), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_words, self.of_shingles = odd[: segments * BITS], odd[segments * BITS :]
        self._hash: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> list[int]:
        have = self._hash
        if len(have) > 500_000:
            have.clear()
        out = []
        for w in words:
            h = have.get(w)
            if h is None:
                h = have[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        return out

    @staticmethod
    def _minima(values: np.ndarray, starts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        out = np.empty((len(starts), len(factors)), np.uint64)
        for i, f in enumerate(factors):
            out[:, i] = np.minimum.reduceat(values * f, starts)
        return out

    def of(self, texts: list[str | None]) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts with enough words: their places, class hashes, segments, segment hashes and sketches."""
        places, classes, per = [], [], []
        for n, t in enumerate(texts):
            w = words_of(t) if t else []
            if len(w) >= self.least:
                places.append(n)
                classes.append(xxhash.xxh64_intdigest(" ".join(w), 11))
                per.append(np.array(self._hashes(w), np.uint64))
        if not places:
            none = np.empty((0, self.segments), np.int64)
            return [], [], none, none, np.empty((0, 2), np.int64)
        lengths = np.array([len(x) for x in per])
        ends = lengths.cumsum()
        word = np.concatenate(per)
        m = self.shingle
        rolled = word[: len(word) - m + 1].copy()
        for i in range(1, m):
            rolled = _mix(rolled) * np.uint64(31) + word[i : len(word) - m + 1 + i]
        inside = np.ones(len(word), bool)  # shingles that run past the end of their text
        for i in range(1, m):
            inside[ends - i] = False
        shingle = _mix(rolled)[inside[: len(rolled)]]
        s_starts = np.concatenate(([0], (lengths - m + 1).cumsum()[:-1]))
        low = self._minima(_mix(word), np.concatenate(([0], ends[:-1])), self.of_words)
        bit = (_mix(low) & np.uint64(1)).astype(np.int64).reshape(len(places), self.segments, BITS)
        segs = (bit << np.arange(BITS)).sum(2)
        mins = _mix(self._minima(shingle, s_starts, self.of_shingles))
        own = np.zeros((len(places), self.segments), np.uint64)
        for e in range(self.exact):
            own = _mix(own + mins[:, e * self.segments : (e + 1) * self.segments])
        ones = (mins[:, :SKETCH] & np.uint64(1)).reshape(len(places), 2, 64)
        sketch = (ones << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64).view(np.int64)
        return places, classes, segs, own.view(np.int64), sketch


_PRINTS = "k string, cls bigint, segs array<int>, own array<bigint>, s0 bigint, s1 bigint"


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel(), kind))


def _print_batches(segments: int, exact: int, shingle: int, least_words: int, block: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprints(segments, exact, shingle, least_words)
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                places, classes, segs, own, sketch = f.of(part.column(1).to_pylist())
                if places:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(places)), pa.array(np.array(classes, np.uint64).view(np.int64)), _lists(segs, pa.int32()), _lists(own, pa.int64()), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())],
                        ["k", "cls", "segs", "own", "s0", "s1"],
                    )

    return run


def fingerprints(records: DataFrame, segments: int = SEGMENTS, exact: int = EXACT, shingle: int = SHINGLE, least_words: int = LEAST_WORDS) -> DataFrame:
    """A fingerprint row for each of ``records`` (k, t) with enough words."""
    return records.select("k", "t").mapInArrow(_print_batches(segments, exact, shingle, least_words), _PRINTS)


def _syndrome_of(v: Column) -> Column:
    """The syndrome as 11 parities of the segment's bits, all built-in bit operations."""
    unit = [syndrome(1 << i) for i in range(BITS)]
    rows = [sum(1 << i for i in range(BITS) if unit[i] >> r & 1) for r in range(11)]
    out = F.lit(0)
    for r, mask in enumerate(rows):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)), r))
    return out


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast if ``size``, its bytes a row, adds up to at most MOST_BROADCAST."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MOST_BROADCAST else df


def _indices(seg: Column, errors: Column) -> Column:
    """The indices of the codewords near a segment."""
    return F.transform(errors, lambda e: F.shiftright(seg.bitwiseXOR(e), 11))


def _most_unlike(threshold: float) -> int:
    """Differing sketch bits beyond which a pair at the threshold is less than one in 10,000."""
    p, total = (1 - threshold) / 2, 0.0
    for n in range(SKETCH, -1, -1):
        total += comb(SKETCH, n) * p**n * (1 - p) ** (SKETCH - n)
        if total > 1e-4:
            return n
    return SKETCH


def candidate_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): distinct pairs of ``classes`` (cls, segs, own, s0, s1), a < b, that share a key and whose sketches agree.

    A key is a segment's number, its minimum hashes and one of the one or six indices of codewords near it, which a join with the fixed table of syndromes
    gives. How many classes have the same number and minimum hashes is counted first. Those of one class only are left out; up to
    MANY are joined by these and their indices compared in the join's few results; larger groups are split by the index before they are joined, each row under all its keys.
    """
    table = F.broadcast(classes.sparkSession.createDataFrame([(s, e) for s, e in decoding_table().items()], "syn int, errors array<int>"))  # 2048 rows, whatever the data
    seg = classes.select("cls", "s0", "s1", F.posexplode(F.arrays_zip("segs", "own")).alias("i", "z")).select(
        F.xxhash64("i", "z.own").alias("key"), "cls", "s0", "s1", F.col("z.segs").alias("seg"))
    counts = written(seg.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    few, many = (seg.join(_small(counts.where(c).select("key"), F.lit(16)), "key", "left_semi") for c in (F.col("n") <= MANY, F.col("n") > MANY))

    def decoded(df: DataFrame, seg_: str, out: str) -> DataFrame:
        return df.withColumn("syn", _syndrome_of(F.col(seg_))).join(table, "syn").withColumn(out, _indices(F.col(seg_), F.col("errors"))).drop("syn", "errors")

    def met(rows: DataFrame) -> DataFrame:
        x, y = (rows.select("key", *(F.col(c).alias(f"{p}{c}") for c in ("cls", "s0", "s1", "seg"))) for p in "xy")
        unlike = F.bit_count(F.col("xs0").bitwiseXOR(F.col("ys0"))) + F.bit_count(F.col("xs1").bitwiseXOR(F.col("ys1")))
        # a codeword within 4 bits of both is out of reach beyond 8
        near = (F.col("xcls") < F.col("ycls")) & (F.bit_count(F.col("xseg").bitwiseXOR(F.col("yseg"))) <= 8) & (unlike <= _most_unlike(threshold))
        return x.join(y, "key").where(near).select(F.col("xcls").alias("a"), F.col("ycls").alias("b"), "xseg", "yseg")

    direct = decoded(decoded(met(few), "xseg", "xi"), "yseg", "yi").where(F.arrays_overlap("xi", "yi")).select("a", "b")
    keyed = decoded(many, "seg", "near").withColumn("index", F.explode("near"))
    split = met(keyed.select(F.xxhash64("key", "index").alias("key"), "cls", "s0", "s1", "seg")).select("a", "b")
    return direct.unionAll(split).distinct()


def _verify_batches(threshold: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = [jaccard(x, y, shingle) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            keep = pa.array([s >= threshold - 1e-12 for s in sims], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], ["a", "b", "similarity"]).filter(keep)

    return run


def links(records: DataFrame, *, threshold: float = THRESHOLD, shingle: int = SHINGLE, least_words: int = LEAST_WORDS, segments: int = SEGMENTS, exact: int = EXACT) -> tuple[DataFrame, DataFrame]:
    """Of ``records`` (k string, t string): members (k, cls), and verified pairs of classes (a, b, similarity), a < b.

    Both are written once to the shared folder. Null, blank and short texts are in neither; a key delivered again
    with the same text counts once, a key with several texts is a member of each text's class.
    """
    prints = fingerprints(records, segments, exact, shingle, least_words)
    first = [F.first(c).alias(c) for c in ("segs", "own", "s0", "s1")]
    prints = written(prints, "prints")
    members = prints.select("k", "cls").distinct()
    classes = prints.groupBy("cls").agg(F.min("k").alias("rep"), *first)
    pairs = written(candidate_pairs(classes, threshold), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = written(members.join(_small(ids, F.lit(16)), "cls").groupBy("cls").agg(F.min("k").alias("k")), "wanted")
    texts = records.join(_small(wanted, F.length("k") + 24), "k").select("cls", "k", "t")
    # a key may have several texts: take the one of this class
    texts = _of_class(texts, shingle, least_words).groupBy("cls").agg(F.first("t").alias("t"))
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.col("a").alias("cls"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cls"), F.lit(1).alias("side")))).alias("x"))
    met = sides.select("a", "b", "x.cls", "x.side").join(texts, "cls").groupBy("a", "b").agg(
        F.max(F.when(F.col("side") == 0, F.col("t"))).alias("ta"), F.max(F.when(F.col("side") == 1, F.col("t"))).alias("tb"))
    good = met.mapInArrow(_verify_batches(threshold, shingle), "a bigint, b bigint, similarity double")
    return members, written(good, "links")


def _of_class(texts: DataFrame, shingle: int, least_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [t is not None and xxhash.xxh64_intdigest(" ".join(words_of(t)), 11) == c % 2**64 for c, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(run, "cls bigint, k string, t string")


def records_of(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """(k, t) of several (table, key column, text column) together."""
    parts = [df.select(F.col(k).cast("string").alias("k"), F.col(t).cast("string").alias("t")).where("k is not null and t is not null") for df, k, t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def similar_pairs(records: DataFrame, **how) -> DataFrame:
    """(a, b) keys with a < b of all similar records, copies included: the result may hold all pairs within a group."""
    members, good = links(records, **how)
    x, y = (members.select("cls", F.col("k").alias(n)) for n in ("a", "b"))
    copies = x.join(y, "cls").where("a < b").select("a", "b")
    across = good.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(x.withColumnRenamed("cls", "ca"), "ca").join(y.withColumnRenamed("cls", "cb"), "cb").where("a <> b")
    return copies.unionAll(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, group): the least node of each connected component, from undirected edges (a, b).

    Large-star and small-star steps by turns; each round is written to the shared folder, so lineage stays
    short and lost executors cost no earlier round. A hub's edges are spread by its neighbours' keys after one round.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        n = written(small.unionAll(small_low.select("u", F.col("m").alias("v"))).distinct(), "star")
        changed = n.exceptAll(e).limit(1).count() + e.exceptAll(n).limit(1).count()
        e = n
        if not changed:
            return e.select(F.col("u").alias("node"), F.col("v").alias("group"))


def similar_groups(records: DataFrame, **how) -> DataFrame:
    """(chunk_id, group_id, copies, links): one row for each record that has a copy or a similar record.

    ``group_id`` is the least key of the group, ``copies`` the records with the same words, ``links`` the
    number of other texts found similar to this one's.
    """
    members, good = links(records, **how)
    comp = components(good.select("a", "b"))
    label = comp.select(F.col("node").alias("cls"), F.col("group").alias("g"))
    deg = good.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    per = sizes.join(label, "cls", "left").join(deg, "cls", "left").select("cls", "copies", F.coalesce("g", "cls").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    rows = members.join(per.where("copies > 1 or links > 0"), "cls")
    name = rows.groupBy("g").agg(F.min("k").alias("group_id"))
    return rows.join(name, "g").select(F.col("k").alias("chunk_id"), "group_id", "copies", "links")


SQL_FOUND = r"""
with r as (select distinct chunk_id, t from (select chunk_id, text as t from au_blog_chunks union all select chunk_id, content from validex_knowledge) where t is not null),
w as (select chunk_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as w from r),
s as (select chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from w where len(w) >= 40),
e as (select chunk_id, len(s) as n, unnest(s) as g from s),
m as (select a.chunk_id as a, b.chunk_id as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.g = b.g and a.chunk_id < b.chunk_id group by all)
select a as chunk_id_a, b as chunk_id_b from m where c >= 0.6 * (na + nb - c) - 1e-9
"""

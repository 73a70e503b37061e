"""What is done with the few results of a query: near-duplicates dropped in order, relevance scored, sentences kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.text import words
from marlstone.session import written


def start_words(text: Column, chars: int = 200) -> Column:
    """Distinct words of a text's beginning, the fingerprint that results are compared by."""
    return F.array_distinct(words(F.lower(F.substring(text, 1, chars))))


def overlap(a: Column, b: Column) -> Column:
    """Words in common over those of the larger set; 0 if either is empty."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / larger)


def greedy_distinct(results: DataFrame, by: str, rank: str, text: str, most: int, above: float = 0.8) -> DataFrame:
    """Of each query's ``most`` best results those that overlap with no better kept one by more than ``above``.

    Order matters and the relation isn't transitive, so it is a fold over each query's short ordered list, within the JVM.
    """
    w = W.partitionBy(by).orderBy(rank)
    top = results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_w", start_words(F.col(text)))
    item = F.struct(F.col("_n").alias("n"), F.col("_w").alias("w"))
    listed = top.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("xs"))  # at most ``most`` items
    empty = F.array().cast("array<struct<n:int,w:array<string>>>")
    keep = F.aggregate("xs", empty, lambda acc, x: F.when(F.exists(acc, lambda y: overlap(x["w"], y["w"]) > above), acc).otherwise(F.array_append(acc, x)))
    kept = listed.select(by, F.explode(F.transform(keep, lambda x: x["n"])).alias("_n"))
    return top.join(kept, [by, "_n"], "left_semi").drop("_n", "_w")


def relevance(topic: Column, text: Column, chars: int = 500) -> Column:
    """The topic's words found in the text's beginning; 0.5 for a topic without words."""
    t, x = F.array_distinct(words(F.lower(topic))), F.array_distinct(words(F.lower(F.substring(text, 1, chars))))
    return F.when(F.size(t) == 0, 0.5).otherwise(F.size(F.array_intersect(t, x)) / F.size(t))


def earlier_near_duplicate(rows: DataFrame, *, key: str, within: str, text: str, above: float = 0.8) -> DataFrame:
    """(key, earlier): every row with the least smaller key of its group whose beginning overlaps by more than ``above``.

    Rows with the same set of words are one class, so copies make no pairs. Classes meet only where they share one
    of their rarest words: an overlap above the bound leaves room for that many words that differ, so two sets that
    overlap enough share a word of the first ``n - floor(above n)`` in order of rarity. Null texts and groups match nothing.
    """
    k = rows.select(F.col(key).alias("k"), F.col(within).alias("g"), start_words(F.col(text)).alias("w"))
    k = written(k.withColumn("c", F.when(F.size("w") > 0, F.sha1(F.concat_ws("\x1f", F.array_sort("w"))))), "starts")  # all that follows reads the short beginnings only
    known = k.where("g is not null and c is not null")
    classes = written(known.groupBy("g", "c").agg(F.min("k").alias("rep"), F.first("w").alias("w")), "classes")
    each = classes.select("g", "c", F.explode("w").alias("x"))
    rare = each.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(rare, "x").groupBy("g", "c").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("xs"))  # the words of one beginning
    n = F.size("xs")
    prefix = ordered.select("g", "c", F.explode(F.transform(F.slice("xs", F.lit(1), n - F.floor(above * n).cast("int")), lambda x: x["x"])).alias("x"))
    a, b = (prefix.select("g", "x", F.col("c").alias(f"c{i}")) for i in "ab")
    met = a.join(b, ["g", "x"]).where("ca < cb").select("g", "ca", "cb").distinct()
    of = lambda i: classes.select("g", F.col("c").alias(f"c{i}"), F.col("rep").alias(f"r{i}"), F.col("w").alias(f"w{i}"))
    good = met.join(of("a"), ["g", "ca"]).join(of("b"), ["g", "cb"]).where(overlap(F.col("wa"), F.col("wb")) > above)
    either = good.select("g", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("rb").alias("r")), F.struct(F.col("cb").alias("c"), F.col("ra").alias("r")))).alias("p")).select("g", "p.c", "p.r")
    others = either.unionAll(classes.select("g", "c", F.col("rep").alias("r"))).groupBy("g", "c").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    found = known.join(others, ["g", "c"]).select("k", F.array_min(F.filter("rs", lambda r: r < F.col("k"))).alias("earlier"))
    return k.select("k").join(found, "k", "left").withColumnRenamed("k", key)

"""Queries of this subpackage over the tables of a data folder, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, neardup, page_body, pairs, residue, site_lines, splitting, tokenizer
from marlstone.session import ship_package, spread
from marlstone.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return read_table(spark, folder, "au_blog_chunks")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spread(read_table(spark, folder, "documents").select("doc_id", "text", "source"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(_chunks(spark, folder).select("chunk_id", "text"))


def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    ids = tokenizer.with_tokens(_documents(spark, folder), keep=["doc_id", "text"])
    back = tokenizer.with_text(ids, keep=["doc_id", "text", "ids"], out="decoded")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _shares(spark: SparkSession, folder: str) -> DataFrame:
    targets, docs = read_table(spark, folder, "mix_targets"), _documents(spark, folder)
    sizes = mixing.sized(docs)
    return mixing.shares(mixing.mix(docs, targets, sizes=sizes), targets, sizes)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spread(neardup.records_of((_chunks(spark, folder), "chunk_id", "text"), (read_table(spark, folder, "validex_knowledge"), "chunk_id", "content")))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    chats, report = read_table(spark, folder, "chat_sessions"), read_table(spark, folder, "resilience_report")
    return spread(pairs.chat_pairs(chats).unionByName(pairs.report_pairs(report)))


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: splitting.oversized_boundaries(_chunks(s, d)),
        "p1_pieces": lambda s, d: splitting.split_oversized(_chunks(s, d)),
        "p2_found": lambda s, d: page_body.furniture_lines(_pages(s, d)).select("chunk_id", "line_no"),
        "p2_body": lambda s, d: page_body.main_body(_pages(s, d)),
        "p3_found": lambda s, d: site_lines.repeated_lines(_chunks(s, d)),
        "p3_clean": lambda s, d: site_lines.without_repeated_lines(_chunks(s, d)),
        "p4_found": lambda s, d: neardup.similar_pairs(_records(s, d)).toDF("chunk_id_a", "chunk_id_b"),
        "p4_groups": lambda s, d: neardup.similar_groups(_records(s, d)),
        "p5_found": lambda s, d: pairs.broken_pairs(_pairs(s, d)),
        "p6_ids": lambda s, d: tokenizer.with_tokens(_documents(s, d), keep=["doc_id"]),
        "p6_roundtrip": _roundtrip,
        "p7_mix": lambda s, d: mixing.mix(_documents(s, d), read_table(s, d, "mix_targets")),
        "p7_shares": _shares,
        "p8_found": lambda s, d: residue.residue_found(_documents(s, d)),
        "p8_clean": lambda s, d: residue.without_residue(_documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": splitting.SQL_FOUND, "p3_found": site_lines.SQL_FOUND, "p3_clean": site_lines.SQL_CLEAN, "p4_found": neardup.SQL_FOUND}

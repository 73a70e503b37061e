"""Readers and writers of the file forms that an ingestion meets. A missing path gives an empty table where noted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The canonical chunk record.
CHUNK = (
    "doc_id string, chunk_id string, source_url string, source_domain string, source_type string, topic string, region string, title string, "
    "authority_score double, ai_relevance_score int, approved boolean, text string"
)
#: A line or chunk that a check rejected.
REJECTED = "stage string, source_url string, reason string, text string"
METADATA = (
    "id string, file_stem string, title string, source string, topic string, jurisdiction string, authority_score double, document_type string, approved boolean, source_url string, last_updated string, content string"
)
STATE = "key string, sha1 string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = CHUNK) -> DataFrame:
    """One record for each line that is a JSON object; blank, malformed and other lines are passed over, a missing path is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", f"{schema if isinstance(schema, str) else schema.simpleString()}, _bad string" if isinstance(schema, str) else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    return parsed.where("_bad is null").drop("_bad") if "_bad" in parsed.columns else parsed


def read_text_files(spark: SparkSession, glob: str) -> DataFrame:
    """(doc_id, text): one row for each file, named by its stem; a file is read whole."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return files.select(F.regexp_replace("f", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def read_binary_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(file_name, text): uploads decoded as UTF-8, undecodable bytes replaced, outer white space off."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file_name"), F.trim(F.decode("content", "UTF-8")).alias("text"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata by file stem from a JSON list: authority within 0 and 1 (0.5 if missing), region AU by default; of a stem's
    records the last in the file wins. A missing or invalid file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], METADATA)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in METADATA.split(', '))}>>").alias("x"))
    rows = raw.select(F.posexplode("x").alias("n", "m")).where("m.file_stem is not null and m.file_stem <> ''")
    last = rows.groupBy("m.file_stem").agg(F.max_by("m", "n").alias("m")).select("m.*")
    authority = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("authority_score", F.lit(0.5))))
    return last.withColumns({"authority_score": authority, "jurisdiction": F.coalesce(F.when(F.col("jurisdiction") != "", F.col("jurisdiction")), F.lit("AU")), "approved": F.coalesce("approved", F.lit(False))})


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(key, sha1) as stored by ``write_state``; empty at first."""
    return spark.read.schema(STATE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STATE)


def write_state(state: DataFrame, path: str) -> None:
    """Replaces the stored state. Write the next state beside the old one if ``state`` was derived from it."""
    state.select("key", "sha1").write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary(df: DataFrame) -> DataFrame:
    """(summary): each row of counters as one JSON object, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("summary"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, parts: int, low: int, high: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, numPartitions=str(parts), lowerBound=str(low), upperBound=str(high), **options).load()


def profile(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """(table_exists, column, present): what a check of a catalog table finds."""
    there = spark.catalog.tableExists(table)
    have = set(spark.table(table).columns) if there else set()
    return spark.createDataFrame([(there, c, c in have) for c in columns], "table_exists boolean, column string, present boolean")

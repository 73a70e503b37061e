"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from marlstone import streaming
from marlstone.operators import ordered


def source(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    return streaming.event_stream(spark, str(tmp_path / "in"))


def test_counts_and_sessions(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.run_available(streaming.counts(source(spark, data, tmp_path)), str(tmp_path / "c1"), str(tmp_path / "o1"))
    want = {(r.start, r.event_type): r.n for r in batch.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = got.collect()
    assert rows and all(want[r.start, r.event_type] == r.requests for r in rows) and len(rows) >= len(want) - 10
    s = streaming.run_available(streaming.sessions(streaming.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "c2"), str(tmp_path / "o2"))
    assert s.agg(F.sum("requests")).first()[0] >= batch.count() - 20


def test_limiter_equals_batch(spark, data, tmp_path):
    got = streaming.run_available(streaming.limited(source(spark, data, tmp_path).coalesce(1), 864_000.0, 2), str(tmp_path / "c"), str(tmp_path / "o"))
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    want = ordered.folded(e, "user_id", ["t", "event_id"], ordered.sliding_log(864_000.0, 2)[1], "event_id bigint, user_id bigint, accepted boolean", list)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() == e.count()


def test_deduplicated(spark, data, tmp_path):
    once = source(spark, data, tmp_path)
    got = streaming.run_available(streaming.deduplicated(once.unionByName(streaming.event_stream(spark, str(tmp_path / "in")))), str(tmp_path / "c"), str(tmp_path / "o"))
    assert got.count() == spark.read.parquet(f"{data}/events.parquet").count()

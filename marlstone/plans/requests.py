"""Queries over the request log: limits, sessions, caches and breakers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marlstone.operators import ordered as O
from marlstone.plans.registry import register
from marlstone.session import ship_package
from marlstone.sources.tables import read_table

LIMIT_PER_MINUTE = 30
SESSION_GAP = 3600
#: Cache shards of the trace; a key always goes to the same one.
SHARDS = 64


def _events(spark, folder):
    e = read_table(spark, folder, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@register("rate_fixed_minute", """
with r as (select event_id, user_id, date_trunc('hour', ts) as bucket, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as n from events)
select user_id, epoch_us(bucket) as bucket_us, count(*) as requests, count(*) filter (n > 3) as rejected from r group by user_id, bucket""")
def rate_fixed_minute(spark, folder):
    """Requests of each client in fixed hours, those beyond three rejected but still counted.

    How many are over the limit follows from the count, so rows are combined before the shuffle.
    """
    e = _events(spark, folder).groupBy("user_id", F.unix_micros(F.date_trunc("hour", "ts")).alias("bucket_us")).agg(F.count(F.lit(1)).alias("requests"))
    return e.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - 3))


@register("session_gaps", f"""
with g as (select user_id, event_id, ts, case when lag(ts) over w is null or epoch(ts) - epoch(lag(ts) over w) > {SESSION_GAP} then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, event_id, ts, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as session_no from g)
select user_id, session_no::bigint as session_no, count(*) as requests, epoch_us(min(ts)) as started_us, epoch_us(max(ts)) as ended_us from s group by user_id, session_no""")
def session_gaps(spark, folder):
    """Sessions of each client, begun anew after a gap of more than an hour. A client's rows are sorted, spilling if need be."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    fresh = F.when(gap.isNull() | (gap > SESSION_GAP * 1_000_000), 1).otherwise(0)
    s = _events(spark, folder).select("user_id", "event_id", "ts").withColumn("fresh", fresh).withColumn("session_no", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("requests"), F.unix_micros(F.min("ts")).alias("started_us"), F.unix_micros(F.max("ts")).alias("ended_us"))


def _timed(spark, folder):
    ship_package(spark)
    return _events(spark, folder).withColumn("t", F.unix_micros("ts") / F.lit(1e6))


_ORDERED = "select event_id, user_id, epoch_us(ts) / 1e6 as t, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events"


@register("rate_sliding_log", f"""
with recursive e as materialized ({_ORDERED}), r as (
  select event_id, user_id, n, [t] as log, true as accepted from e where n = 1
  union all select event_id, user_id, n, case when len(kept) < 3 then list_append(kept, t) else kept end, len(kept) < 3 from (
    select e.event_id, e.user_id, e.n, e.t, list_filter(r.log, lambda x: e.t - x <= 7200) as kept from r join e on e.user_id = r.user_id and e.n = r.n + 1))
select event_id, user_id, accepted from r""")
def rate_sliding_log(spark, folder):
    """Whether each request passes a limiter that logs accepted requests only (here 3 in two hours)."""
    e = _timed(spark, folder).select("event_id", "user_id", "t")
    return O.folded(e, "user_id", ["t", "event_id"], O.sliding_log(7200.0, 3)[1], "event_id bigint, user_id bigint, accepted boolean", list)


@register("cache_trace")
def cache_trace(spark, folder):
    """Hits of a sharded cache of limited size and age over the log, keyed by user and kind of request."""
    e = _timed(spark, folder).select("event_id", "t", F.concat_ws("|", "user_id", "event_type").alias("k")).withColumn("shard", F.pmod(F.hash("k"), F.lit(SHARDS)).cast("bigint"))
    return O.folded(e, "shard", ["t", "event_id"], O.lru_cache_trace(10, 86_400.0)[1], "event_id bigint, shard bigint, hit boolean, entries bigint", dict)


@register("circuit_breaker", f"""
with recursive e as materialized (select *, event_type = 'error' as failed from ({_ORDERED})), r as (
  select event_id, user_id, n, failed::bigint as failures, null::double as until, false as open from e where n = 1
  union all select event_id, user_id, n, f, case when not o and f >= 2 then t + 86400 else u end, o from (
    select *, case when o then f0 when failed then f0 + 1 else 0 end as f from (
      select event_id, user_id, n, t, failed, case when over then 0 else failures end as f0, case when over then null else until end as u, until is not null and not over as o from (
        select e.event_id, e.user_id, e.n, e.t, e.failed, r.failures, r.until, coalesce(e.t >= r.until, false) as over from r join e on e.user_id = r.user_id and e.n = r.n + 1))))
select event_id, user_id, open, failures::bigint as failures from r""")
def circuit_breaker(spark, folder):
    """Which requests of each client meet an open breaker: two failures in a row open it for a day."""
    e = _timed(spark, folder).select("event_id", "user_id", "t", (F.col("event_type") == "error").alias("failed"))
    start, step = O.circuit_breaker(2, 86_400.0)
    return O.folded(e, "user_id", ["t", "event_id"], step, "event_id bigint, user_id bigint, open boolean, failures bigint", start)


@register("failure_tail", """
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where event_type = 'error')
select user_id, string_agg(cast(event_id as varchar), ' ' order by ts, event_id) as last_failures, count(*) as kept from r where n <= 8 group by user_id""")
def failure_tail(spark, folder):
    """The last eight failures of each client; older rows go before the shuffle."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = _events(spark, folder).where("event_type = 'error'").withColumn("n", F.row_number().over(w)).where("n <= 8")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), " ")
    return last.groupBy("user_id").agg(ids.alias("last_failures"), F.count(F.lit(1)).alias("kept"))


@register("scheduled_runs", """
select cast(ts as date)::varchar as day, count(*) as polls, epoch_us(min(ts)) as run_us from events where dayofweek(ts) = 0 and hour(ts) = 2 group by 1""")
def scheduled_runs(spark, folder):
    """The one run of each Sunday: the first poll between two and three o'clock."""
    e = _events(spark, folder).where((F.dayofweek("ts") == 1) & (F.hour("ts") == 2))
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("polls"), F.unix_micros(F.min("ts")).alias("run_us"))

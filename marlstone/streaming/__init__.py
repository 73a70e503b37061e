"""The stateful operators as Structured Streaming queries over an event stream.

Every source is any streaming frame with event_id, user_id, ts and what else an operator names; ``ts`` without a
time zone is read as UTC, since watermarks need timestamps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream over a folder that holds event files only."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def counts(events: DataFrame, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Requests and failures of each kind in tumbling windows, final once the watermark has passed them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count(F.lit(1)).alias("requests"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "requests", "total")


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "1 hour") -> DataFrame:
    """Sessions of each client by gap; a session is out once the watermark has passed its end."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count(F.lit(1)).alias("requests")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "requests")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, repeats that come within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def limited(events: DataFrame, span: float = 60.0, most: int = 30) -> DataFrame:
    """(event_id, user_id, accepted): the limiter that logs accepted requests only, its log kept as state.

    The state is at most ``most`` times. Within a batch, requests are taken in order of time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = []
        for e, t in zip(rows["event_id"], rows["t"]):
            log = [x for x in log if t - x <= span]
            ok = len(log) < most
            if ok:
                log.append(t)
            out.append(ok)
        state.update((log,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "accepted": out})

    timed = events.select("event_id", "user_id", (F.unix_micros("ts") / F.lit(1e6)).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, accepted boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet files that survive a restart, and reads them."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.parquet(out)

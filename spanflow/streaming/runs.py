"""Task runs of a live key-event stream.

``session_window(t, "40 seconds")`` closes a key's session once no event has
arrived within 40 s of its last one - the task-run rule (two events exactly
40 s apart stay together, one microsecond more splits them).  The watermark
bounds state: a session is final once event time has passed its end by the
allowed lateness, and later events for it are dropped by Spark.

A run is identified by its first event time (a stream has no global run
counter); its string, event count and last time are the same as the batch run
table's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanflow.functions.metrics import RUN_GAP_US
from spanflow.plans.keystream import key_events
from spanflow.session import scratch_path


def run_stream(k: DataFrame, gap_us: int = RUN_GAP_US, lateness: str = "10 minutes",
               keys=("user_id", "editor")) -> DataFrame:
    """Streaming (or batch) key events -> one row per run: keys, first_us,
    last_us, n_events, key_string."""
    x = k.withColumn("_ts", F.timestamp_micros("t_us")).withWatermark("_ts", lateness)
    gap = f"{gap_us // 1_000_000} seconds" if gap_us % 1_000_000 == 0 else f"{gap_us} microseconds"
    ordered = F.array_sort(F.collect_list(F.struct("t_us", "seq", "key_event")))
    agg = x.groupBy(*keys, F.session_window("_ts", gap).alias("_w")).agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.count("key_event").alias("n_events"), ordered.alias("_evs"))
    return agg.select(*keys, "first_us", "last_us", "n_events",
                      F.array_join(F.transform("_evs", lambda e: e["key_event"]), "").alias("key_string"))


def with_sentinel(events: DataFrame, folder: str) -> DataFrame:
    """The event stream and, from a folder of its own, one event that belongs to nobody.

    A session leaves the state once the watermark passes its end.  At the end of a
    bounded replay no later event does that; a sentinel far in the future does."""
    return events.unionByName(events.sparkSession.readStream.schema(events.schema).parquet(folder))


def stream_runs_to_table(spark: SparkSession, sf_dir: str, lateness: str = "10 minutes") -> DataFrame:
    """Replay the ``events`` parquet folder as a stream (available-now trigger) into a table under the shared folder.

    The sink appends each run once, when the watermark has passed it; nothing is
    collected.  A last event a year after the others closes all runs; it has no
    user, and its own run is never closed."""
    src = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    # File streams watch a folder; the filter picks the events file in it.
    events = (spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet")
                   .parquet(sf_dir.rstrip("/")))
    name = f"stream-{uuid.uuid4().hex}"
    last = src.agg(F.max("ts").alias("ts"))  # compressed time: a year is a thousand of its years
    sentinel = last.select(*[(F.col("ts") + F.expr("INTERVAL '1000' YEAR")).cast(f.dataType).alias(f.name) if f.name == "ts"
                             else F.lit("click").alias(f.name) if f.name == "event_type"
                             else F.lit(-1).cast(f.dataType).alias(f.name) if f.name in ("event_id", "user_id")
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in src.schema.fields])
    sentinel.write.parquet(scratch_path(spark, f"{name}-sentinel"))
    runs = run_stream(key_events(with_sentinel(events, scratch_path(spark, f"{name}-sentinel"))), lateness=lateness)
    q = (runs.writeStream.outputMode("append").format("parquet").option("path", scratch_path(spark, f"{name}-runs"))
             .option("checkpointLocation", scratch_path(spark, f"{name}-state"))
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(runs.schema).parquet(scratch_path(spark, f"{name}-runs"))

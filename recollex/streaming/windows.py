"""Streams of events: per-period series, sessions, deduplication, and the belief fold as a stateful operator."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollex.operators.beliefs import Store, rows_of


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they arrive; a naive `ts` is one of the session's time zone, as watermarks need instants."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    naive = dict(rows.dtypes).get("ts") == "timestamp_ntz"
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if naive else rows


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", *by: str) -> DataFrame:
    """Count and sum of value for each window and key; events later than `late` are dropped when streaming."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Runs of a key's events with no gap longer than `gap`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each event once; a stream remembers keys as long as the watermark asks."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


_OUT = "store_id long, belief_id string, status string, confidence double"


def fold_stream(log: DataFrame) -> DataFrame:
    """Changed beliefs after each batch of a log: a store's state is kept between batches, and its events apply by seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store()
        if state.exists:
            store.beliefs = json.loads(state.get[0])
        before = {i: (b["status"], b["confidence"]) for i, b in store.beliefs.items()}
        events = pd.concat(list(batches)).sort_values("seq")
        for e in rows_of(events):
            e["asserted_at"] = None if e.get("asserted_at") is None else str(e["asserted_at"])
            store.apply(e)
        state.update((json.dumps(store.beliefs),))
        changed = [b for i, b in store.beliefs.items() if before.get(i) != (b["status"], b["confidence"])]
        yield pd.DataFrame({"store_id": [int(key[0])] * len(changed), "belief_id": [b["belief_id"] for b in changed], "status": [b["status"] for b in changed], "confidence": [float(b["confidence"]) for b in changed]})

    return log.groupBy("store_id").applyInPandasWithState(step, _OUT, "beliefs string", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, run through the stream into a table in memory; for tests and small feeds."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if shared:  # the folder that driver and executors share; without one (tests) Spark makes its own
        writer = writer.option("checkpointLocation", f"{shared}/stream-{uuid.uuid4().hex}")
    query = writer.start()
    query.awaitTermination()
    return spark.table(name)

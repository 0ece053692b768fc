"""Event streams: windows with watermarks, sessions, de-duplication, flows and sinks. Each has a batch twin of equal results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late`` a watermark bounds the state of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without repeated ids; state is kept as long as the watermark says."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def purchases_after_error(events: DataFrame) -> DataFrame:
    """A stateful operator: users whose purchase follows an error; the state is one flag and a count a user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting, found = state.get if state.exists else (False, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if kind == "error":
                waiting = True
            elif kind == "purchase" and waiting:
                waiting, found = False, found + 1
        state.update((bool(waiting), int(found)))
        yield pd.DataFrame({"user_id": [key[0]], "recovered": [found]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, recovered bigint", "waiting boolean, found bigint", "update", "NoTimeout")


def upsert_batches(stream: DataFrame, folder: str, key: list[str], checkpoint: str, order: list[str] | None = None):
    """A sink that keeps the last row of each key in each batch, idempotent by batch number: a batch written twice is the same batch.

    The last row is that of the greatest ``order`` columns (all others by default, so the choice is never arbitrary).
    """

    def write(batch: DataFrame, number: int) -> None:
        by = [F.desc(c) for c in order or [c for c in batch.columns if c not in key]]
        last = batch.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("_r = 1").drop("_r") if by else batch.dropDuplicates(key)
        last.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over what is there into a memory table (tests)."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)

"""Structured Streaming over event and score streams: an addition to the batch operators, with the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import new_path


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_a_trigger: int = 64) -> DataFrame:
    """A stream of the files of a table; its schema is that of the files there are."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "1 day", id_: str | None = "event_id") -> DataFrame:
    """Rows and summed value by window and key; ids seen before, within the allowed lateness, don't count again.

    Values are summed as decimals, so the order of arrival changes nothing.
    """
    kept = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    kept = kept.dropDuplicatesWithinWatermark([id_]) if id_ else kept
    grouped = kept.groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total")).select(F.col("w.start").cast(events.schema[time].dataType).alias("start"), key, "n", "total")


def run_available(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Process what is there, in update mode, and return the last state of each key.

    Each micro-batch is written with its number, so a batch that is run again
    after a failure replaces its own files; the newest row of a key counts.
    """
    spark, path = stream.sparkSession, new_path(stream.sparkSession, label)
    columns = stream.columns

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(path)
    return written.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in columns if c not in keys]).select(columns)


def moving_average(events: DataFrame, key: str = "user_id", time: str = "ts", value: str = "value", decay: float = 0.9) -> DataFrame:
    """F14 as state: for each key the exponential moving average over its values, in order of time within a batch; null values are left out."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        average, n = state.get if state.exists else (None, 0)
        for f in sorted_frames(frames, time):
            for v in f[value].dropna().to_numpy():
                average = float(v) if average is None else decay * average + (1 - decay) * float(v)
                n += 1
        state.update((average, n))
        yield pd.DataFrame({key: [k[0]], "average": [average], "n": [n]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, time, value).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, average double, n long", "average double, n long", "update", "NoTimeout")


def sorted_frames(frames: Iterator[pd.DataFrame], time: str) -> Iterator[pd.DataFrame]:
    """A key's rows of one batch in order of time; a batch is bounded by the trigger's number of files."""
    held = list(frames)
    if held:
        yield pd.concat(held).sort_values(time, kind="stable")

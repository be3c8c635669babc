"""Structured Streaming over the log: idempotent producers and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lineage import new_path
from ..operators.sessions import Producer, append_step

DECISIONS = "producer bigint, part bigint, seq bigint, decision string"


def follow(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; new files are read as they come."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def decide_appends(batches: DataFrame) -> DataFrame:
    """The streaming form of ``sessions.decide_appends``: the same step, its state kept between micro-batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")  # a producer's rows of one micro-batch
        p = Producer(*state.get) if state.exists else Producer()
        decisions = [append_step(p, int(r.epoch), int(r.base), int(r.count)) for r in rows.itertuples(index=False)]
        state.update((p.epoch, p.base, p.count))
        yield pd.DataFrame({"producer": key[0], "part": key[1], "seq": rows["seq"].to_numpy(), "decision": decisions})

    grouped = batches.groupBy("producer", "part")
    return grouped.applyInPandasWithState(step, DECISIONS, "epoch int, base bigint, count bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n of each tumbling window; rows later than ``late`` behind the newest are dropped by the watermark."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), "event_type", "n")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream, into a table in the shared folder, which is read back."""
    spark = stream.sparkSession
    out, progress = new_path(spark, "streams"), new_path(spark, "progress")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

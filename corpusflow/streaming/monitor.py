"""Streams: a training log that grows, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evaluation import LOG_SCHEMA
from ..sources.files import parse_log


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of JSON-lines files as they arrive; blank and broken lines are left out."""
    return parse_log(spark.readStream.text(folder), LOG_SCHEMA)


def loss_alerts(log: DataFrame, run: str = "run", margin: float = 0.05) -> DataFrame:
    """A row for each validation loss that is ``margin`` above the least so far of its run.

    The state is one number for each run."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = state.get[0] if state.exists else float("inf")
        for rows in batches:
            out = []
            for step, loss in rows.sort_values("step")[["step", "val_loss"]].itertuples(index=False):
                if loss > least + margin:
                    out.append((key[0], step, loss, least))
                least = min(least, loss)
            yield pd.DataFrame(out, columns=["run", "step", "val_loss", "least_loss"])
        state.update((least,))

    points = log.where("val_loss IS NOT NULL").select(F.col(run).alias("run"), "step", "val_loss")
    return points.groupBy("run").applyInPandasWithState(watch, "run string, step long, val_loss double, least_loss double", "least double", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` don't count in append mode."""
    ts = F.col("ts").cast("timestamp")
    windowed = events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result as a table."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)

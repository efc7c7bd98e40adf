"""Streaming queries, run over the test tables as far as these go."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import monitor as M
from ..streaming import sessions as N
from . import chat_queries, eval_queries
from .common import table

QUERIES, SQL = {}, {}


def event_windows(spark, sf_dir):
    path = f"{sf_dir}/event[s].parquet"  # a pattern: a stream takes no single file otherwise
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    out = M.run_to_end(M.event_windows(events))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["stream_event_windows"] = event_windows
SQL["stream_event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def live(spark, sf_dir, name):
    """A table as a stream; a pattern, as a stream takes no single file otherwise."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def session_windows(spark, sf_dir):
    turns = live(spark, sf_dir, "conversations").selectExpr(*chat_queries._TURN)
    return N.latest_windows(N.run_to_files(N.trimmed_sessions(turns, 4), "session-windows")).select("conv_id", F.col("turn").cast("int").alias("turn"), "role")


def switches(spark, sf_dir):
    judged = N.run_to_files(N.switched(live(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 60.0, 40.0), "switches")
    return judged.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "running")


QUERIES["stream_session_trim"] = session_windows
SQL["stream_session_trim"] = chat_queries.SQL["session_trim"]
QUERIES["stream_hysteresis"] = switches
SQL["stream_hysteresis"] = eval_queries.SQL["hysteresis"]

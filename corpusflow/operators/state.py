"""Conversation settings and state: thinking levels, parameters, models, time windows, agent replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import strip
from .shared import shared_folder

# The seven levels, and the spellings of each.
LEVELS = [(0, "do", False, None, 0, False, 4), (1, "re", True, "low", 256, False, 4), (2, "mi", True, "low", 1024, False, 6), (3, "fa", True, "medium", 4096, False, 8), (4, "sol", True, "medium", 8192, False, 10), (5, "la", True, "high", 16384, True, 12), (6, "si", True, "high", 32768, True, 16)]
ALIASES = {
    0: ["do", "דו", "0", "doh", "ut", "off", "none", "silent"],
    1: ["re", "רה", "1", "ray", "minimal", "whisper"],
    2: ["mi", "מי", "2", "me", "low", "quiet"],
    3: ["fa", "פה", "3", "fah", "medium", "default", "moderate"],
    4: ["sol", "סול", "4", "so", "soh", "high", "strong"],
    5: ["la", "לה", "5", "lah", "very-high", "very_high", "loud"],
    6: ["si", "סי", "6", "ti", "te", "max", "maximum", "full"],
}
LEVEL_SCHEMA = "level int, name string, enabled boolean, effort string, budget_tokens int, extended boolean, max_tool_iterations int"


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, LEVEL_SCHEMA)


def parse_level(df: DataFrame, column: str) -> DataFrame:
    """Adds ``level`` by any spelling, blanks and case aside; null for unknown ones."""
    spellings = df.sparkSession.createDataFrame([(a, k) for k, all_ in ALIASES.items() for a in all_], "_alias string, level int")
    return df.withColumn("_alias", F.lower(strip(F.col(column)))).join(F.broadcast(spellings), "_alias", "left").drop("_alias")


def clamp_level(level: Column, most: Column, supported: Column) -> Column:
    return F.when(supported, F.least(level, most)).otherwise(0)


def shift_level(level: Column, steps: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(6), level + steps))


def iteration_ceiling(run: Column, agent: Column, level_default: Column) -> Column:
    return F.coalesce(run, agent, level_default)


def merge_parameters(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Each parameter of ``override`` that isn't null, else the base's."""
    o = override.select(key, *(F.col(c).alias(f"_{c}") for c in override.columns if c != key))
    return base.join(o, key, "left").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in base.columns if c != key))


def resolve_models(candidates: DataFrame, installed: DataFrame) -> DataFrame:
    """For each spec the first candidate (spec, rank, name) that is installed; a name without a tag
    stands for its latest."""
    full = F.when(F.contains("name", F.lit(":")), F.col("name")).otherwise(F.concat("name", F.lit(":latest")))
    have = installed.select(F.when(F.contains("name", F.lit(":")), F.col("name")).otherwise(F.concat("name", F.lit(":latest"))).alias("_f")).distinct()
    found = candidates.withColumn("_f", full).join(have, "_f", "left_semi")
    return found.groupBy("spec").agg(F.min_by("name", "rank").alias("name"))


def catalogue_order(models: DataFrame, tiers: list[str]) -> DataFrame:
    """By tier, then by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")), F.lit(0)), F.lit(len(tiers) + 1))
    return models.withColumn("_r", rank).orderBy("_r", "name").drop("_r")


def in_window(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day is in [start, end), which may cross midnight."""
    return (minute >= start) & (minute < end) if start <= end else (minute >= start) | (minute < end)


def hysteresis(free: Column, start_at: float, stop_at: float, rows: WindowSpec) -> Column:
    """On at ``start_at`` or more, off below ``stop_at``, else as the last row before that said, at first off;
    ``rows``: a window in order. A null value changes nothing."""
    flip = F.when(free >= start_at, True).when(free < stop_at, False)
    return F.coalesce(F.last(flip, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))


def progress_line(status: Column, done: Column, total: Column) -> Column:
    """Progress as text; a percentage only for a positive total."""
    return F.when(total > 0, F.format_string("%s %d%%", status, F.floor(100 * done / total))).otherwise(status)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def replay_agent(requests: DataFrame, model: Callable[[DataFrame], DataFrame], tools: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """Run every request (conv_id, prompt) until its model asks for no tool, all of them in step.

    ``model`` adds content, name and arguments (name null: done) to rows (conv_id, transcript).  Rows
    that still ask after ``most`` rounds come back with ``exhausted``.  One job for each round.
    """
    open_ = requests.select("conv_id", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("transcript"))
    ensure_checkpoint_dir(requests.sparkSession)
    done = None
    for k in range(most):
        answered = model(open_).checkpoint()
        said = F.array(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content")))
        ended = answered.where("name IS NULL").select("conv_id", F.concat("transcript", said).alias("transcript"), F.lit(k + 1).alias("rounds"), F.lit(False).alias("exhausted"))
        done = ended if done is None else done.unionByName(ended)
        result = F.array(F.struct(F.lit("tool").alias("role"), tools(F.col("name"), F.col("arguments"))["content"].alias("content")))
        open_ = answered.where("name IS NOT NULL").select("conv_id", F.concat("transcript", said, result).alias("transcript"))
    return done.unionByName(open_.select("conv_id", "transcript", F.lit(most).alias("rounds"), F.lit(True).alias("exhausted")))

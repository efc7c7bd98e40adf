"""Training windows over a token stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest vocabulary whose ids fit 16 bits.
MAX_VOCAB = 65_536


def check_vocab(size: int) -> None:
    if size > MAX_VOCAB:
        raise ValueError(f"vocabulary of {size} does not fit 16-bit ids")


def n_windows(tokens: Column, length: int) -> Column:
    return F.floor(tokens / length)


def check_length(tokens: int, length: int) -> None:
    """A stream needs room for one window and its last target."""
    if tokens < length + 1:
        raise ValueError(f"{tokens} tokens are fewer than one window of {length} and its target")


def array_windows(df: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """Non-overlapping windows of each row's ids: window_id, input, and target shifted by one.

    A window needs its last target, so offset + length + 1 may not pass the end."""
    others = [c for c in df.columns if c != ids]
    last = F.floor((F.size(ids) - 1) / length) - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))

    def window(k: Column) -> Column:
        at = (k * length).cast("int")
        return F.struct(k.alias("window_id"), F.slice(ids, at + 1, F.lit(length)).alias("input"), F.slice(ids, at + 2, F.lit(length)).alias("target"))

    # Cut inside the row, so the whole array isn't copied into each window's row.
    return df.select(*others, F.inline(F.transform(starts, window)))


def random_offsets(spark, windows: int, tokens: int, length: int, seed: int) -> DataFrame:
    """Offsets drawn with replacement from [0, tokens - length - 1), the same for the same seed."""
    check_length(tokens, length + 1)
    name = F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary"))
    return spark.range(windows).select(F.col("id").alias("window_id"), (F.conv(F.substring(name, 1, 15), 16, 10).cast("long") % F.lit(tokens - length - 1)).alias("offset"))


def shifted_rows(df: DataFrame, ids: str = "ids") -> DataFrame:
    """pos, token and target, the token that follows it in its row's array; the last has none."""
    others = [c for c in df.columns if c != ids]
    pairs = F.arrays_zip(F.col(ids).alias("token"), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))).alias("target"))
    return df.select(*others, F.posexplode(pairs).alias("pos", "p")).select(*others, "pos", "p.token", "p.target")


def collate(df: DataFrame, batch: int, pad: int, ignore: int = -100) -> DataFrame:
    """Rows (example_id, ids, labels) in batches, padded to the batch's longest row."""
    numbered = df.withColumn("batch_id", F.floor(F.col("example_id") / batch))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch_id"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("width") - F.size(c)))
    wide = numbered.withColumn("width", width)
    return wide.select("batch_id", "example_id", fill(F.col("ids"), pad).alias("ids"), fill(F.col("labels"), ignore).alias("labels"))

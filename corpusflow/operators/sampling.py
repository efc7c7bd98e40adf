"""A sample of a text stream at evenly spaced places, by a distributed prefix sum of lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import SEPARATOR
from .shared import SharedTable
from .state import ensure_checkpoint_dir

#: Windows are found among so many bytes of keys by broadcast; beyond it by a shuffled join.
BROADCAST_BYTES = 32 << 20


def _placed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The rows (keys, _size) with ``start``, the sum of the sizes before them in the order of ``keys``; the
    whole sum. Only the narrow rows are sorted, and the driver sees a number for each partition."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(len(keys)).to_numpy()
            yield pa.record_batch([*batch.columns, pa.array(at + np.cumsum(sizes) - sizes), pa.array(np.full(len(batch), part, np.int32))], names=[*keys, "_size", "at", "part"])
            at += int(sizes.sum())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*keys, "_size").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = ordered.mapInArrow(local, f"{fields}, _size long, at long, part int").checkpoint()
    first, total = {}, 0
    for r in sorted(rows.groupBy("part").agg(F.sum("_size").alias("n")).collect()):
        first[r.part] = total
        total += r.n

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = np.array([first[p] for p in batch.column(len(keys) + 2).to_numpy()], np.int64)
            yield pa.record_batch([*batch.columns[: len(keys) + 1], pa.array(begin + batch.column(len(keys) + 1).to_numpy())], names=[*keys, "_size", "start"])

    return rows.mapInArrow(moved, f"{fields}, _size long, start long"), total


def stream_sample(df: DataFrame, order: list[str], budget: int, windows: int = 40, text: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """window, start, text: about ``budget`` characters of the rows' texts, joined in order by ``separator``.

    From each of ``windows`` evenly spaced places the rest of the line is dropped, and budget / windows
    characters are read on, over rows and to the stream's end at most.  A stream within the budget is one window
    that holds all of it.  Null texts are empty; rows that share an order are ordered by the text's hash.

    The rows are written to the shared folder once: their places and two looks at the texts read them."""
    if not separator.endswith("\n"):
        raise ValueError("the separator must end a line")
    gap = len(separator)
    names = [f"_k{k}" for k in range(len(order))]
    keys = [*names, "_h"]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(order, names, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    rows = SharedTable(rows, "sampled").read()
    placed, total = _placed(rows.select(*keys, (F.length("_text").cast("long") + gap).alias("_size")), keys)
    total = max(0, total - gap)  # nothing stands behind the last text
    each = budget // windows
    end = F.col("start") + F.col("_size")
    if total <= budget:
        begins = [0]
        each = total
    else:
        spots = [total * k // windows for k in range(windows)]
        at = F.filter(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(p).cast("long").alias("place")) for k, p in enumerate(spots))), lambda s: (s["place"] >= F.col("start")) & (s["place"] < end))
        hit = placed.withColumn("at", at).where(F.size("at") > 0).select(*keys, "start", F.inline("at"))
        line = F.call_function("locate", F.lit("\n"), F.concat("_text", F.lit(separator)), (F.col("place") - F.col("start") + 1).cast("int"))
        found = _with_text(hit, rows, keys, ["window", "start"]).select("window", (F.col("start") + line).alias("begin")).collect()
        begins = [min(r.begin, total) for r in sorted(found)]
    spans = F.array(*(F.struct(F.lit(k).alias("window"), F.lit(b).cast("long").alias("begin"), F.lit(min(b + each, total)).cast("long").alias("stop")) for k, b in enumerate(begins)))
    cut = placed.withColumn("span", F.filter(spans, lambda s: (s["begin"] < end) & (s["stop"] > F.col("start")))).where(F.size("span") > 0).select(*keys, "start", F.inline("span"))
    low = F.greatest(F.col("begin") - F.col("start"), F.lit(0))
    piece = F.substring(F.concat("_text", F.lit(separator)), (low + 1).cast("int"), (F.col("stop") - F.col("start") - low).cast("int"))
    return _with_text(cut, rows, keys, ["window", "start"]).select("window", (F.col("start") + low).alias("start"), piece.alias("text"))


def _with_text(few: DataFrame, rows: DataFrame, keys: list[str], each: list[str]) -> DataFrame:
    """The narrow rows ``few`` with their texts, once for ``each``; texts stay where they are if few are wanted."""
    wanted = few.withColumnsRenamed({k: f"{k}_" for k in keys})
    if wanted.count() * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return rows.join(wanted, same).dropDuplicates(each)

"""One stream of tokens over all rows in order: places by a distributed prefix sum, windows across rows.

Rows are range-partitioned and sorted once, counted by partition, and each partition's first place is the sum
of those before it: a number for each partition is all that the driver sees.  Windows are cut inside
partitions; those that run over a partition's edge come from fragments, a few for each partition.  No token
is a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .state import ensure_checkpoint_dir
from .tokenizer import Tokenizer, encode
from .windows import check_length


class TokenStream:
    """All rows' ids in the order of ``order`` (then of a hash of what the row holds), each followed by the ids
    ``after``.  With a tokenizer, texts are ordered first and encoded where they lie, so ids aren't shuffled
    and nothing is encoded twice.

    A null array or text is empty; rows that repeat are in the stream as often."""

    def __init__(self, df: DataFrame, order: list[str], ids: str = "ids", after: tuple[int, ...] = (), tokenizer: Tokenizer | None = None, text: str = "text") -> None:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        bounded_batches(spark)
        keys = [f"_k{k}" for k in range(len(order))]
        held = F.coalesce(F.col(text), F.lit("")).alias("text") if tokenizer is not None else F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>").alias("ids")
        rows = df.select(*(F.col(c).alias(k) for c, k in zip(order, keys, strict=True)), held)
        rows = rows.withColumn("_h", F.xxhash64("text" if tokenizer is not None else "ids"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartitionByRange(parts, *keys, "_h").sortWithinPartitions(*keys, "_h")
        if tokenizer is not None:
            ordered = encode(ordered.select("text"), tokenizer)
        ordered = ordered.select(F.concat("ids", F.array(*map(F.lit, after)).cast("array<int>")).alias("ids"))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at = TaskContext.get().partitionId(), 0
            for batch in batches:
                lengths = batch.column(0).value_lengths().to_numpy().astype(np.int64)
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                yield pa.record_batch([pa.array(np.full(len(batch), part, np.int32)), pa.array(starts), batch.column(0)], names=["part", "at", "ids"])

        # The checkpoint keeps partitions and their order, and lineage ends there.
        self.local = ordered.mapInArrow(placed, "part int, at long, ids array<int>").checkpoint()
        sizes = {r.part: r.n for r in self.local.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()}
        self.first, self.tokens = {}, 0
        for part in sorted(sizes):
            self.first[part] = self.tokens
            self.tokens += sizes[part]

    def rows(self) -> DataFrame:
        """start, ids: every row's first place in the stream."""
        first = self.first

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                begin = np.array([first.get(p, 0) for p in batch.column(0).to_numpy()], np.int64)
                yield pa.record_batch([pa.array(begin + batch.column(1).to_numpy()), batch.column(2)], names=["start", "ids"])

        return self.local.mapInArrow(moved, "start long, ids array<int>")

    def windows(self, length: int, limit: int | None = None) -> DataFrame:
        """window_id, input, target: windows of ``length`` side by side, targets shifted by one.

        A window needs its last target; a stream too short for one window is an error."""
        check_length(self.tokens, length)
        first = self.first

        def cut(whole: bool):
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                cutter = _Cutter(length)
                for batch in batches:
                    if not len(batch):
                        continue
                    flat = batch.column(2).flatten().to_numpy()
                    yield from cutter.add(first.get(batch.column(0)[0].as_py(), 0) + batch.column(1)[0].as_py(), flat, whole)
                yield from cutter.end(whole)

            return self.local.mapInArrow(work, "window_id long, at long, ids array<int>")

        # A partition's runs are the same each time, so whole windows and fragments complete one another.
        edges = cut(False).groupBy("window_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
        out = cut(True).select("window_id", "ids").unionByName(edges.where(F.size("ids") == length + 1))
        if limit is not None:
            out = out.where(F.col("window_id") < limit)
        return out.select("window_id", F.slice("ids", 1, length).alias("input"), F.slice("ids", 2, length).alias("target"))


class _Cutter:
    """Windows of length + 1 tokens, each sharing its last one with the next, from runs of the stream.

    ``add`` and ``end`` give whole windows, or else the fragments at a run's edges."""

    def __init__(self, length: int) -> None:
        self.length, self.at, self.held = length, None, np.zeros(0, np.int32)

    def add(self, start: int, ids: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        if self.at is not None and start != self.at + len(self.held):
            yield from self.end(whole)
        if self.at is None:
            self.at, self.inside = start, start == 0
        self.held = np.concatenate([self.held, ids])
        n = self.length
        # The window that began before the run, or whose last target is the run's first token.
        if not self.inside and len(self.held) > (edge := -self.at % n):
            if not whole:
                yield _batch([(self.at - 1) // n], [self.at], self.held[: edge + 1], edge + 1)
            self.held, self.at, self.inside = self.held[edge:], self.at + edge, True
        if self.inside and (count := max(0, (len(self.held) - 1) // n)):
            if whole:
                at = self.at + n * np.arange(count)
                each = np.lib.stride_tricks.sliding_window_view(self.held, n + 1)[::n][:count]
                yield _batch(at // n, at, each.ravel(), n + 1)
            self.held, self.at = self.held[count * n :], self.at + count * n

    def end(self, whole: bool) -> Iterator[pa.RecordBatch]:
        if len(self.held) and not whole:
            yield _batch([(self.at - (not self.inside)) // self.length], [self.at], self.held, len(self.held))
        self.at, self.held = None, np.zeros(0, np.int32)


def _batch(windows, at, flat: np.ndarray, each: int) -> pa.RecordBatch:
    edges = np.arange(len(windows) + 1, dtype=np.int32) * each
    return pa.record_batch([pa.array(np.asarray(windows, np.int64)), pa.array(np.asarray(at, np.int64)), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(flat), pa.int32()))], names=["window_id", "at", "ids"])

"""Building a corpus: minimum length, chunking at paragraphs, held-out split, order, manifest."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SharedTable, drop_place, new_place, shared_path

MIN_CHARS, MAX_CHARS = 200, 16_384
SEED, HELD_OUT = 1729, 0.005
#: Written between documents of a split.
SEPARATOR = "\n\n<|endoftext|>\n\n"
#: Bytes of a split's file read at a time.
READ_BYTES = 1 << 20


def long_enough(text: Column, least: int = MIN_CHARS) -> Column:
    return F.length(text) >= least


def chunk_array(text: Column, most: int = MAX_CHARS, least: int = MIN_CHARS, separator: str = "\n\n") -> Column:
    """A text's chunks: whole if it is short enough, else paragraphs joined greedily up to ``most``.

    A paragraph longer than that is a chunk of its own.  Chunks under ``least`` are dropped only where
    the text was cut.  The fold runs inside one row, so nothing is shuffled.
    """
    import re

    gap = len(separator)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("size"))

    def add(acc: Column, paragraph: Column) -> Column:
        full = acc["now"].isNotNull() & (acc["size"] + F.length(paragraph) > most)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["now"].isNull(), paragraph).otherwise(F.concat(acc["now"], F.lit(separator), paragraph)).alias("now"),
            (F.when(full, F.lit(0)).otherwise(acc["size"]) + F.length(paragraph) + gap).alias("size"),
        )

    folded = F.aggregate(F.split(text, re.escape(separator), -1), start, add, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.filter(folded, lambda c: F.length(c) >= least))


def chunks(df: DataFrame, text: str = "text", shortest: int = 0, **limits) -> DataFrame:
    """One row for each chunk: ``chunk_idx`` from 0 and ``text``; other columns are repeated.

    Texts under ``shortest`` have no chunks; a filter in front would make Spark compute the texts twice."""
    others = [c for c in df.columns if c != text]
    made = F.when(long_enough(F.col(text), shortest), chunk_array(F.col(text), **limits))
    return df.select(*others, F.posexplode(made).alias("chunk_idx", text))


def seeded(seed: int, *keys: str) -> Column:
    """An order that looks shuffled and depends on the seed and the keys only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def seeded_place(df: DataFrame, keys: list[str], seed: int = SEED, name: str = "place", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds each row's place, from 1, in the seeded order of all rows, or of the rows alike in ``by``.

    Rows are counted by the order's first three hex digits; these 4,096 sums give every bucket's first
    place, and buckets are numbered side by side, so no task holds all rows."""
    marked = df.withColumn("_h", seeded(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3))
    sizes = marked.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *keys))
    return marked.join(F.broadcast(starts), [*by, "_b"]).withColumn(name, F.col("_start") + inside).drop("_h", "_b", "_start")


def held_out_split(df: DataFrame, keys: list[str], text: str = "text", per_mille: int = 5, seed: int = SEED, source: str = "source", size: Column | None = None) -> DataFrame:
    """Adds ``split``: in each source, in seeded order, chunks are held out while those before them
    hold less than the share of its characters.

    Characters are summed by source and the order's first three hex digits; that names the one bucket
    in which a source's cut lies.  Only this bucket's rows, a 4096th, are sorted; no other row moves.
    The rows are written to the shared folder once, as they are read three times, so leave out columns that
    aren't needed; ``size`` stands for the text's characters where there is no text.  The cuts, a row for each
    source, are written too, so that Spark knows whether they are small enough to go to every task.
    """
    n = (F.length(text) if size is None else size).cast("long")
    marked = SharedTable(df.withColumn("_h", seeded(seed, *keys)).withColumn("_b", F.substring("_h", 1, 3)).withColumn("_n", n), "marked").read()
    n = F.col("_n")
    sums = marked.groupBy(F.col(source).alias("_s"), "_b").agg(F.sum(n).alias("_n"))
    run = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy("_s")))
    cuts = sums.where(F.col("_before") * 1000 < F.col("_all") * per_mille).groupBy("_s").agg(F.max(F.struct("_b", "_before", "_all")).alias("_cut"))
    cuts = SharedTable(cuts, "cuts").read()
    placed = marked.join(cuts, marked[source].eqNullSafe(cuts["_s"]), "left")
    away = placed.where(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut._b"))).withColumn("split", F.when(F.col("_b") < F.col("_cut._b"), "val").otherwise("train"))
    inside = Window.partitionBy(source, "_b").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_cut._before") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    near = placed.where(F.col("_b") == F.col("_cut._b")).withColumn("split", F.when(before * 1000 < F.col("_cut._all") * per_mille, "val").otherwise("train"))
    return away.unionByName(near).drop("_h", "_b", "_n", "_s", "_cut")


def manifest(kept: DataFrame, skipped: DataFrame, source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """Counts by source and in all (source null): chunks, by split, characters, and skipped documents."""
    n, val = F.length(text) if size is None else size, F.col("split") == "val"
    counts = kept.rollup(source).agg(F.count("*").alias("chunks"), F.count_if(~val).alias("chunks_train"), F.count_if(val).alias("chunks_val"), F.sum(n).alias("characters"), F.sum(F.when(val, n).otherwise(0)).alias("characters_val"))
    short = skipped.rollup(source).agg(F.count("*").alias("skipped_too_short"))
    same = counts[source].eqNullSafe(short[source])
    joined = counts.join(short, same, "left").select(counts["*"], F.coalesce("skipped_too_short", F.lit(0)).alias("skipped_too_short"))
    return joined


def ordered_text(df: DataFrame, order: str, text: str = "text", separator: str = SEPARATOR) -> DataFrame:
    """One row: characters and SHA-256 of the split file, separators between documents included.

    For small splits; ``write_split`` writes a large one by many tasks."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    body = F.array_join(F.transform(rows, lambda r: r["t"]), separator)
    return df.agg(body.alias("b")).select(F.length("b").alias("characters"), F.sha2(F.col("b").cast("binary"), 256).alias("sha256"))


def _split_pieces(df: DataFrame, order: list[str], by: str, text: str, separator: str, folder: str) -> dict:
    """Each split's pieces in order, as (file, bytes, characters): every task writes its range of the order to
    files in ``folder``, a separator before each text. Only their names and sizes reach the driver."""
    where = shared_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, now, made = TaskContext.get().partitionId(), None, None, []
        os.makedirs(where, exist_ok=True)
        try:
            for batch in batches:
                for split, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or split != now:
                        if out is not None:
                            out.close()
                        now, path = split, f"{where}/{part}-{uuid.uuid4().hex}"
                        out = open(path, "wb")  # noqa: SIM115
                        made.append([now, part, path, 0, 0])
                    raw = (separator + body).encode()
                    out.write(raw)
                    made[-1][3] += len(raw)
                    made[-1][4] += len(separator) + len(body)
        finally:
            if out is not None:
                out.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["split", "part", "path", "bytes", "characters"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(text).isNotNull()).select(F.col(by).alias("_by"), *order, text)
    rows = rows.repartitionByRange(parts, "_by", *order).sortWithinPartitions("_by", *order).select(F.col("_by").cast("string"), text)
    pieces: dict = {}
    for r in sorted(rows.mapInArrow(write, "split string, part long, path string, bytes long, characters long").collect(), key=lambda r: r.part):
        pieces.setdefault(r.split, []).append((r.path, r.bytes, r.characters))
    return pieces


def _digests(spark: SparkSession, pieces: dict, separator: str) -> dict:
    """Characters and SHA-256 of each split: one task reads its pieces in order, READ_BYTES at a time, as SHA-256
    takes a file's bytes one after another; nothing of them reaches the driver."""
    skip = len(separator.encode())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = hashlib.sha256()
                for k, path in enumerate(paths):
                    with open(path, "rb") as file:
                        file.seek(0 if k else skip)
                        while raw := file.read(READ_BYTES):
                            made.update(raw)
                yield pa.record_batch([pa.array([split]), pa.array([made.hexdigest()])], names=["split", "sha256"])

    if not pieces:
        return {}
    listed = spark.createDataFrame([(split, [p for p, *_ in made]) for split, made in pieces.items()], "split string, paths array<string>")
    found = {r.split: r.sha256 for r in listed.mapInArrow(digest, "split string, sha256 string").collect()}
    return {split: {"characters": sum(n for *_, n in made) - len(separator), "sha256": found[split]} for split, made in pieces.items()}


def digest_splits(df: DataFrame, order: list[str], by: str = "split", text: str = "text", separator: str = SEPARATOR) -> dict:
    """Characters and SHA-256 of every split's file, separators between documents included; null texts are left out."""
    spark = df.sparkSession
    folder = new_place(spark, "split")
    try:
        return _digests(spark, _split_pieces(df, order, by, text, separator, folder), separator)
    finally:
        drop_place(spark, folder)


def write_split(df: DataFrame, order: list[str], path, text: str = "text", separator: str = SEPARATOR) -> dict:
    """Write the split in order, every task its part of the file; characters and SHA-256.  The path must be on a
    file system that all machines mount."""
    spark, skip = df.sparkSession, len(separator.encode())
    folder, target = new_place(spark, "split"), shared_path(str(path))
    staged = f"{target}.staged-{uuid.uuid4().hex}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(piece, "rb") as file, open(os.open(staged, os.O_CREAT | os.O_WRONLY, 0o644), "wb") as out:
                    file.seek(max(0, -at))
                    out.seek(max(0, at))
                    shutil.copyfileobj(file, out, READ_BYTES)
                yield pa.record_batch([pa.array([piece])], names=["path"])

    try:
        pieces = _split_pieces(df.withColumn("_all", F.lit("")), order, "_all", text, separator, folder)
        starts, at = [], -skip
        for piece, size, _ in pieces.get("", []):
            starts.append((piece, at))
            at += size
        with open(staged, "wb"):
            pass
        if starts:
            spark.createDataFrame(starts, "path string, at long").mapInArrow(copy, "path string").count()
        os.replace(staged, target)
        return _digests(spark, pieces, separator).get("", {"characters": 0, "sha256": hashlib.sha256().hexdigest()})
    finally:
        if os.path.exists(staged):
            os.remove(staged)
        drop_place(spark, folder)


def block_sample(df: DataFrame, size: Column, keys: list[str], target: int, block: int = 200, least: int = 30_000, seed: int = SEED) -> DataFrame:
    """Seeded order, whole blocks until the target bytes are reached (looked at between blocks); rows
    under ``least`` bytes are left out at the end and don't count."""
    placed = seeded_place(df.withColumn("_size", F.when(size >= least, size).otherwise(0)), keys, seed, "_place")
    ranked = placed.withColumn("_block", F.floor((F.col("_place") - 1) / block))
    before = ranked.groupBy("_block").agg(F.sum("_size").alias("_bytes"))
    before = before.withColumn("_before", F.coalesce(F.sum("_bytes").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_bytes")
    return ranked.join(before, "_block").where((F.col("_before") < target) & (F.col("_size") > 0)).drop("_size", "_place", "_before", "_block")

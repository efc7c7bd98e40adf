"""Removal of repeated byte strings by distributed prefix doubling on thinned positions.

Every 400-byte window (callers may name another length) picks the 128-byte position with the least rank inside it; equal windows pick
alike, so neighbouring windows with one pick are a run, and a run whose pick is unique is unique.  Then
Spark sorts (position, rank) pairs at growing lengths, drops what is unique and ranks the rest anew:

    round    windows told together    bytes that their rank covers
    picks    up to 273                128
    runs     up to 273                128, and the run's whole span
    1 to 4   64, 16, 4, 1             337, 385, 397, 400

A run whose whole span of bytes occurs twice is settled at once, and one copy of it goes on for others
to be held against; a run that is not settled goes on in four times smaller parts.  So rows follow the
number of places where repeats begin or end, and not the bytes.  Full suffix ranks would need every byte
as a row in every round, with the same result.

Picks are told by 64 bits, which can only keep a run open; whatever settles a run is a 128-bit name of all
its bytes, as is a text's name.  Texts are held once each, in buckets of their names, so no round sends a
text over the network; ranks that many texts share are counted before they are shuffled.

Defined results: a null text is empty; texts under 400 bytes, and empty ones, keep every byte;
matches never cross rows, and a repeated row is a match for its copy; an empty table gives an empty
result.  Where a cut leaves part of a UTF-8 character, the text output drops the rest of it, the
counts and the hash are of bytes.  Columns that aren't kept are not read; a kept column named like a
column of the result gives way to it.  A text is one value of its column, so 2 GB is its bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, mix, text_buffers
from .common import Bucketed, Stored, arrow_limits, distinct_texts, scratch, stored, text_key

#: Shortest repeated string in bytes, unless a caller names its own; at least LEAST.
LENGTH = 400
LEAST = 128
#: Windows told together in each round after the runs.
GROUPS = (64, 16, 4, 1)
#: Bytes of text ranked at a time.
BLOCK = 1 << 18
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_PLACE = U64((1 << 24) - 1)


def pick_length(length: int) -> int:
    """Bytes of a pick in a window of ``length``: a power of two, from a quarter of it to a half."""
    return 1 << (length.bit_length() - 2)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name pairs of ranks."""
    return mix(left * _A + right * _B + U64(1))


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the ``length`` bytes (a power of two from 8) at every position, by doubling."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    raw = np.empty((n + 8) // 8 * 8, U64)
    for shift in range(8):
        part = padded[shift : shift + len(raw)]
        raw[shift::8] = part[: len(part) // 8 * 8].view("<u8")[: len(raw) // 8]
    out, h = mix(raw[: max(0, n - 7)] * _A + _B), 8
    while h < length:
        out = pair(out[:-h], out[h:]) if len(out) > h else out[:0]
        h *= 2
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(np.uint64).max, U64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _blocks(offsets: np.ndarray, length: int):
    """(text rows, first byte, end, number of windows) so that a block is about BLOCK bytes; a longer
    text comes in several that overlap by a window less a byte."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        size = offsets[row + 1] - offsets[row]
        if size > 2 * BLOCK:
            for at in range(offsets[row], offsets[row + 1] - length + 1, BLOCK):
                yield row, row + 1, at, min(at + BLOCK + length - 1, offsets[row + 1])
            row += 1
            continue
        end = row + 1
        while end < rows and offsets[end + 1] - offsets[row] <= BLOCK:
            end += 1
        yield row, end, offsets[row], offsets[end]
        row = end


def picks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Runs of windows with one pick: (row, first and last window, pick, rank of the pick)."""
    out = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, U64)]]
    for first_row, end_row, lo, hi in _blocks(offsets, length):
        if hi - lo < length:
            continue
        rank = ranks(data[lo:hi], pick_length(length))
        least = sliding_least((rank & ~_PLACE) | np.arange(len(rank), dtype=U64), length - pick_length(length) + 1)
        at = (least & _PLACE).astype(np.int64)
        edges = np.clip(offsets[first_row : end_row + 1], lo, hi) - lo
        place = np.arange(len(at))
        row = np.searchsorted(edges, place, side="right") - 1
        fits = place + length <= edges[row + 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
        start = np.flatnonzero(new & fits)
        if not len(start):
            continue
        stop = np.append(np.flatnonzero(new)[1:], len(at))[np.searchsorted(np.flatnonzero(new), start)]
        usable = np.cumsum(fits)
        last = start + (usable[stop - 1] - usable[start])
        shift = lo - offsets[first_row + row[start]]
        out.append([first_row + row[start], start + shift, last + shift, at[start] + shift, rank[at[start]]])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def whole_runs(body: memoryview, first, last, at, length: int = LENGTH):
    """Runs as they are: (run, first, last, rank of the pick, rank of the span)."""
    shared = [xxhash.xxh3_128_digest(body[a : a + pick_length(length)]) for a in at.tolist()]
    return np.arange(len(first)), first, last, shared, _spans(body, first, last, at, length)


def parts(body: memoryview, first, last, at, group: int, length: int = LENGTH):
    """Runs in parts of ``group`` windows, counted from the pick: (run, first, last, rank of the bytes
    that all windows of such a part hold, rank of the span)."""
    low, high = (at - last) // group, (at - first) // group
    run = np.repeat(np.arange(len(first)), high - low + 1)
    j = low[run] + np.arange(len(run)) - np.searchsorted(run, run)
    core = at[run] - group * j
    start, stop = np.maximum(first[run], core - group + 1), np.minimum(last[run], core)
    size = length - group + 1
    shared = [xxhash.xxh3_128_digest(body[a : a + size], seed=i) for a, i in zip(core.tolist(), (j + length).tolist(), strict=True)]
    return run, start, stop, shared, shared if group == 1 else _spans(body, start, stop, at[run], length)


def _spans(body: memoryview, first, last, at, length: int) -> list[bytes]:
    """Names of all bytes of runs, and of where the pick lies in them."""
    places = zip(first.tolist(), (last + length).tolist(), (at - first + length).tolist(), strict=True)
    return [xxhash.xxh3_128_digest(body[a:b], seed=i) for a, b, i in places]


def covered(spans: list[tuple[int, int]], size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes under windows that start in the spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        end = min(b + length, size)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((a, end))
    return out


def _picked(texts: Bucketed, length: int) -> DataFrame:
    """tkey, first, last, at, asks: the runs whose pick occurs at least twice.  Texts with copies are held
    against others only."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, last, at, rank = picks(*text_buffers(batch.column(1)), length)
            place = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), pa.array(first), pa.array(last), pa.array(at), batch.column(2).take(place), pa.array(rank.view(np.int64))], names=["tkey", "first", "last", "at", "asks", "rank"])

    rows = texts.read().select("tkey", "text", (F.col("copies") == 1).alias("asks"))
    every = Stored(rows.mapInArrow(pick, "tkey binary, first long, last long, at long, asks boolean, rank long"), "picks")
    # Stored, so that Spark can split a rank that many rows hold.
    twice = stored(every.read().groupBy("rank").count().where("count > 1").select("rank"), "repeated-ranks")
    kept = stored(every.read().join(twice, "rank", "left_semi").drop("rank"), "repeated-picks")
    every.drop()
    return kept


_RUN = "tkey binary, first long, last long, at long, asks boolean, rank binary, span binary"


def _ranked(texts: Bucketed, runs: DataFrame, make) -> DataFrame:
    """The next round's rows, made where the texts are."""
    by_text = runs.groupBy("tkey").agg(F.collect_list(F.struct("first", "last", "at", "asks")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = lists[i].values
                first, last, at = (np.asarray(own.field(k), np.int64) for k in range(3))
                run, start, stop, rank, span = make(memoryview(batch.column(1)[i].as_buffer()), first, last, at)
                place = pa.array(run)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(run), pa.binary()), pa.array(start), pa.array(stop), own.field(2).take(place), own.field(3).take(place), pa.array(rank, pa.binary()), pa.array(span, pa.binary())], names=["tkey", "first", "last", "at", "asks", "rank", "span"])

    return texts.read().select("tkey", "text").join(by_text.hint("shuffle_hash"), "tkey").select("tkey", "text", "runs").mapInArrow(rows, _RUN)


def _settle(rows: DataFrame, name: str) -> tuple[DataFrame, Stored]:
    """(runs whose windows all occur twice, runs still open and the copies to hold them against)."""
    runs = Stored(rows, name)
    spans = stored(runs.read().groupBy("rank", "span").agg(F.count("*").alias("n"), F.max("asks").alias("asked"), F.min(F.struct("tkey", "first")).alias("copy")), f"{name}-spans")
    alone = F.col("n") == 1
    kinds = stored(spans.groupBy("rank").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max(F.col("asked") & alone).alias("open")).where("total > 1"), f"{name}-ranks")
    known = spans.join(kinds, "rank").where("open OR (asked AND n > 1)").select("rank", "span", "n", "copy", (F.col("open") & (F.col("kinds") > 1)).alias("goes_on"))
    held = stored(runs.read().join(known, ["rank", "span"]), f"{name}-held")
    runs.drop()
    left = held.where(F.col("goes_on") & (alone | (F.struct("tkey", "first") == F.col("copy"))))
    return held.where("asks AND n > 1").select("tkey", "first", "last"), left.select("tkey", "first", "last", "at", (F.col("asks") & alone).alias("asks"))


def repeated_windows(texts: Bucketed, length: int = LENGTH) -> DataFrame:
    """tkey, first, last: windows that occur elsewhere too, of texts without copies."""
    settled, left = _settle(_ranked(texts, _picked(texts, length), lambda *run: whole_runs(*run, length)), "runs")
    for group in GROUPS:
        more, left = _settle(_ranked(texts, left, lambda body, first, last, at, group=group: parts(body, first, last, at, group, length)), f"parts-of-{group}")
        settled = settled.unionAll(more)
    return settled


def _cut(texts: Bucketed, windows: DataFrame, with_text: bool, length: int) -> DataFrame:
    """_tkey, removed, spans, sha256, kept of every text that loses bytes but isn't repeated whole."""
    marks = windows.groupBy("tkey").agg(F.collect_list(F.struct("first", "last")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, marked in zip(*batch.columns, strict=True):
                body = text.as_py().encode()
                runs = covered(list(zip(marked.values.field(0).to_pylist(), marked.values.field(1).to_pylist(), strict=True)), len(body), length)
                edges = [0, *(x for run in runs for x in run), len(body)]
                left = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((key.as_py(), len(body) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if with_text else None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["_tkey", "removed", "spans", "sha256", "kept"])

    marked = texts.read().select("tkey", "text").join(marks.hint("shuffle_hash"), "tkey").select("tkey", "text", "marks")
    return marked.mapInArrow(cut, "_tkey binary, removed long, spans long, sha256 string, kept string")


def _lost(texts: Bucketed, with_text: bool, length: int) -> DataFrame:
    """_tkey, removed, spans, sha256, kept, whole of every text that loses bytes."""
    cut = _cut(texts, repeated_windows(texts, length), with_text, length).withColumn("whole", F.lit(False))
    none = F.lit(None).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256().hexdigest()).alias("sha256")
    return cut.unionAll(texts.read().where("copies > 1").select(F.col("tkey").alias("_tkey"), *none, F.lit("").alias("kept"), F.lit(True).alias("whole")))


def remove_repeats(df: DataFrame, text: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, length: int = LENGTH) -> DataFrame:
    """The columns ``keep``, then n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept_text.
    Strings of ``length`` bytes that occur more than once go."""
    if length < LEAST:
        raise ValueError(f"strings of {length} bytes are shorter than {LEAST}")
    arrow_limits(df.sparkSession)
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text]
    raw = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(k) for k in keep if k not in own]
    rows = df.select(F.struct(*(keep or [F.lit(0).alias("_")])).alias("_row"), raw.alias("_text"), text_key(raw).alias("_tkey"))
    with scratch():
        lost = stored(_lost(distinct_texts(rows, "_text", length), with_text, length), "lost", lasting=True)
    rows = rows.select("_row", "_tkey", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("own_sha256"), *["_text"] * with_text)
    done = rows.join(lost, "_tkey", "left")
    done = done.withColumn("n_removed", F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0)).cast("long")))
    done = done.withColumn("n_spans", F.coalesce("spans", F.lit(0)).cast("long")).withColumn("kept_sha256", F.coalesce("sha256", "own_sha256"))
    if with_text:
        done = done.withColumn("kept_text", F.coalesce("kept", "_text"))
    return done.select(*["_row.*"] * bool(keep), *own)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))

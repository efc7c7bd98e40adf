"""A flat file of 16-bit token ids as a Spark data source, written and read in ranges by many tasks.

``df.write.format("token_file")`` takes rows (start, ids): every task writes its ids at their place in a staged
file, and the driver, once all are done, checks that the ranges fill the file and renames it; a task that is
run again writes the same bytes to the same place, and a job that fails leaves nothing.  Only ranges reach
the driver.  ``spark.read.format("token_file")`` gives windows (window_id, input, target); a task maps the part
of the file that its windows need.  The path must be on a file system that all machines mount.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.shared import shared_path
from ..operators.windows import check_length

BYTES = 2
#: Bytes of the file that a task reads at least, and windows in a batch.
READ_BYTES, BATCH_WINDOWS = 16 << 20, 1024
#: Ids of windows anywhere in a file that are cut at a time.
CUT_IDS = 1 << 19


class TokenFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_file"

    def schema(self) -> str:
        return "window_id long, input array<int>, target array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Windows(shared_path(self.options["path"]), int(self.options["length"]), int(self.options.get("readbytes", READ_BYTES)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Ranges(shared_path(self.options["path"]), overwrite)


@dataclass
class _Range(InputPartition):
    first: int
    last: int


class _Windows(DataSourceReader):
    def __init__(self, path: str, length: int, read_bytes: int) -> None:
        self.path, self.length = path, length
        tokens = os.path.getsize(path) // BYTES
        check_length(tokens, length)
        self.count, self.each = (tokens - 1) // length, max(1, read_bytes // (BYTES * length))

    def partitions(self) -> list[_Range]:
        return [_Range(k, min(k + self.each, self.count)) for k in range(0, self.count, self.each)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        n, tokens = self.length, np.memmap(self.path, "<u2", "r")
        for first in range(part.first, part.last, BATCH_WINDOWS):
            last = min(first + BATCH_WINDOWS, part.last)
            ids = np.asarray(tokens[first * n : last * n + 1], np.int32)
            edges = pa.array(np.arange(last - first + 1, dtype=np.int32) * n)
            yield pa.record_batch([pa.array(np.arange(first, last)), pa.ListArray.from_arrays(edges, pa.array(ids[:-1])), pa.ListArray.from_arrays(edges, pa.array(ids[1:]))], names=["window_id", "input", "target"])


@dataclass
class _Written(WriterCommitMessage):
    ranges: list[tuple[int, int]]


class _Ranges(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        if not overwrite and os.path.exists(path):
            raise ValueError(f"{path} is there; only mode overwrite replaces it")
        self.path, self.staged = path, f"{path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        ranges: list[tuple[int, int]] = []
        file = os.open(self.staged, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for batch in iterator:
                lists = batch.column("ids")
                for start, size, row in zip(batch.column("start").to_pylist(), lists.value_lengths().to_pylist(), lists, strict=True):
                    if not size:
                        continue
                    ids = row.values.to_numpy(zero_copy_only=False)
                    if ids.min() < 0 or ids.max() > 65_535:
                        raise ValueError("an id does not fit 16 bits")
                    raw, at = memoryview(ids.astype("<u2").tobytes()), BYTES * start
                    while raw:
                        done = os.pwrite(file, raw, at)
                        raw, at = raw[done:], at + done
                    if ranges and ranges[-1][1] == start:
                        ranges[-1] = (ranges[-1][0], start + size)
                    else:
                        ranges.append((start, start + size))
            os.fsync(file)
        finally:
            os.close(file)
        return _Written(ranges)

    def commit(self, messages) -> None:
        at = 0
        for first, end in sorted(r for m in messages if m is not None for r in m.ranges):
            if first != at:
                self.abort(messages)
                raise ValueError(f"tokens {min(at, first)} to {max(at, first)} are missing or written twice")
            at = end
        with open(self.staged, "ab") as file:
            file.truncate(BYTES * at)
        os.replace(self.staged, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.staged):
            os.remove(self.staged)


def write_token_file(rows: DataFrame, path: str) -> None:
    """Rows (start, ids) that fill a stream, as a flat file; an id beyond 16 bits is an error."""
    rows.sparkSession.dataSource.register(TokenFile)
    rows.select("start", "ids").write.format("token_file").mode("overwrite").save(path)


def read_token_windows(spark: SparkSession, path: str, length: int, **options) -> DataFrame:
    spark.dataSource.register(TokenFile)
    return spark.read.format("token_file").option("length", length).options(**options).load(path)


def windows_at(offsets: DataFrame, path: str, length: int) -> DataFrame:
    """window_id, offset, input, target for rows (window_id, offset): windows anywhere in the file."""
    where = shared_path(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = np.memmap(where, "<u2", "r")
        each = max(1, CUT_IDS // (length + 1))
        for batch in (b.slice(k, each) for b in batches for k in range(0, len(b), each)):
            at = batch.column(1).to_numpy()[:, None] + np.arange(length + 1)
            ids = np.asarray(tokens[at], np.int32)
            edges = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * length)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(edges, pa.array(ids[:, :-1].ravel())), pa.ListArray.from_arrays(edges, pa.array(ids[:, 1:].ravel()))], names=["window_id", "offset", "input", "target"])

    return offsets.select("window_id", "offset").mapInArrow(cut, "window_id long, offset long, input array<int>, target array<int>")

"""Zip archives as a Spark data source: members are planned from the central directory and read in ranges.

The driver reads only directories; each task opens an archive, seeks to its members and inflates them one at
a time, so one large archive is read by many tasks and no task holds an archive.  Filters on the member's name
are taken over when the plan is made, so members that they refuse are never read.  Paths (a file, or a glob)
must be on a file system that all machines mount.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import os
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..operators.shared import shared_path

#: Compressed bytes of the members that one task reads, and bytes in a batch.
TASK_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "source_path string, position long, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        given = self.options
        return _Members(shared_path(given["path"]), json.loads(given.get("patterns", '["*"]')), json.loads(given.get("skip", "[]")), int(given.get("taskbytes", TASK_BYTES)))


@dataclass
class _Part(InputPartition):
    path: str
    members: list[tuple[int, str]]


class _Members(DataSourceReader):
    def __init__(self, path: str, patterns: list[str], skip: list[str], task_bytes: int) -> None:
        self.path, self.patterns, self.skip, self.task_bytes = path, patterns, skip, task_bytes
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("name",):
                self.wanted.append(f)
            else:
                yield f

    def _takes(self, name: str) -> bool:
        tests = {EqualTo: lambda f: name == f.value, In: lambda f: name in f.value, StringStartsWith: lambda f: name.startswith(f.value), StringEndsWith: lambda f: name.endswith(f.value)}
        return all(tests[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[_Part]:
        out = []
        for path in sorted(glob.glob(self.path)) or [self.path]:
            with zipfile.ZipFile(path) as archive:
                sizes = {m.filename: m.compress_size for m in archive.infolist() if not m.is_dir() and os.path.basename(m.filename) not in self.skip}
            chosen = enumerate(m for p in self.patterns for m in sorted(sizes) if fnmatch.fnmatchcase(m, p))
            part, held = [], 0
            for position, name in chosen:
                if not self._takes(name):
                    continue
                if part and held + sizes[name] > self.task_bytes:
                    out.append(_Part(path, part))
                    part, held = [], 0
                part.append((position, name))
                held += sizes[name]
            if part:
                out.append(_Part(path, part))
        return out

    def read(self, part: _Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing was planned
            return
        names = ["source_path", "position", "name", "content"]
        with zipfile.ZipFile(part.path) as archive:
            rows, held = [], 0
            for position, name in part.members:
                rows.append((part.path, position, name, archive.read(name)))
                held += len(rows[-1][3])
                if held >= BATCH_BYTES:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)


TYPES = [pa.string(), pa.int64(), pa.string(), pa.binary()]


def archive_members(spark: SparkSession, path: str, patterns: list[str] = ("*",), skip_names: list[str] = (), task_bytes: int = TASK_BYTES) -> DataFrame:
    """source_path, position, name, content of zip members: for each pattern in order the members that
    match, sorted; folders and skipped base names are left out."""
    spark.dataSource.register(Archives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive_members").options(patterns=json.dumps(list(patterns)), skip=json.dumps(list(skip_names)), taskBytes=task_bytes).load(path)


def write_archives(rows: DataFrame, folder: str) -> int:
    """Rows (name, content) as deflated archives in ``folder``, one from each partition; how many members.

    An archive is written beside its place and renamed, so a task that is run again replaces it whole."""
    where = shared_path(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(where, exist_ok=True)
        task = TaskContext.get()
        path, written = f"{where}/part-{task.partitionId():05d}.zip", 0
        staged = f"{path}.{task.taskAttemptId()}"
        with zipfile.ZipFile(staged, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    archive.writestr(name, content.as_py())
                    written += 1
        os.replace(staged, path)
        yield pa.record_batch([pa.array([written], pa.int64())], names=["n"])

    return rows.select("name", "content").mapInArrow(write, "n long").groupBy().sum("n").first()[0]

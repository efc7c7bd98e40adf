"""Conversations and switches as streams with keyed state: what is kept for a key doesn't grow with its history."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nlargest
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shared import new_place

#: Keys that nobody wrote to for so long are forgotten.
IDLE_MS = 30 * 24 * 3600 * 1000
#: State in RocksDB, which keyed state needs; and no batches without rows, as a time to live asks for one
#: after another and a bounded run would never end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class RecentTurns(StatefulProcessor):
    """The lowest turn, the count, and the ``most`` + 1 highest turns of a conversation."""

    TURN = "turn long, role string, content string"

    def __init__(self, most: int, idle_ms: int) -> None:
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", f"{self.TURN}, seen long", self.idle_ms)
        self.recent = handle.getListState("recent", self.TURN, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, seen = None, 0
        if self.first.exists():
            *first, seen = self.first.get()
            first = tuple(first)
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        order = lambda r: (r[0], r[1] or "", r[2] or "")
        for part in rows:
            new = [(int(t), None if pd.isna(r) else r, None if pd.isna(c) else c) for t, r, c in zip(part["turn"], part["role"], part["content"], strict=True)]
            if new:
                seen += len(new)
                first = min([first, *new] if first else new, key=order)
                recent = nlargest(self.most + 1, recent + new, key=order)
        recent.sort(key=order)
        if first is None:
            return
        self.first.update((*first, seen))
        self.recent.put(recent)
        kept = self._kept(first, seen, recent)
        yield pd.DataFrame([(key[0], seen, *r) for r in kept or [(None, None, None)]], columns=["conv_id", "seen", "turn", "role", "content"]).astype({"turn": "Int64"})

    def _kept(self, first: tuple, seen: int, recent: list[tuple]) -> list[tuple]:
        pinned = first[1] == "system"
        others = recent[1:] if pinned and seen <= len(recent) else recent
        rest = seen - pinned
        last = others[max(0, len(others) - self.most) :]
        if rest > self.most:
            while last and last[0][1] in ("tool", None):
                last = last[1:]
        return [first, *last] if pinned else last

    def close(self) -> None:
        pass


class Switches(StatefulProcessor):
    """Whether a switch is on, and the last place that was judged."""

    def __init__(self, start_at: float, stop_at: float, idle_ms: int) -> None:
        self.start_at, self.stop_at, self.idle_ms = start_at, stop_at, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("switch", "running boolean, micros long, id long", self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        running, *judged = self.state.get() if self.state.exists() else (False, -(2**63), -(2**63))
        ordered = pd.concat(list(rows)).sort_values(["micros", "id"], kind="stable")
        late = (ordered["micros"] < judged[0]) | ((ordered["micros"] == judged[0]) & (ordered["id"] < judged[1]))
        use = ordered[~late]
        said = pd.Series(float("nan"), use.index, dtype=float)
        said[use["value"] >= self.start_at], said[use["value"] < self.stop_at] = 1.0, 0.0
        on = said.reset_index(drop=True).ffill().fillna(float(running)) == 1.0
        if len(use):
            self.state.update((bool(on.iloc[-1]), int(use["micros"].iloc[-1]), int(use["id"].iloc[-1])))
        yield pd.DataFrame({"key": key[0], "id": use["id"].to_numpy(), "running": on.to_numpy(), "late": False})
        if late.any():
            yield pd.DataFrame({"key": key[0], "id": ordered["id"][late].to_numpy(), "running": running, "late": True})

    def close(self) -> None:
        pass


def trimmed_sessions(turns: DataFrame, most: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of conv_id, turn, role, content to conv_id, seen, turn, role, content: after each batch, the
    window that ``chat.trim`` would keep of the ``seen`` turns so far of each conversation written to.

    Turns may come in any order.  A conversation's state is ``most`` + 2 turns, however long it is; rows
    without a conv_id or a turn are left out.  The rows of the highest ``seen`` are the present window; an
    empty one is a row without a turn."""
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "content")
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, seen long, {RecentTurns.TURN}"
    return rows.groupBy("conv_id").transformWithStateInPandas(RecentTurns(most, idle_ms), out, "Append", "ProcessingTime")


def switched(events: DataFrame, key: str, ts: str, id_: str, value: str, start_at: float, stop_at: float, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream to key, id, running, late: on at ``start_at`` or more, off below ``stop_at``, else as before.

    A batch's rows are judged by time, then id; a null value changes nothing.  A row that comes behind later
    ones of an earlier batch is ``late``: it changes nothing and gets what its key says before this batch.
    A key's state is one row; its rows of one batch are held, which the source's bytes for each trigger bound.
    Rows without a key, time or id are left out."""
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(id_).cast("long").alias("id"), F.col(value).cast("double").alias("value")).where("key IS NOT NULL AND micros IS NOT NULL AND id IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(Switches(start_at, stop_at, idle_ms), f"key {kind}, id long, running boolean, late boolean", "Append", "ProcessingTime")


def latest_windows(windows: DataFrame) -> DataFrame:
    """Of each conversation the rows of its highest ``seen``."""
    newest = windows.groupBy("conv_id").agg(F.max("seen").alias("seen"))
    return windows.join(newest, ["conv_id", "seen"], "left_semi").where("turn IS NOT NULL")


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, write its rows to the shared folder and read them."""
    spark = stream.sparkSession
    place = new_place(spark, name)
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/progress").outputMode("append").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")

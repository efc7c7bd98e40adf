"""Byte-level BPE training over any number of distinct pre-tokens.

Merges follow one another, but most of them don't touch one another, so many go in one Spark job:

1. The driver holds the exact count of every pair that is left (first of all byte pairs, then what merges
   changed), in a heap with lazy deletion, and the HEAD_WORDS most frequent pre-tokens.
2. It foretells the next merges by merging its head, with exact counts for pairs that haven't changed and
   the head's changes, scaled to the whole, for those that have.
3. One job applies the merges so far and the foretold ones to all pre-tokens, and sums by merge how it
   changes each pair's count.
4. The driver replays them: while the best pair by exact counts is among the foretold, in whatever order, and
   its changes hold in the state reached, it is taken with them.  The first best pair that isn't ends the round,
   and what was foretold beyond it is dropped.

So every merge is the one that a loop over all pre-tokens would choose, at any size; a poor prophecy costs
rounds, never the result.  No pre-tokens but the head reach the driver, and what comes back follows the pairs
that merges touch.  Executors hold a partition's pre-tokens as linked lists in arrays, with positions by pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedTable

#: Pre-tokens that the driver foretells with, at most; of up to so many bytes each, and together.
HEAD_WORDS, HEAD_LONGEST, HEAD_BYTES = 500_000, 64, 4 << 20
#: Merges foretold at once: at first and at most; merges after which pre-tokens are written anew.
FIRST, MOST, REWRITE = 32, 1024, 1536
#: Bytes of pre-tokens in a partition, at most and (unless there are fewer cores) at least.
PART_BYTES, LEAST_BYTES = 4 << 20, 100_000
_BITS = 24


def code(left, right):
    """A pair as one number, in the order of pairs."""
    return (left << _BITS) | right


def pair(value: int) -> tuple[int, int]:
    return value >> _BITS, value & ((1 << _BITS) - 1)


class Words:
    """Weighted id lists that merges run over: ids, neighbours and weights by position, positions by pair."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        self.ids = ids.astype(np.int32)
        self.word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.weights = weights.astype(np.int64)
        n = len(ids)
        self.next = np.arange(1, n + 1, dtype=np.int32)
        self.prev = np.arange(-1, n - 1, dtype=np.int32)
        last = np.cumsum(lengths)[lengths > 0] - 1
        self.next[last] = -1
        self.prev[np.concatenate([[0], last[:-1] + 1])[: len(last)]] = -1
        at = np.flatnonzero(self.next >= 0).astype(np.int32)
        codes = self._codes(at)
        order = np.argsort(codes, kind="stable")
        self.first_codes, self.first_at = codes[order], at[order]
        self.later: dict[int, list[np.ndarray]] = {}

    def _codes(self, at: np.ndarray) -> np.ndarray:
        return code(self.ids[at].astype(np.int64), self.ids[self.next[at]])

    def _weight(self, at: np.ndarray) -> np.ndarray:
        return self.weights[self.word[at]]

    def _places(self, value: int) -> np.ndarray:
        """Live positions of a pair, in order."""
        a, b = np.searchsorted(self.first_codes, (value, value + 1))
        found = [self.first_at[a:b], *self.later.pop(value, ())]
        at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        left, right = pair(value)
        at = at[self.ids[at] == left]
        following = self.next[at]
        return at[(following >= 0) & (self.ids[following] == right)]

    def merge(self, value: int, new: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Replace the pair from left to right without overlaps; the codes whose counts change and by how much,
        or, if not counted, the codes that may be new."""
        at = self._places(value)
        left, right = pair(value)
        if left == right and len(at) > 1:
            chained = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
            starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - starts) % 2 == 0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gone = self.next[at]
        before = self._touching(np.concatenate([self.prev[at], at, gone])) if counted else None
        after = self.next[gone]
        self.ids[at], self.ids[gone] = new, -1
        self.next[at] = after
        self.prev[after[after >= 0]] = at[after >= 0]
        touched = np.concatenate([self.prev[at], at])
        touched = np.unique(touched[touched >= 0])
        touched = touched[self.next[touched] >= 0]
        codes = self._codes(touched)
        order = np.argsort(codes, kind="stable")
        codes, touched = codes[order], touched[order]
        edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(codes)]):
            self.later.setdefault(int(codes[start]), []).append(np.sort(touched[start:end]))
        if not counted:
            return codes[edges], edges
        return _summed(np.concatenate([before[0], codes]), np.concatenate([-before[1], self._weight(touched)]))

    def _touching(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.unique(at[at >= 0])
        at = at[self.next[at] >= 0]
        return self._codes(at), self._weight(at)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """ids that are left, and each list's length."""
        live = self.ids >= 0
        return self.ids[live], np.bincount(self.word[live], minlength=len(self.weights))


def _summed(codes: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, by = codes[order], by[order]
    edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    sums = np.add.reduceat(by, edges) if len(codes) else by
    return codes[edges][sums != 0], sums[sums != 0]


def encode_lists(words: Words, pairs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All lists merged by rank, lowest first; ``pairs``: codes in order, with the rank of each.

    A merge makes only pairs of higher ranks, so one pass over the ranks that occur does for all lists."""

    def ranked(codes: np.ndarray) -> list[int]:
        at = np.searchsorted(pairs, codes)
        at[at == len(pairs)] = 0
        return ranks[at[pairs[at] == codes]].tolist() if len(pairs) else []

    by_rank = np.empty(len(pairs), np.int64)
    by_rank[ranks] = pairs
    queue = ranked(np.unique(words.first_codes))
    heapq.heapify(queue)
    done = -1
    while queue:
        rank = heapq.heappop(queue)
        if rank == done:
            continue
        done = rank
        for r in ranked(words.merge(int(by_rank[rank]), 256 + rank, counted=False)[0]):
            heapq.heappush(queue, r)
    return words.packed()


class Counts:
    """Exact pair counts, the best pair first; the heap's old entries are passed over."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = counts
        self.heap = [(-n, -c) for c, n in counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int] | None:
        """(code, count) of the most frequent pair, of equals the one with the largest ids."""
        while self.heap:
            n, c = self.heap[0]
            if self.counts.get(-c, 0) == -n and n:
                return -c, -n
            heapq.heappop(self.heap)
        return None

    def change(self, codes: list[int], by: list[int]) -> None:
        for c, d in zip(codes, by, strict=True):
            if n := self.counts.get(c, 0) + d:
                self.counts[c] = n
                heapq.heappush(self.heap, (-n, -c))
            else:
                self.counts.pop(c, None)


class _Foretold(Counts):
    """A view of the counts that a prophecy changes."""

    def __init__(self, exact: Counts) -> None:
        self.exact, self.own, self.heap = exact.counts, {}, exact.heap.copy()
        self.counts = self

    def get(self, c: int, none: int = 0) -> int:
        return self.own[c] if c in self.own else self.exact.get(c, none)

    def change(self, codes: list[int], by: list[int]) -> None:
        for c, d in zip(codes, by, strict=True):
            self.own[c] = n = max(0, self.get(c) + d)
            if n:
                heapq.heappush(self.heap, (-n, -c))


def foretell(head: Words, exact: Counts, new: int, most: int) -> list[int]:
    """The next merges, as the head's pre-tokens have it."""
    view, out = _Foretold(exact), []
    while len(out) < most and (best := view.best()) is not None and best[1] >= 2:
        value, n = best
        codes, by = head.merge(value, new + len(out))
        own = -by[codes == value].sum()
        if own and own != n:
            by = np.rint(by * (n / own)).astype(np.int64)
        view.change(codes.tolist(), by.tolist())
        view.own[value] = 0
        out.append(value)
    return out


def _lists(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = [b for b in batches if len(b)]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = pa.Table.from_batches(held).combine_chunks()
    ids = t.column(0).chunk(0)
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids.flatten().to_numpy(zero_copy_only=False), lengths, t.column(1).to_numpy()


def _changes(words: DataFrame, done: list[int], foretold: list[int], new: int) -> DataFrame:
    """step, code, by: how each foretold merge changes the counts, over all pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(*_lists(batches))
        for k, value in enumerate(done):
            own.merge(value, new - len(done) + k, counted=False)
        steps, codes, sums = [], [], []
        for k, value in enumerate(foretold):
            c, d = own.merge(value, new + k)
            steps.append(np.full(len(c), k, np.int32))
            codes.append(c)
            sums.append(d)
        yield pa.record_batch([pa.array(np.concatenate(steps)), pa.array(np.concatenate(codes)), pa.array(np.concatenate(sums))], names=["step", "code", "by"])

    made = words.mapInArrow(run, "step int, code long, by long")
    return made.groupBy("step", "code").agg(F.sum("by").alias("by"))


def _merged(words: DataFrame, done: list[int], first: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, weights = _lists(batches)
        own = Words(ids, lengths, weights)
        for k, value in enumerate(done):
            own.merge(value, first + k, counted=False)
        ids, lengths = own.packed()
        # Lists of one id change no more.
        left = lengths > 1
        ids = ids[np.repeat(left, lengths)]
        edges = np.concatenate([[0], np.cumsum(lengths[left])]).astype(np.int32)
        yield pa.record_batch([pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))), pa.array(weights[left])], names=["ids", "freq"])

    return words.mapInArrow(run, "ids array<int>, freq long")


def _replayed(exact: Counts, foretold: list[int], changes: pa.Table, new: int) -> list[int]:
    """The foretold merges that are the next ones by exact counts, in their true order; ``exact`` follows.

    A step's changes were counted after all steps foretold before it.  They hold without those not taken so far
    if they name none of their ids (no occurrence is beside one of theirs) and the step's own count is the exact
    one (none of theirs took an occurrence away); then those steps' changes hold after this one, too."""
    first = changes["step"].to_numpy()
    order = np.argsort(first, kind="stable")
    codes, by = changes["code"].to_numpy()[order], changes["by"].to_numpy()[order]
    edges = np.searchsorted(first[order], np.arange(len(foretold) + 1))
    # ids below ``new`` keep their name, a foretold id has one once its merge is taken.
    name = np.concatenate([np.arange(new), np.full(len(foretold), -1)])
    ready, later = {}, {}
    for k, value in enumerate(foretold):
        if needed := [i - new for i in pair(value) if i >= new]:
            later.setdefault(max(needed), []).append(k)
        else:
            ready[value] = k
    taken: list[int] = []
    while (best := exact.best()) is not None and best[1] >= 2 and (k := ready.pop(best[0], None)) is not None:
        name[new + k] = new + len(taken)
        left, right = name[codes[edges[k] : edges[k + 1]] >> _BITS], name[codes[edges[k] : edges[k + 1]] & ((1 << _BITS) - 1)]
        own = code(left, right)
        if (left < 0).any() or (right < 0).any() or -by[edges[k] : edges[k + 1]][own == best[0]].sum() != best[1]:
            break
        taken.append(best[0])
        exact.change(own.tolist(), by[edges[k] : edges[k + 1]].tolist())
        waiting = later.pop(k, [])
        for j in waiting:
            left, right = (int(name[i]) for i in pair(foretold[j]))
            if left < 0 or right < 0:
                later.setdefault(next(i - new for i in pair(foretold[j]) if name[i] < 0), []).append(j)
            else:
                ready[code(left, right)] = j
    return taken


def _head(words: DataFrame, most: int) -> DataFrame:
    """The most frequent pre-tokens, whole sixteenths of an octave of frequency, within the bounds."""
    short = words.where(F.size("ids") <= HEAD_LONGEST).withColumn("level", F.floor(F.log2("freq") * 16))
    levels = short.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("bytes")).collect()
    lowest, n, size = None, 0, 0
    for row in sorted(levels, reverse=True):
        n, size = n + row.n, size + row.bytes
        if n > most or size > HEAD_BYTES:
            break
        lowest = row.level
    return short.where(F.lit(False) if lowest is None else F.col("level") >= lowest).select("ids", "freq")


def learn_merges(words: DataFrame, merges: int, head_words: int = HEAD_WORDS) -> list[tuple[int, int]]:
    """The first ``merges`` merges over rows (ids, freq) of distinct pre-tokens, or as many as there are while a
    pair occurs twice.

    Rows that are null or of one id take no part; the result doesn't depend on ``head_words``."""
    spark = words.sparkSession
    counted = SharedTable(words.select("ids", "freq").where(F.size("ids") > 1), "words")
    total = counted.read().agg(F.sum(F.size("ids"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES), min(spark.sparkContext.defaultParallelism, total // LEAST_BYTES))
    table = SharedTable(counted.read().repartition(int(parts)), "words")
    counted.drop()
    pairs = F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("a"), F.slice("ids", 2, F.size("ids") - 1).alias("b"))
    byte_pairs = table.read().select("freq", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))
    exact = Counts({code(r.a, r.b): r.n for r in byte_pairs.collect()})
    head = _lists(iter(_head(table.read(), head_words).toArrow().to_batches()))
    out: list[int] = []
    base, ahead = 0, FIRST
    while len(out) < merges:
        new = 256 + len(out)
        sought = Words(*head)
        foretold = foretell(sought, exact, new, min(ahead, merges - len(out)))
        if not foretold:
            break
        changes = _changes(table.read(), out[base:], foretold, new).toArrow().combine_chunks()
        taken = _replayed(exact, foretold, changes, new)
        out += taken
        if taken != foretold:
            sought = Words(*head)
            for k, value in enumerate(taken):
                sought.merge(value, new + k, counted=False)
        head = (*sought.packed(), head[2])
        ahead = min(MOST, 2 * ahead) if 4 * len(taken) >= 3 * len(foretold) else max(FIRST, 2 * len(taken))
        if len(out) - base >= REWRITE and len(out) < merges:
            old, table = table, SharedTable(_merged(table.read(), out[base:], 256 + base), "words")
            old.drop()
            base = len(out)
    table.drop()
    return [pair(value) for value in out]

"""Jaccard join on word n-grams: rare-first prefixes, length, positional and suffix filters, one
verification for each pair, and the components of the links.

Texts become sets of 64-bit names of their n-grams.  Sets are sorted by how common an n-gram is, then
by name; two sets that link share an n-gram in their prefixes.  How common: document counts of
n-grams that some task meets at least twice, the HOT most common of them; others count as rare.
The order decides the work only, never the links.

Prefixes are shuffled once, by n-gram, in blocks of columns of some eleven bytes an n-gram; only n-grams
that several sets have go on.  N-grams counted KNOWN times or more are known to, and skip that shuffle,
so a block bucket holds no hot n-gram.

Links are found in rounds.  In a star round each set that has an n-gram of more than FEW sets meets one
leader of another component for every such n-gram, and the leader that shares most is verified, so a
large group of near copies costs as many pairs as it has members.  The last round takes every pair of
sets that share a prefix n-gram, pass the filters and still lie in different components.  So no link
between components is lost, and pairs inside a component are never spelled out.

N-grams are equal if their 64-bit names are: in a pair of sets of a thousand n-grams each the chance that
two different ones are taken for one is 1 in 2 ** 44.  Equal sets are told by 128 bits.

Defined results: a null text, or one without words, has an empty set and links with nothing; one with
fewer words than n has its whole sequence as its one n-gram; equal sets are one class (in a component
together); repeated rows come back once each; a null id can't be the smallest id of its component
(null only if all its ids are); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, mix, text_buffers, windows, word_spans
from .common import Stored, arrow_limits, scratch, sized, stored, text_key
from .components import joined_components

HOT = 500_000
STAR_ROUNDS = 3
#: N-grams of up to so many sets wait for the last round.
FEW = 16
#: An n-gram that was counted so often is shared for certain.
KNOWN = 1000
#: N-grams a task collects before it counts them, and counts it holds before it hands them on.
COLLECTED, COUNTED = 500_000, 300_000
#: Sets whose name a task remembers, so that copies go on once; more only cost rows that are dropped later.
REMEMBERED = 100_000
#: N-grams in the blocks that a task writes at a time.
BLOCK = 300_000
#: Percent.
THRESHOLD = 75
_SHORT = U64(0xC2B2AE3D27D4EB4F)


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram names of each text."""
    names, _, pointers = word_spans(*text_buffers(column))
    grams, edges = windows(names, pointers, n)
    out = []
    for i in range(len(pointers) - 1):
        a, b = pointers[i], pointers[i + 1]
        if 0 < b - a < n:
            whole, _ = windows(names[a:b], np.array([0, b - a]), int(b - a))
            out.append(whole ^ mix(np.full(1, b - a, U64) * _SHORT))
        else:
            out.append(np.unique(grams[edges[i] : edges[i + 1]]))
    return out


def overlap_needed(n1, n2, percent: int):
    """Least intersection of sets of these sizes that link: 100 i >= percent (n1 + n2 - i)."""
    return -(-percent * (n1 + n2) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def suffix_filter(a: np.ndarray, b: np.ndarray, needed: int, depth: int = 3) -> bool:
    """False if splitting at middle elements shows that the sorted sets share fewer than needed."""
    return _most_shared(a, b, depth) >= needed


def _most_shared(a: np.ndarray, b: np.ndarray, depth: int) -> int:
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    middle = len(b) // 2
    at = int(np.searchsorted(a, b[middle]))
    hit = at < len(a) and a[at] == b[middle]
    return int(hit) + _most_shared(a[:at], b[:middle], depth - 1) + _most_shared(a[at + hit :], b[middle + 1 :], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    needed = overlap_needed(len(a), len(b), percent)
    if not suffix_filter(a, b, needed):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) >= needed


def _hot_grams(df: DataFrame, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names and counts of the most common n-grams; every text is counted, HOT rows come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, pending, size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

        def handed_on() -> pa.RecordBatch:
            again = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(names[again].view(np.int64)), pa.array(counts[again])], names=["gram", "count"])

        for batch in batches:
            fresh = gram_sets(batch.column(0), n)
            pending += fresh
            size += sum(map(len, fresh))
            if size >= COLLECTED:
                names, counts = _add_counts(names, counts, pending)
                pending, size = [], 0
                if len(names) > COUNTED:
                    names, counts = names[counts > 1], counts[counts > 1]
                if len(names) > COUNTED:
                    yield handed_on()
                    names, counts = names[:0], counts[:0]
        names, counts = _add_counts(names, counts, pending)
        yield handed_on()

    rows = df.select(text).mapInArrow(count, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "gram").limit(HOT)
    table = rows.toArrow()
    names, counts = np.asarray(table["gram"], np.int64).view(U64), np.asarray(table["count"], np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def _add_counts(names: np.ndarray, counts: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names and counts with one more for each set that holds a name."""
    both = np.concatenate([names, *sets])
    weight = np.concatenate([counts, np.ones(len(both) - len(names), np.int64)])
    order = np.argsort(both)
    both, weight = both[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(weight, first) if len(first) else counts[:0]


def _prefix(grams: np.ndarray, hot: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's rarest n-grams, rarest first and then by name, and whether each is known to be shared."""
    length = prefix_length(len(grams), percent)
    if not len(hot[0]):
        return grams[:length], np.zeros(length, bool)
    at = np.minimum(np.searchsorted(hot[0], grams), len(hot[0]) - 1)
    weight = np.where(hot[0][at] == grams, hot[1][at], 0)
    order = np.argsort(weight, kind="stable")[:length]
    return grams[order], weight[order] >= KNOWN


def _planes(values: np.ndarray) -> bytes:
    """A column of 32-bit numbers with all low bytes first, so that it compresses."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_block(first_id: int, grams: np.ndarray, row: np.ndarray, place: np.ndarray, size: np.ndarray) -> bytes:
    """N-grams with their set (as a number from ``first_id`` on), place in it and its size."""
    return np.array([first_id, len(grams)], "<i8").tobytes() + grams.astype("<u8").tobytes() + _planes(row) + _planes(place) + _planes(size)


def unpack_block(raw: bytes):
    """(ids, n-grams, places, sizes)."""
    first_id, k = np.frombuffer(raw, "<i8", 2)
    row, place, size = (_from_planes(raw[16 + 8 * k + 4 * k * i : 16 + 8 * k + 4 * k * (i + 1)]) for i in range(3))
    return first_id + row, np.frombuffer(raw, "<u8", k, 16), place, size


_TABLE = ["id", "doc_id", "tkey", "n_grams", "class", "fresh", "bucket", "block"]


def _prefixes(df: DataFrame, doc_id: str, text: str, n: int, percent: int, buckets: int) -> Stored:
    """For every row: id (of this table), doc_id, tkey, n_grams, class (16 bytes), fresh (once a task for each
    class); and rows with bucket and block: prefix n-grams, in buckets from ``buckets`` on if known to be shared."""
    hot = df.sparkSession.sparkContext.broadcast(_hot_grams(df, text, n))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, done = TaskContext.get().partitionId(), set(), 0
        pending, held, first = [], 0, 0
        no_doc = None

        def blocks() -> Iterator[pa.RecordBatch]:
            grams, known, row, place, size = (np.concatenate(c) for c in zip(*pending, strict=True))
            bucket = np.where(known, buckets + part % buckets, (grams >> U64(32)).astype(np.int64) % buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = order[a:b]
                raw = pack_block((part << 36) + first, grams[own], row[own] - first, place[own], size[own])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, no_doc), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([int(bucket[own[0]])], pa.int32()), pa.array([raw], pa.binary())], names=_TABLE)

        for batch in batches:
            no_doc = batch.column(0).type
            sets = gram_sets(batch.column(2), n)
            keys, fresh = [], []
            for i, grams in enumerate(sets):
                key = hashlib.md5(grams.tobytes()).digest()
                keys.append(key)
                fresh.append(bool(len(grams)) and key not in seen)
                if fresh[-1]:
                    if len(seen) < REMEMBERED:
                        seen.add(key)
                    some, known = _prefix(grams, hot.value, percent)
                    pending.append((some, known, np.full(len(some), done + i), np.arange(len(some)), np.full(len(some), len(grams))))
                    held += len(some)
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            ids = np.arange(done, done + len(sets)) + (part << 36)
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(fresh, pa.bool_()), *none], names=_TABLE)
            done += len(sets)
            if held >= BLOCK:
                yield from blocks()
                pending, held, first = [], 0, done
        if pending:
            yield from blocks()

    id_type = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("tkey"), F.col(text).alias("text"))
    return Stored(rows.mapInArrow(make, f"id long, doc_id {id_type}, tkey binary, n_grams long, class binary, fresh boolean, bucket int, block binary"), "gram-prefixes")


def _shared_grams(table: DataFrame, buckets: int) -> DataFrame:
    """id, n (size of the set), p (place), gram, many: prefix n-grams that several sets hold."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("gram", pa.int64()), ("many", pa.bool_())])

    def shared(key: tuple, blocks: pa.Table) -> pa.Table:
        ids, grams, places, sizes = (np.concatenate(c) for c in zip(*map(unpack_block, blocks["block"].to_pylist()), strict=True))
        times = np.full(len(grams), FEW + 1)
        if key[0].as_py() < buckets:
            order = np.argsort(grams)
            some = grams[order]
            edges = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1], [True])))
            times[order] = np.repeat(np.diff(edges), np.diff(edges))
        kept = times > 1
        return pa.Table.from_arrays([pa.array(ids[kept]), pa.array(sizes[kept]), pa.array(places[kept]), pa.array(grams[kept].view(np.int64)), pa.array(times[kept] > FEW)], schema=schema)

    return table.where("bucket IS NOT NULL").select("bucket", "block").groupBy("bucket").applyInArrow(shared, "id long, n long, p long, gram long, many boolean")


def _passes(n1, p1, n2, p2, percent: int):
    """Length filter, and positional filter at a shared n-gram, as a Column."""
    needed = F.ceil(F.lit(percent) * (n1 + n2) / (100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= needed)


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, text: str, n: int, percent: int) -> Stored:
    """The pairs (u, v) that link. ``names``: id, tkey and copies (whether several rows have the text) of
    every set.  Texts travel, as they are smaller than their sets; of copies a task sends one."""
    ids = stored(pairs.select(F.col("u").alias("id")).unionAll(pairs.select(F.col("v").alias("id"))).distinct().join(names, "id"), "pair-ids")
    found = docs.select(text_key(F.col(text)).alias("tkey"), F.col(text).alias("text")).join(sized(ids), "tkey")
    texts = found.where("NOT copies").select("id", "text").unionAll(found.where("copies").groupBy("id").agg(F.first("text").alias("text")))
    texts = stored(texts, "pair-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, first, place = np.unique(np.asarray(batch.column(1)), return_index=True, return_inverse=True)
            leaders = gram_sets(batch.column(3).take(pa.array(first)), n)
            good = [linked(own, leaders[i], percent) for own, i in zip(gram_sets(batch.column(2), n), place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    # v is the leader where a round has leaders: its text is one of few.
    leaders = pairs.select(F.col("v").alias("id")).distinct()
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("a")).join(sized(pairs), "u")
    two = texts.join(leaders, "id", "left_semi").select(F.col("id").alias("v"), F.col("text").alias("b"))
    return Stored(one.join(two, "v").select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "links")


def _leaders(rows: DataFrame, turn: int) -> DataFrame:
    """Rows (id, n, p, gram, comp) of n-grams that several components hold, each with ``other``: a row
    of another component with this n-gram, of the largest there is: first the one with fewest rarer
    n-grams, which tells most about sets that differ from a common text by edits, then any other."""
    nearest = F.col("p").cast("long") if turn == 0 else F.xxhash64(F.lit(turn), "id")
    at = F.struct((-F.col("size")).alias("s"), nearest.alias("h"), F.xxhash64(F.lit(turn), "comp").alias("c"), "comp", "id", "n", "p")
    ends = stored(rows.groupBy("gram").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low.comp <> high.comp"), "leaders")
    other = F.when(F.col("low.comp") != F.col("comp"), F.col("low")).otherwise(F.col("high"))
    return rows.join(sized(ends, 128), "gram").select("id", "n", "p", other.alias("other"))


def _chosen(met: DataFrame, percent: int) -> DataFrame:
    """u, v: each set with the leader that shares most prefix n-grams with it."""
    met = met.where(_passes(F.col("n"), F.col("p"), F.col("other.n"), F.col("other.p"), percent))
    counted = met.groupBy("id", F.col("other.id").alias("lead")).agg(F.count("*").alias("c"))
    chosen = stored(counted.groupBy("id").agg(F.max_by("lead", F.struct("c", "lead")).alias("v")).withColumnRenamed("id", "u"), "chosen")
    # Two sets may have chosen each other.
    both = chosen.select(F.col("v").alias("u"), F.col("u").alias("v")).where("u > v")
    return chosen.join(both, ["u", "v"], "left_anti")


def _all_apart(rows: DataFrame, percent: int) -> DataFrame:
    """u, v: all sets of different components that share prefix n-grams and pass the filters.

    Of two prefixes, the one that ends with the rarer n-gram has all its n-grams compared; so sets share at
    most the n-grams found and what lies behind that prefix.  N-grams of up to FEW sets are all counted for
    each pair; of the others both sets may share as many as they have, and pairs that share only such
    n-grams come from a join of their own, by position."""
    many, few = rows.where("many"), rows.where("NOT many")
    apart = stored(many.groupBy("gram").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("gram"), "apart")
    live = stored(many.join(sized(apart), "gram").select("gram", "id", "n", "p", "comp"), "live-grams")
    hot = stored(many.groupBy("id").agg(F.count("*").alias("hot")), "hot-counts")
    live = live.join(sized(hot), "id")

    def met(some: DataFrame, passes) -> DataFrame:
        one, two = some.alias("a"), some.alias("b")
        return one.join(two, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.comp") < F.col("b.comp")) & passes)

    an, ap, bn, bp = (F.col(k) for k in ("a.n", "a.p", "b.n", "b.p"))
    pair = F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")
    needed = F.ceil(F.lit(percent) * (an + bn) / (100 + percent))
    behind = F.ceil(F.lit(percent) * F.greatest(an, bn) / 100) - 1
    counted = met(few.select("gram", "id", "n", "p", "comp"), 100 * F.least(an, bn) >= percent * F.greatest(an, bn)).groupBy(*pair).agg(
        F.count("*").alias("c"), F.max(F.least(an - ap, bn - bp) - needed).alias("room"), F.first(needed - behind).alias("least")
    )
    for k in "uv":
        counted = counted.join(sized(hot).select(F.col("id").alias(k), F.col("hot").alias(f"hot_{k}")), k, "left")
    more = F.least(F.coalesce("hot_u", F.lit(0)), F.coalesce("hot_v", F.lit(0)))
    pairs = counted.where((F.col("c") + more >= F.col("least")) & (F.col("room") + more >= 0)).select("u", "v")
    by_place = _passes(an, ap, bn, bp, percent) & (F.least("a.hot", "b.hot") >= needed - behind)
    return pairs.unionAll(met(live, by_place).select(*pair)).distinct()


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (smallest id with an equal set) of every row."""
    arrow_limits(df.sparkSession)
    with scratch():
        return stored(_components(df, doc_id, text, n, percent), "components", lasting=True)


def _components(df: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    prefixes = _prefixes(df, doc_id, text, n, percent, buckets).read()
    table = prefixes.where("bucket IS NULL")
    classes = stored(table.where("n_grams > 0").groupBy("class").agg(F.min("id").alias("rep"), F.min("doc_id").alias("class_id")), "classes")
    again = stored(table.groupBy("tkey").count().where("count > 1").select("tkey", F.lit(True).alias("_c")), "copied-texts")
    names = stored(table.where("fresh").select("id", "tkey").join(sized(again), "tkey", "left").select("id", "tkey", F.coalesce("_c", F.lit(False)).alias("copies")), "names")
    # Of equal sets that several tasks met, one goes on.
    extra = stored(table.where("fresh").select("id", "class").join(classes, "class").where("id <> rep").select("id"), "equal-sets")
    shared = stored(_shared_grams(prefixes, buckets).join(sized(extra), "id", "left_anti"), "shared-grams")

    tried = comps = None
    turn, last = 0, False
    while not last:
        last = turn == STAR_ROUNDS or (turn > 0 and found.isEmpty())
        rows = shared if last else shared.where("many")
        if comps is None:
            rows = rows.withColumn("comp", F.col("id")).withColumn("size", F.lit(1).cast("long"))
        else:
            rows = rows.join(sized(comps), F.col("id") == F.col("node"), "left").select("id", "n", "p", "gram", "many", F.coalesce("component", "id").alias("comp"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
        pairs = _all_apart(rows, percent) if last else _chosen(_leaders(rows, turn), percent)
        if tried is not None:
            done = tried.unionAll(tried.select(F.col("v").alias("u"), F.col("u").alias("v")))
            pairs = pairs.join(done, ["u", "v"], "left_anti")
        pairs = stored(pairs.select("u", "v"), "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        found = _verified(pairs, df, names, text, n, percent).read()
        turn += 1
        if comps is not None and found.isEmpty():
            continue
        comps = joined_components(comps, found)
        sizes = stored(comps.groupBy("component").agg(F.count("*").alias("size")), "component-sizes")
        comps = stored(comps.join(sized(sizes), "component"), "components")
    rows = table.select("id", "doc_id", "n_grams", "class").join(sized(classes), "class", "left").join(sized(comps), F.col("rep") == F.col("node"), "left")
    rows = stored(rows.select("doc_id", "n_grams", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "rep", "id").alias("comp")), "members")
    least = stored(rows.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least-ids")
    return rows.join(sized(least), "comp").select("doc_id", F.col("n_grams").alias("n_shingles"), "component_id", "class_id")


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))

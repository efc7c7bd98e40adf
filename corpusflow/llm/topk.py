"""Exact top-k inner products: queries and shards in tiles, partial selection in each tile, and a tree
that merges every query's short lists.

Components become floor(256 * x); scores are integers, so every answer is exact.  Vectors that are
null, hold a null or a non-finite component, or have no id take no part.  Vectors of different
lengths aren't compared.  A row whose id equals the query's is the query's own row and no candidate;
repeated rows each count.  An empty table gives an empty result.  Scores beyond 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow_limits

SCALE = 256
#: Rows of a query tile and of a candidate tile; a tile product is QUERY_TILE x SHARD_TILE numbers.
QUERY_TILE, SHARD_TILE = 512, 4096
#: Bytes of query tiles sent to the executors at once; more queries take more passes.
PASS_BYTES = 64 << 20
FAN_IN = 8
_TOP = "tile long, dim int, rows binary, ids binary, scores binary"


def quantised(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid rows, lengths, flat float64 of the valid rows) of a list column."""
    if len(vectors) == 0:
        return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0)
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    bad = np.zeros(len(vectors), bool)
    bad[row[~np.isfinite(flat)]] = True
    good = ~bad & np.asarray(vectors.is_valid())
    return good, lengths, np.floor(SCALE * flat[good[row]])


def _tiles(batches: Iterator[pa.RecordBatch], size: int):
    """(dim, ids, matrix) with at most ``size`` rows, each dim on its own."""
    waiting: dict[int, list] = {}
    for batch in batches:
        good, lengths, flat = quantised(batch.column(1))
        ids = np.asarray(batch.column(0), np.int64)[good]
        lengths = lengths[good]
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            matrix = flat[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
            held = waiting.setdefault(dim, [])
            held.append((ids[rows], matrix))
            if sum(len(i) for i, _ in held) >= size:
                all_ids, all_rows = np.concatenate([i for i, _ in held]), np.concatenate([m for _, m in held])
                cut = len(all_ids) // size * size
                for at in range(0, cut, size):
                    yield dim, all_ids[at : at + size], all_rows[at : at + size]
                waiting[dim] = [(all_ids[cut:], all_rows[cut:])]
    for dim, held in waiting.items():
        ids = np.concatenate([i for i, _ in held])
        if len(ids):
            yield dim, ids, np.concatenate([m for _, m in held])


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact."""
    dim = max(1, queries.shape[1])
    peak = (np.abs(queries).max(initial=0), np.abs(shard).max(initial=0))
    if peak[0] * peak[1] * dim < 2**53:
        return (queries @ shard.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in row] for row in shard], object).reshape(shard.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best (score, then smaller id): ids and scores, padded with id -1 at the end."""
    order = np.argsort(ids, kind="stable")
    scores, ids, allowed = scores[:, order], ids[order], allowed[:, order]
    n, width = scores.shape
    small = np.iinfo(np.int64).min
    if width > k:
        bound = np.where(allowed, scores, small)
        floor_ = np.partition(bound, width - k, axis=1)[:, width - k]
        likely = bound >= floor_[:, None]
    else:
        likely = allowed
    out_ids, out_scores = np.full((n, k), -1, np.int64), np.full((n, k), small, np.int64)
    filled = np.zeros((n, k), bool)
    r, c = np.nonzero(likely & allowed)
    best = np.lexsort((c, ~scores[r, c], r))
    r, c = r[best], c[best]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < k
    out_ids[r[keep], rank[keep]], out_scores[r[keep], rank[keep]], filled[r[keep], rank[keep]] = ids[c[keep]], scores[r[keep], c[keep]], True
    return _pack(out_ids, out_scores, filled)


def _pack(ids, scores, filled):
    """Empty places are told by a count in front of each row."""
    counts = filled.sum(1, keepdims=True)
    return np.hstack([counts, ids]), scores


def merge(parts: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge short lists of the same queries."""
    ids = np.hstack([p[0][:, 1:] for p in parts])
    scores = np.hstack([p[1] for p in parts])
    filled = np.hstack([np.arange(p[1].shape[1])[None, :] < p[0][:, :1] for p in parts])
    order = np.lexsort((ids, ~scores, ~filled), axis=1)[:, :k]
    return _pack(*(np.take_along_axis(x, order, axis=1) for x in (ids, scores, filled)))


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best other rows.

    Queries are packed into tiles in the shared folder and go out in passes of PASS_BYTES, each pass
    meeting every candidate shard once.  Passes of more than one are stored, so plans stay small.
    """
    spark = df.sparkSession
    arrow_limits(spark)
    vectors = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col(vec_id).isNotNull())

    def pack(batches):
        for dim, ids, matrix in _tiles(batches, QUERY_TILE):
            yield pa.RecordBatch.from_pydict({"dim": [dim], "ids": [ids.tobytes()], "rows": [matrix.tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary())]))

    tiles = Stored(df.where(is_query).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id IS NOT NULL").mapInArrow(pack, "dim int, ids binary, rows binary"), "query-tiles")
    results, held, size, tile = [], [], 0, 0
    for row in tiles.read().toLocalIterator():
        held.append((tile, row.dim, bytes(row.ids), bytes(row.rows)))
        size += len(row.ids) + len(row.rows)
        tile += 1
        if size >= PASS_BYTES:
            results.append(Stored(_one_pass(vectors, held, k), "top-lists").read())
            held, size = [], 0
    if held or not results:
        results.append(_one_pass(vectors, held, k))
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


def _one_pass(vectors: DataFrame, tiles: list, k: int) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(tiles)

    def shard_lists(batches):
        best: dict[int, tuple] = {}
        queries = [(t, dim, np.frombuffer(ids, np.int64), np.frombuffer(rows).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0))) for t, dim, ids, rows in sent.value]
        for dim, ids, matrix in _tiles(batches, SHARD_TILE):
            for t, query_dim, query_ids, rows in queries:
                if query_dim == dim:
                    part = select(products(rows, matrix), ids, query_ids[:, None] != ids[None, :], k)
                    best[t] = merge([best[t], part], k) if t in best else part
        for t, dim, query_ids, _ in queries:
            if t in best:
                yield _row(t, dim, query_ids, *best[t])

    def tree(key, table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(i.as_py(), np.int64).reshape(-1, k + 1), np.frombuffer(s.as_py(), np.int64).reshape(-1, k)) for i, s in zip(table["ids"], table["scores"], strict=True)]
        return pa.Table.from_batches([_row(key[0].as_py(), table["dim"][0].as_py(), np.frombuffer(table["rows"][0].as_py(), np.int64), *merge(parts, k))])

    shards = vectors.rdd.getNumPartitions()
    lists = vectors.mapInArrow(shard_lists, _TOP).withColumn("part", F.spark_partition_id())
    while shards > 1:
        shards = -(-shards // FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("tile", "part").applyInArrow(lambda key, t: tree(key, t).append_column("part", pa.array([key[1].as_py()], pa.int64())), f"{_TOP}, part long")

    def unpack(batches):
        for batch in batches:
            for query_ids, ids, scores in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                queries = np.frombuffer(query_ids.as_py(), np.int64)
                ids, scores = np.frombuffer(ids.as_py(), np.int64).reshape(-1, k + 1), np.frombuffer(scores.as_py(), np.int64).reshape(-1, k)
                r, c = np.nonzero(np.arange(k)[None, :] < ids[:, :1])
                yield pa.RecordBatch.from_arrays([pa.array(queries[r]), pa.array((c + 1).astype(np.int32)), pa.array(ids[:, 1:][r, c]), pa.array(scores[r, c])], names=["query_id", "rank", "vec_id", "score"])

    return lists.drop("part").mapInArrow(unpack, "query_id long, rank int, vec_id long, score long")


def _row(tile, dim, query_ids, ids, scores) -> pa.RecordBatch:
    schema = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
    return pa.RecordBatch.from_pydict({"tile": [tile], "dim": [dim], "rows": [query_ids.tobytes()], "ids": [np.ascontiguousarray(ids).tobytes()], "scores": [np.ascontiguousarray(scores).tobytes()]}, schema=schema)


def op2_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The five best for every row whose id is divisible by 50, against all rows."""
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

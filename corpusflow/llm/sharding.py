"""Sharding by k-d tree partitioning, in DataFrame functions only.

Rows are points of three metadata dimensions: text bytes, language and source (the latter two as
places in a 2**20 range by hash).  A node that holds more than one leaf's bytes is split at the weighted
median along its widest dimension; the weight is the size in bytes.  Along a dimension rows are in
the order of (coordinate, name of the text, name of the row), so the cut can fall anywhere.  Rows of
equal texts are one point: they get the least language and source among them, so they share all but the
row's name and stay together unless a node's share of bytes would be missed by more than TOLERANCE, when
the row's own name decides.

The median is found on histograms: each pass sums the bytes of 2**BITS buckets of every node's open
range and narrows it to one bucket.  What reaches the driver are these sums, nodes x 2**BITS rows at
most; each pass reads only the narrow stored table.

Defined results: a null text has size 1 and the checksum of nothing; null language or source is a
place of its own; repeated rows are told apart by their place in the stored table; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored

BITS = 12
#: Share of a node's bytes by which a cut may miss; and up to which it may miss so that equal texts stay together.
NEAR, TOLERANCE = 0.002, 0.01
#: Rows of a shard that are numbered in one task.
SLICE_ROWS = 50_000
_COORDINATE, _NAME = 20, 40


def _place(column: Column) -> Column:
    """20 bits for a category."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(column.cast("string"), F.lit("\0null"))), 64 - _COORDINATE)


def metadata_points(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, the three coordinates d0..d2, text_name and row_name.

    Where rows of equal texts differ in language or source, all get the least of each."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(raw), 64 - _NAME).alias("text_name"), _place(F.col(lang)).alias("d1"), _place(F.col(source)).alias("d2"), F.unhex(F.md5(raw)).alias("text_md5"))
    base = stored(base.withColumn("row_name", F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 4)), "metadata")
    ends = [F.min("d1").alias("m1"), F.max("d1").alias("x1"), F.min("d2").alias("m2"), F.max("d2").alias("x2")]
    spread = stored(base.groupBy("text_md5").agg(*ends).where("m1 < x1 OR m2 < x2").select("text_md5", "m1", "m2"), "spread-texts")
    base = base.join(sized(spread), "text_md5", "left").drop("text_md5")
    base = base.withColumn("d1", F.coalesce("m1", "d1")).withColumn("d2", F.coalesce("m2", "d2")).drop("m1", "m2")
    return base.withColumn("d0", F.least(F.floor(F.log2("size") * (1 << 14)), F.lit((1 << _COORDINATE) - 1)).cast("long"))


def _key(axis: Column) -> Column:
    """60 bits: coordinate along the axis, then the text's name."""
    coordinate = F.when(axis == 0, F.col("d0")).when(axis == 1, F.col("d1")).otherwise(F.col("d2"))
    return F.shiftleft(coordinate, _NAME).bitwiseOR(F.col("text_name"))


def _choose(pairs: list[tuple[int, Column]], column: Column) -> Column:
    """pairs[column]: a short case expression, one branch for each node."""
    out = F.lit(None)
    for node, value in pairs:
        out = F.when(column == node, value).otherwise(out)
    return out


class _Cut:
    """The search for one node's cut: rows below (key, then row name) go left."""

    def __init__(self, node: int, axis: int, total: int, goal: float) -> None:
        self.node, self.axis, self.total, self.goal = node, axis, total, goal
        self.by_row, self.key, self.low, self.bits, self.before, self.done = False, None, 0, _COORDINATE + _NAME, 0, False

    def shift(self) -> int:
        return max(0, self.bits - BITS)

    def narrow(self, sums: list[tuple[int, int]]) -> None:
        """``sums``: (bucket, bytes) of the open range in order. Stop at a bucket's edge if it is near
        enough, else open the bucket that holds the goal."""
        run = self.before
        for bucket, weight in sums:
            if run + weight >= self.goal:
                break
            run += weight
        slack = (TOLERANCE if self.shift() == 0 else NEAR) * self.total
        below, above = self.goal - run, run + weight - self.goal
        width = 1 << self.shift()
        start = self.low + bucket * width
        if min(below, above) <= slack or (self.shift() == 0 and self.by_row):
            self.low, self.done = start if below <= above else start + width, True
        elif self.shift() == 0:
            self.key, self.by_row, self.low, self.bits, self.before = start, True, 0, _COORDINATE + _NAME, run
        else:
            self.low, self.bits, self.before = start, self.shift(), run

    def in_range(self) -> Column:
        value = F.col("row_name") if self.by_row else F.col("key")
        inside = (value >= self.low) & (value < self.low + (1 << self.bits))
        return inside & (F.col("key") == self.key) if self.by_row else inside

    def bucket(self) -> Column:
        return F.shiftright((F.col("row_name") if self.by_row else F.col("key")) - self.low, self.shift())

    def goes_right(self) -> Column:
        if self.by_row:
            return (F.col("key") > self.key) | ((F.col("key") == self.key) & (F.col("row_name") >= self.low))
        return F.col("key") >= self.low


def _widest(points: DataFrame, nodes: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """(axis, bytes) of each node: the axis with the widest weighted spread."""
    sums = points.groupBy("node").agg(F.sum("size").alias("total"), *(F.sum(F.col("size") * F.col(f"d{k}").cast("double")).alias(f"s{k}") for k in range(3)), *(F.sum(F.col("size") * F.col(f"d{k}").cast("double") * F.col(f"d{k}")).alias(f"q{k}") for k in range(3)))
    out = {}
    for row in sums.collect():
        if row.node in nodes:
            spread = [max(0.0, row[f"q{k}"] / row.total - (row[f"s{k}"] / row.total) ** 2) for k in range(3)]
            out[row.node] = max(range(3), key=lambda k: (spread[k], -k)), row.total
    return out


def kd_shards(df: DataFrame, shards: int = 8, **columns: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot: leaves of total bytes / ``shards`` each."""
    points = stored(metadata_points(df, **columns), "points").withColumn("node", F.lit(0).cast("int"))
    nodes = {0: (0, shards)}
    while any(n > 1 for _, n in nodes.values()):
        splitting = {k: v for k, v in nodes.items() if v[1] > 1}
        axes = _widest(points, splitting)
        cuts = {node: _Cut(node, axis, total, total * (nodes[node][1] // 2) / nodes[node][1]) for node, (axis, total) in axes.items()}
        keyed = stored(points.withColumn("key", _key(_choose([(n, F.lit(c.axis)) for n, c in cuts.items()], F.col("node")))), "keyed") if cuts else points
        while open_cuts := {n: c for n, c in cuts.items() if not c.done}:
            inside = keyed.where(_choose([(n, c.in_range()) for n, c in open_cuts.items()], F.col("node")))
            sums = inside.groupBy("node", _choose([(n, c.bucket()) for n, c in open_cuts.items()], F.col("node")).alias("bucket")).agg(F.sum("size").alias("bytes"))
            by_node: dict[int, list] = {n: [] for n in open_cuts}
            for row in sums.collect():
                by_node[row.node].append((row.bucket, row.bytes))
            for n, found in by_node.items():
                open_cuts[n].narrow(sorted(found))
        below = {}
        for node, (first, n) in nodes.items():
            below[2 * node + 1] = (first, n // 2) if n > 1 else (first, 1)
            if n > 1:
                below[2 * node + 2] = (first + n // 2, n - n // 2)
        if cuts:
            right = F.coalesce(_choose([(n, c.goes_right()) for n, c in cuts.items()], F.col("node")), F.lit(False))
            points = stored(keyed.withColumn("node", 2 * F.col("node") + F.when(right, 2).otherwise(1)).drop("key"), "points")
        else:
            points = points.withColumn("node", 2 * F.col("node") + 1)
        nodes = below
    sharded = points.withColumn("shard", _choose([(n, F.lit(first)) for n, (first, _) in nodes.items()], F.col("node")).cast("int"))
    return _numbered(sharded.select("doc_id", "size", "text_crc32", "shard", "row_name"))


def _numbered(sharded: DataFrame) -> DataFrame:
    """slot: gapless in each shard. Shards are numbered in slices by row name, each in its own task."""
    sharded = stored(sharded, "sharded")
    counts = sharded.groupBy("shard").count()
    largest = counts.agg(F.max("count")).first()[0] or 0
    width = (1 << 60) // max(1, -(-largest // SLICE_ROWS))
    sliced = sharded.withColumn("slice", F.expr(f"row_name div {width}L"))
    sizes = sliced.groupBy("shard", "slice").agg(F.count("*").alias("rows"))
    starts = sizes.withColumn("base", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    inside = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row_name", "doc_id")) - 1
    return sliced.withColumn("inside", inside).join(starts, ["shard", "slice"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("inside")).cast("long").alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    shards = kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

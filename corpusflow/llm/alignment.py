r"""Alignment of two tokenizers over the same texts, by relational steps.

Spark explodes tokens with their positions, sums their bytes in windows, joins both sides on unit and byte
end, numbers the cuts (ends that both share), joins each cut's tokens and counts linked id pairs.

The unit of these steps is a piece of text, not a document: a text is parted at single spaces between
characters that aren't white space, where both tokenizers always cut (byte-level pre-tokens never run over
them, and no piece of the other vocabulary has a space behind another character; this is checked).  So every
distinct piece of the corpus is encoded and aligned once, and weighs as often as it occurs.

1. Blocks of documents: each text becomes an array of numbers in its block's list of pieces.
2. All blocks' pieces are bucketed by piece; distinct ones are encoded, aligned and stored in the same buckets,
   so neither the alignment nor the way back shuffles tokens.
3. Linked id pairs are counted over all pieces, by weight.
4. Each block gets its pieces' groups, links and sums, and documents are put together from them.

Memory: a block's list is bounded by BLOCK_BYTES of text, long texts are parted and digested in steps; a text
without a space is one piece, as large as the tokenizers themselves can take.

Defined results: a null or empty text, or one whose joined token bytes are not its own (as with U+2581), has no
tokens, no links and an empty digest; null ids and rows that repeat give a row each; ties for the highest count
all count as best; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Bucketed, arrow_limits, by_fewer_keys, scratch, sized, stored

#: Where a text is parted: single spaces between characters that aren't white space.
EDGE = re.compile(r" (?<=\S )(?=\S)")
#: A space beside white space, which is no edge.
_BESIDE = re.compile(r" \s|[^\S ] ")
#: Bytes of text whose pieces are listed together, characters parted at a time, and rows sent at a time.
BLOCK_BYTES, STEP_CHARS, ROWS = 32 << 20, 1 << 20, 20_000
TOKENS = "array<struct<id:int,bytes:int>>"


class Pair:
    """Both tokenizers, loaded once in a process from the bytes of their files."""

    _loaded: dict[bytes, Pair] = {}

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        # A character of a byte-level token stands for a byte.
        size = self.a.get_vocab_size()
        self.a_bytes = np.array([len(self.a.id_to_token(i) or "") for i in range(size)], np.int32)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = np.array([1 if self.b.is_byte(i) else len(n.replace("▁", " ").encode()) for i, n in enumerate(names)], np.int32)
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece of the vocabulary runs over a space, so texts can't be parted there")

    @classmethod
    def of(cls, a_json: bytes, b_model: bytes) -> Pair:
        name = hashlib.md5(a_json + b_model).digest()
        if name not in cls._loaded:
            cls._loaded[name] = cls(a_json, b_model)
        return cls._loaded[name]

    def whole(self, pieces: list[str]) -> list[str]:
        """Those whose text the second tokenizer's pieces hold as it is."""
        said = " ".join(pieces)
        if "▁" not in said and self.b.normalize(said).replace("▁", " ") == " " + said:
            return pieces
        return [p for p, n in zip(pieces, self.b.normalize(pieces), strict=True) if "▁" not in p and n.replace("▁", " ") == " " + p]

    def tokens_a(self, pieces: list[str]) -> list[int]:
        """Ids of all pieces in a row; those between which all joints are edges are encoded as one text."""
        out: list[int] = []
        start = 0
        for k in range(1, len(pieces) + 1):
            if k == len(pieces) or pieces[k - 1][-1].isspace() or pieces[k][0].isspace():
                out += self.a.encode_batch_fast([" " + " ".join(pieces[start:k])], add_special_tokens=False)[0].ids
                start = k
        return out

    def tokens_b(self, pieces: list[str]) -> list[int]:
        return list(chain.from_iterable(self.b.encode(pieces, num_threads=1)))


def _split(text: str) -> list[str]:
    if text[0] == " " or text[-1] == " " or _BESIDE.search(text):
        return EDGE.split(text)
    return text.split(" ")


def parted(text: str) -> Iterator[list[str]]:
    """A text's pieces, some at a time."""
    at = 0
    while len(text) - at > STEP_CHARS and (edge := EDGE.search(text, at + STEP_CHARS)):
        yield _split(text[at : edge.start()])
        at = edge.end()
    yield _split(text[at:])


def _listed(df: DataFrame, doc_id: str, text: str, files) -> DataFrame:
    """Rows of documents (block, doc_id, places) and of pieces (block, piece, place, n).

    places: the document's pieces by their place in the block's list; null without tokens."""
    id_type = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, block long, places array<int>, piece string, place int, n long"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, held = Pair.of(*files.value), TaskContext.get().partitionId() << 24, 0
        places: dict[str, int] = {}
        counts = np.zeros(1 << 16, np.int64)
        kind = pa.list_(pa.int32())

        def listed() -> Iterator[pa.RecordBatch]:
            names = iter(places)
            for start in range(0, len(places), ROWS):
                rows = list(islice(names, ROWS))
                own = pa.array(np.arange(start, start + len(rows)), pa.int32())
                # A piece that only documents without tokens hold has no count.
                held = pa.record_batch([pa.nulls(len(rows), id_arrow), pa.array(np.full(len(rows), block), pa.int64()), pa.nulls(len(rows), kind), pa.array(rows, pa.string()), own, pa.array(counts[start : start + len(rows)])], names=NAMES)
                yield held.filter(pa.array(counts[start : start + len(rows)] > 0))

        id_arrow = None
        for batch in batches:
            id_arrow, found = batch.column(0).type, []
            for text in batch.column(1):
                said, own, good = text.as_py() or "", [], True
                for pieces in parted(said) if said else ():
                    at = np.fromiter((places.get(p, -1) for p in pieces), np.int32, len(pieces))
                    if (new := np.flatnonzero(at < 0)).size:
                        unseen = [pieces[k] for k in new.tolist()]
                        for p in pair.whole(list(dict.fromkeys(unseen))):
                            places[p] = len(places)
                        at[new] = [places.get(p, -1) for p in unseen]
                        if not (good := int(at[new].min()) >= 0):
                            break
                    own.append(at)
                if len(counts) < len(places):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(places)), np.int64)])
                if said and good:
                    found.append(np.concatenate(own))
                    if len(found[-1]) > len(places):
                        counts[: len(places)] += np.bincount(found[-1], minlength=len(places))
                    else:
                        np.add.at(counts, found[-1], 1)
                else:
                    found.append(None)
                held += len(said)
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(found), block), pa.int64()), pa.array(found, kind), pa.nulls(len(found), pa.string()), pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.int64())], names=NAMES)
            if held >= BLOCK_BYTES:
                yield from listed()
                block, held, places, counts = block + 1, 0, {}, np.zeros(1 << 16, np.int64)
        yield from listed()

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(blocks, schema)


NAMES = ["doc_id", "block", "places", "piece", "place", "n"]


def _encoded(pieces: DataFrame, files) -> DataFrame:
    """piece, n, a, b: every distinct piece with its weight and both sides' tokens."""

    def tokens(pieces: pa.Array, encode, sizes) -> pa.Array:
        flat = np.array(encode(pieces.to_pylist()), np.int32)
        ends = np.cumsum(pc.binary_length(pieces.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        taken = np.cumsum(sizes[flat], dtype=np.int64)
        edges = np.concatenate([[0], np.searchsorted(taken, ends) + 1]).astype(np.int32)
        if len(ends) and (len(flat) != edges[-1] or not np.array_equal(taken[edges[1:] - 1], ends)):
            raise ValueError("a tokenizer's bytes are not the text's")
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(flat), pa.array(sizes[flat])], names=["id", "bytes"]))

    @F.arrow_udf(TOKENS)
    def side_a(piece: pa.Array) -> pa.Array:
        pair = Pair.of(*files.value)
        return tokens(piece, pair.tokens_a, pair.a_bytes)

    @F.arrow_udf(TOKENS)
    def side_b(piece: pa.Array) -> pa.Array:
        pair = Pair.of(*files.value)
        return tokens(piece, pair.tokens_b, pair.b_bytes)

    return pieces.groupBy("piece").agg(F.sum("n").alias("n")).select("piece", "n", side_a("piece").alias("a"), side_b("piece").alias("b"))


def _ends(encoded: DataFrame, side: str) -> DataFrame:
    """piece, pos, id and end of one side's tokens: bytes up to and with the token."""
    rows = encoded.select("piece", F.posexplode(side).alias(f"{side}_pos", "t"))
    running = Window.partitionBy("piece").orderBy(f"{side}_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("piece", f"{side}_pos", F.col("t.id").alias(f"{side}_id"), F.sum("t.bytes").over(running).alias("end"))


def _aligned(encoded: DataFrame) -> DataFrame:
    """piece, n, n_a, n_b, groups as text, and links, the id pairs that end together.

    Tokens are never empty, so an end is one token's on either side, and each cut is one link."""
    cuts = _ends(encoded, "a").join(_ends(encoded, "b"), ["piece", "end"])
    order = Window.partitionBy("piece").orderBy("end")
    # A cut's running number is the id of the group that it ends; the group starts behind the cut before.
    cuts = cuts.select("piece", F.row_number().over(order).alias("group"), *(F.lag(f"{s}_pos", 1, -1).over(order).alias(f"{s}_before") for s in "ab"), "a_pos", "b_pos", "a_id", "b_id")
    groups = cuts.groupBy(F.col("piece").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("group", "a_before", "a_pos", "b_before", "b_pos", "a_id", "b_id"))).alias("cuts"))
    of = lambda x, s: F.array_join(F.slice(f"{s}.id", x[f"{s}_before"] + 2, x[f"{s}_pos"] - x[f"{s}_before"]), ",")
    text = F.array_join(F.transform("cuts", lambda x: F.concat(of(x, "a"), F.lit("|"), of(x, "b"))), ";")
    links = F.transform("cuts", lambda x: F.struct(x["a_id"].alias("a"), x["b_id"].alias("b")))
    return encoded.join(groups, F.col("piece") == F.col("_of")).select("piece", "n", F.size("a").alias("n_a"), F.size("b").alias("n_b"), text.alias("groups"), links.alias("links"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold an id pair; is that its b's highest?"""
    pairs = aligned.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = Window.partitionBy("b")
    return pairs.select("a", "b", "count", (F.col("count") == F.max("count").over(highest)).alias("best"))


def _weighed(aligned: DataFrame, pairs: DataFrame) -> DataFrame:
    """piece, n_a, n_b, n_links, groups, n_best and count_sum."""
    links = aligned.select("piece", F.inline("links"))
    sums = links.join(sized(pairs, 24), ["a", "b"]).groupBy(F.col("piece").alias("_of")).agg(F.sum(F.col("best").cast("int")).alias("n_best"), F.sum("count").alias("count_sum"))
    return aligned.join(sums, F.col("piece") == F.col("_of")).select("piece", "n_a", "n_b", F.size("links").alias("n_links"), "groups", "n_best", "count_sum")


LISTS = ["places", "n_a", "n_b", "n_links", "n_best", "count_sum"]
TYPES = {k: "array<long>" if k == "count_sum" else "array<int>" for k in LISTS}
PACKED = f"block long, groups string, {', '.join(f'{k} {t}' for k, t in TYPES.items())}"


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of a block that lie together in one row: arrays, and the groups in lines."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            order = t.column("block").to_numpy().argsort(kind="stable")
            t = t.take(pa.array(order)).combine_chunks()
            block = t.column("block").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            edges = pa.array(np.append(starts, len(block)).astype(np.int32))
            text = t.column("groups").to_pylist()
            ends = [*starts[1:], len(block)]
            lines = pa.array(["\n".join(text[i:j]) for i, j in zip(starts, ends, strict=True)], pa.string())
            lists = [pa.ListArray.from_arrays(edges, t.column(k).combine_chunks().cast(pa.int64() if k == "count_sum" else pa.int32())) for k in ["place", *LISTS[1:]]]
            return pa.record_batch([pa.array(block[starts]), lines, *lists], names=["block", "groups", *LISTS])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 8 * ROWS:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return rows.mapInArrow(pack, PACKED)


def _digested(rows: DataFrame, id_type: str, with_groups: bool) -> DataFrame:
    """Documents put together; a block's lists come before its documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    schema = f"doc_id {id_type}, {', '.join(f'{k} long' for k in names[1:7])}, groups_sha256 string{', groups string' * with_groups}"

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, groups, sums = None, [], np.zeros((0, 5), np.int64)
        for batch in batches:
            ids, out = [], []
            for k, row in enumerate(zip(*(batch.column(c) for c in ("block", "kind", "doc_id", "groups", "places")), strict=True)):
                if row[0].as_py() != block:
                    block, groups, sums = row[0].as_py(), [], np.zeros((0, 5), np.int64)
                if row[1].as_py() == 0:
                    at = np.asarray(row[4].values)
                    if len(groups) <= at.max():
                        more = max(int(at.max()) + 1, 2 * len(groups)) - len(groups)
                        groups += [""] * more
                        sums = np.concatenate([sums, np.zeros((more, 5), np.int64)])
                    for place, text in zip(at.tolist(), row[3].as_py().split("\n"), strict=True):
                        groups[place] = text
                    sums[at] = np.stack([np.asarray(batch.column(c)[k].values) for c in LISTS[1:]], 1)
                    continue
                ids.append(row[2])
                if not row[4].is_valid:
                    out.append([0] * 6 + [""] + [""] * with_groups)
                    continue
                at, digest, text = np.asarray(row[4].values), hashlib.sha256(), []
                for start in range(0, len(at), 100_000):
                    part = (";" * (start > 0) + ";".join([groups[i] for i in at[start : start + 100_000].tolist()])).encode()
                    digest.update(part)
                    if with_groups:
                        text.append(part)
                n_a, n_b, n_links, n_best, count_sum = sums[at].sum(0).tolist()
                out.append([n_a, n_b, n_links, n_links, n_best, count_sum, digest.hexdigest(), *[b"".join(text).decode()] * with_groups])
            if ids:
                yield pa.record_batch([pa.array([i.as_py() for i in ids], batch.column("doc_id").type), *(pa.array(c, pa.int64() if j < 6 else pa.string()) for j, c in enumerate(zip(*out, strict=True)))], names=names)

    return rows.mapInArrow(put_together, schema)


def _files(spark: SparkSession, a_path: str, b_path: str):
    """Two vocabulary files; workers need no path."""
    read = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            read.append(f.read())
    return spark.sparkContext.broadcast(tuple(read))


def align_documents(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on request, the groups.

    ``a_path``: a byte-level tokenizer's JSON; ``b_path``: a sentencepiece model with byte fallback."""
    spark = df.sparkSession
    arrow_limits(spark)
    files = _files(spark, a_path, b_path)
    id_type = df.schema[doc_id].dataType.simpleString()
    with scratch():
        listed = stored(_listed(df, doc_id, text, files), "listed")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        pieces = Bucketed(listed.where(F.col("piece").isNotNull()).select("piece", "block", "place", "n").repartition(parts, "piece"), "piece", "pieces").read()
        encoded = Bucketed(_encoded(pieces, files), "piece", "encoded")
        # Both sides lie by piece, so their join by piece and end needs no shuffle.
        made = Bucketed(_aligned(by_fewer_keys(spark).table(encoded.table)), "piece", "aligned")
        aligned = spark.table(made.table)
        weighed = _weighed(aligned, stored(pair_counts(aligned), "pairs"))
        lists = _packed(pieces.select("piece", "block", "place").join(weighed, "piece").select("block", "place", *LISTS[1:], "groups"))
        lists = lists.select("block", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("doc_id"), "groups", *LISTS)
        documents = listed.where(F.col("piece").isNull()).select("block", F.lit(1).alias("kind"), "doc_id", F.lit(None).cast("string").alias("groups"), "places", *(F.lit(None).cast(TYPES[k]).alias(k) for k in LISTS[1:]))
        rows = lists.unionByName(documents).repartition(parts, "block").sortWithinPartitions("block", "kind")
        done = stored(_digested(rows, id_type, with_groups), "aligned-documents", lasting=True)
    files.unpersist()
    return done


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))

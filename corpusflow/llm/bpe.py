"""Byte-pair merging with a hierarchical-bitmap rank queue.

There is a bucket of linked-list positions for each merge rank, and a bitmap in three levels says
which buckets hold anything; find-first-set picks the lowest rank.  Entries whose pair has changed
since are stale and skipped.  Many pre-tokens are merged in one run, laid out side by side with
separators that no merge crosses, so a bucket is handled as one numpy step; a single pre-token of
any length costs n log n at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

NONE = np.int32(2**31 - 1)
#: Pre-tokens a worker remembers (first come), and characters of text handled at a time.
MEMORY = 500_000
BLOCK = 4 << 20
STEP = 400_000


class RankQueue:
    """A set of ranks; ``pop`` takes the smallest. Three levels of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        self.leaf = [0] * (ranks // 64 + 1)
        self.middle = [0] * (ranks // 4096 + 1)
        self.root = 0

    def push(self, rank: int) -> None:
        word = rank >> 6
        self.leaf[word] |= 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.root |= 1 << (word >> 6)

    def pop(self) -> int:
        """The smallest rank, which leaves the set; -1 if there is none."""
        if not self.root:
            return -1
        top = (self.root & -self.root).bit_length() - 1
        bits = self.middle[top]
        word = top << 6 | (bits & -bits).bit_length() - 1
        low = self.leaf[word] & -self.leaf[word]
        self.leaf[word] ^= low
        if not self.leaf[word]:
            self.middle[top] ^= 1 << (word & 63)
            if not self.middle[top]:
                self.root ^= 1 << top
        return word << 6 | low.bit_length() - 1


class Merges:
    """Pairs of symbols with their rank and the symbol they become; ``n`` symbols besides the separator."""

    def __init__(self, left, right, rank, made, n: int) -> None:
        left, right, rank, made = (np.asarray(x, np.int64) for x in (left, right, rank, made))
        self.n, self.separator = n, n
        keys = left * (n + 1) + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], rank[order].astype(np.int32)
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int32)
        self.made[rank] = made
        # A rank is unsafe if the symbol it makes takes part in a merge of lower rank: then its
        # positions in one pre-token must go one at a time.
        born = np.full(n + 1, -1)
        np.maximum.at(born, made, rank)
        self.unsafe = np.zeros(len(self.made), bool)
        for side in (left, right):
            self.unsafe[born[side][born[side] > rank]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * (self.n + 1) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def run(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pre-tokens laid end to end; (symbols left, how many of them are each one's)."""
        if not len(self.keys):
            return symbols, lengths
        n = len(symbols) + len(lengths) + 1
        edges = np.concatenate(([0], np.cumsum(lengths + 1)))
        sym = np.full(n, self.separator, np.int32)
        real = np.ones(n, bool)
        real[edges] = False
        sym[real] = symbols
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.look_up(sym[:-1], sym[1:])
        owner = np.cumsum(~real) if self.unsafe.any() else None
        queue, buckets = RankQueue(len(self.made)), {}

        def push(positions: np.ndarray) -> None:
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for r, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                if r in buckets:
                    buckets[r].append(positions[a:b])
                else:
                    buckets[r] = [positions[a:b]]
                    queue.push(r)

        first = np.flatnonzero(rank != NONE)
        if len(first):
            push(first)
        while (r := queue.pop()) >= 0:
            parts = buckets.pop(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[rank[p] == r]
            if not len(p):
                continue
            if len(p) > 1:
                if self.unsafe[r]:
                    lead = np.ones(len(p), bool)
                    lead[1:] = owner[p[1:]] != owner[p[:-1]]
                    if not lead.all():
                        buckets[r] = [p[~lead]]
                        queue.push(r)
                        p = p[lead]
                elif (chained := after[p[:-1]] == p[1:]).any():
                    place = np.arange(len(p))
                    head = np.ones(len(p), bool)
                    head[1:] = ~chained
                    p = p[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            q = after[p]
            then = after[q]
            sym[p] = self.made[r]
            rank[q] = NONE
            real[q] = False
            after[p], before[then] = then, p
            left = before[p]
            rank[p] = self.look_up(sym[p], sym[then])
            rank[left] = self.look_up(sym[left], sym[p])
            both = np.concatenate((p, left))
            both = both[rank[both] != NONE]
            if len(both):
                push(both)
        kept = np.cumsum(real)
        return sym[real], np.diff(kept[edges])


class ByteVocabulary:
    """A rank file's tokens: bytes to rank, where every pair whose bytes are a token may merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.rank.values()) + 1
        left, right, rank = [], [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.merges = Merges(left, right, rank, rank, size)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        ordered = sorted((r, token) for token, r in self.rank.items())
        self.length = np.zeros(size, np.int64)
        self.length[[r for r, _ in ordered]] = [len(t) for _, t in ordered]
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(t for _, t in ordered), np.uint8)
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each pre-token's ids as little-endian unsigned 32-bit integers."""
        found = list(map(self.known.get, pieces))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            fresh: dict[str, bytes] = {}
            hard = []
            for p in {pieces[i] for i in missing}:
                whole = self.rank.get(raw := p.encode())
                if whole is None:
                    hard.append((p, raw))
                else:
                    fresh[p] = whole.to_bytes(4, "little")
            if hard:
                symbols = self.byte[np.frombuffer(b"".join(raw for _, raw in hard), np.uint8)]
                ids, counts = self.merges.run(symbols, np.array([len(raw) for _, raw in hard]))
                raw_ids, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                at = 0
                for (p, _), end in zip(hard, ends, strict=True):
                    fresh[p] = raw_ids[at:end]
                    at = end
            if len(self.known) < MEMORY:
                self.known.update(fresh)
            for i in missing:
                found[i] = fresh[pieces[i]]
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes in a row."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.place[ids] - (ends - lengths), lengths)].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteVocabulary:
    """One for each worker process."""
    return ByteVocabulary(path)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    return regex.compile(pattern)


def split_texts(texts: list[str], pattern: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """(pre-tokens, [(text, how many)]) in blocks; the pre-tokens of a long text come in several."""
    find = splitter(pattern)
    pieces: list[str] = []
    shares: list[tuple[int, int]] = []
    for i, text in enumerate(texts):
        if len(text) < BLOCK:
            own = find.findall(text)
            pieces += own
            shares.append((i, len(own)))
            if len(pieces) >= STEP:
                yield pieces, shares
                pieces, shares = [], []
        else:
            matches = find.finditer(text)
            while own := [m.group() for m in islice(matches, STEP)]:
                yield [*pieces, *own], [*shares, (i, len(own))]
                pieces, shares = [], []
    if shares:
        yield pieces, shares


def encode_texts(texts: list[str], path: str, pattern: str) -> list[np.ndarray]:
    """Ids of each text."""
    vocab, out = vocabulary(path), [[] for _ in texts]
    for pieces, shares in split_texts(texts, pattern):
        found, at = vocab.encode_pieces(pieces), 0
        for i, n in shares:
            out[i].append(b"".join(found[at : at + n]))
            at += n
    return [np.frombuffer(b"".join(parts), "<u4") for parts in out]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    return vocabulary(path).decode(ids)


def encode_documents(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, ids (array<int>) of every row.

    A null text reads as empty: no ids, the hashes of nothing.  Rows are handled one for one, copies
    and null ids included; an empty table gives an empty result; other columns are not read.
    """
    arrow_limits(df.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, kept = [0] * len(texts), [[] for _ in texts]
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
            for pieces, shares in split_texts(texts, pattern):
                found, at = vocab.encode_pieces(pieces), 0
                for i, n in shares:
                    raw = b"".join(found[at : at + n])
                    at += n
                    ids = np.frombuffer(raw, "<u4")
                    counts[i] += len(ids)
                    hashes[i][0].update(raw)
                    hashes[i][1].update(vocab.decode(ids))
                    if with_ids:
                        kept[i].append(ids.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array([a.hexdigest() for a, _ in hashes], pa.string()), pa.array([b.hexdigest() for _, b in hashes], pa.string())]
            if with_ids:
                columns.append(pa.array([np.concatenate(k) if k else np.zeros(0, np.int32) for k in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(encode, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' * with_ids}")


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)

"""Byte-level BPE: pre-tokens, pair counts, training, encoding, decoding.

Pre-tokenizing, counting and pair statistics are DataFrame operations over distinct pre-tokens; training
runs over them in ``bpe_training``, many merges to a job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import SPACE
from .bpe_training import Words, code, encode_lists, learn_merges
from .shared import SharedTable, bounded_batches
from .windows import MAX_VOCAB, check_vocab

_LETTERS = r"\p{L}\p{Nl}\p{No}"
# Fixed value: contractions, letters, digits, signs, blanks; together they cover every character.
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?[{_LETTERS}]+| ?\p{{Nd}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# The same with every digit, and a blank before one, as a piece of its own.
_SINGLE_DIGITS = PATTERN.replace(r" ?\p{Nd}+", r"\p{Nd}| (?=\p{Nd})")
END_OF_TEXT = "<|endoftext|>"


def split_digits(pieces: Column) -> Column:
    """Pieces with a digit become single characters: a blank in front is a piece of its own."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p.rlike(r"\p{Nd}"), F.regexp_extract_all(p, F.lit("(?s)."), F.lit(0))).otherwise(F.array(p))))


def pretokenize(text: Column) -> Column:
    """A text's pieces; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_SINGLE_DIGITS), F.lit(0))


def piece_totals(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pieces, characters, kinds of each key that has a piece.

    A key of one row is counted inside its row; only the pieces of keys that repeat are shuffled."""
    repeated = SharedTable(df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"), "repeated-keys").read()
    same = F.col(key).eqNullSafe(F.col("_key"))
    cut = df.select(key, pretokenize(F.col(text)).alias("_pieces"), F.length(text).cast("long").alias("characters"))
    once = cut.join(repeated, same, "left_anti").where(F.size("_pieces") > 0).select(key, F.size("_pieces").cast("long").alias("pieces"), "characters", F.size(F.array_distinct("_pieces")).cast("long").alias("kinds"))
    several = df.join(repeated, same, "left_semi").select(key, F.explode(pretokenize(F.col(text))).alias("piece"))
    return once.unionAll(several.groupBy(key).agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("characters"), F.countDistinct("piece").alias("kinds")))


def without_specials(text: Column, specials: tuple[str, ...] = (END_OF_TEXT,)) -> Column:
    """The parts of a text between special tokens."""
    longest_first = sorted(specials, key=len, reverse=True)
    return F.split(text, "|".join(re.escape(s) for s in longest_first), -1)


def count_pieces(df: DataFrame, text: str = "text", specials: tuple[str, ...] = (END_OF_TEXT,)) -> DataFrame:
    """piece, freq: how often each pre-token occurs; combined on the map side."""
    parts = df.select(F.explode(without_specials(F.col(text), specials)).alias("t")) if specials else df.select(F.col(text).alias("t"))
    return parts.select(F.explode(pretokenize(F.col("t"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))


@F.arrow_udf(ArrayType(IntegerType()))
def byte_ids(piece: pa.Array) -> pa.Array:
    """UTF-8 bytes as an array of integers; whole batches at a time."""
    raw = piece.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    values = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32)), pa.array(values.astype(np.int32)), mask=piece.is_null())


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, n over rows (ids, freq): adjacent pairs, overlapping ones included."""
    ids, n = F.col("ids"), F.size("ids")
    pairs = F.arrays_zip(F.slice(ids, 1, n - 1).alias("left"), F.slice(ids, 2, n - 1).alias("right"))
    return words.where(n > 1).select("freq", F.explode(pairs).alias("p")).groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("freq").alias("n"))


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the one with the largest ids."""
    return pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(1)


def apply_merge(ids: Column, left: int, right: int, new: int) -> Column:
    """Replace the pair from left to right, without overlaps: in the ids as text, each with its own marks, in
    one pass."""
    marked = F.concat(F.lit(" "), F.array_join(ids.cast("array<string>"), "; "), F.lit(";"))
    done = F.replace(marked, F.lit(f" {left}; {right};"), F.lit(f" {new};"))
    return F.when(F.size(ids) > 1, F.split(F.btrim(done, F.lit(" ;")), "; ").cast("array<int>")).otherwise(ids)


class Tokenizer:
    """Vocabulary and merges, with special tokens behind the last merge."""

    def __init__(self, merges: list[tuple[int, int]], specials: tuple[str, ...] = (END_OF_TEXT,)) -> None:
        self.tokens = [bytes([b]) for b in range(256)]
        for a, b in merges:
            self.tokens.append(self.tokens[a] + self.tokens[b])
        self.merges = merges
        self.rank = {pair: r for r, pair in enumerate(merges)}
        self.specials = {s: len(self.tokens) + k for k, s in enumerate(specials)}

    @property
    def size(self) -> int:
        return len(self.tokens) + len(self.specials)

    def add_specials(self, names: list[str]) -> list[int]:
        """Ids of the special tokens; new ones follow the largest id."""
        for name in names:
            self.specials.setdefault(name, max([len(self.tokens) - 1, *self.specials.values()]) + 1)
        return [self.specials[n] for n in names]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has: in every piece the pair of lowest rank is
        merged, the leftmost of equals, until none is left. Time grows with n log n, for one long piece too."""
        if not hasattr(self, "_pairs"):
            codes = np.array([code(a, b) for a, b in self.merges], np.int64)
            self._ranks = np.argsort(codes, kind="stable")
            self._pairs = codes[self._ranks]
        lengths = np.array([len(p) for p in pieces], np.int64)
        words = Words(np.frombuffer(b"".join(pieces), np.uint8), lengths, np.ones(len(pieces), np.int64))
        return encode_lists(words, self._pairs, self._ranks)

    def encode_piece(self, piece: bytes) -> list[int]:
        return self.encode_pieces([piece])[0].tolist()

    def decode(self, ids) -> str:
        """Tokens' bytes as text; unknown ids give nothing, broken UTF-8 gives U+FFFD."""
        names = {i: s.encode() for s, i in self.specials.items()}
        return b"".join(names.get(i) or (self.tokens[i] if 0 <= i < len(self.tokens) else b"") for i in ids).decode("utf-8", "replace")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(self.tokens)] + [(i, bytearray(s.encode())) for s, i in self.specials.items()], "token_id int, token binary")

    def save(self, path) -> None:
        """JSON; bytes are written as Latin-1."""
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"version": 1, "special_tokens": self.specials, "vocab": {t.decode("latin-1"): i for i, t in enumerate(self.tokens)}, "merges": [[self.tokens[a].decode("latin-1"), self.tokens[b].decode("latin-1")] for a, b in self.merges]}, out, ensure_ascii=False)

    @classmethod
    def load(cls, path) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        ids = data["vocab"]
        made = cls([(ids[a], ids[b]) for a, b in data["merges"]], ())
        made.specials = dict(data["special_tokens"])
        return made


def published_tokenizer(path, merges: int | None = None, specials: tuple[str, ...] = (END_OF_TEXT,)) -> Tokenizer:
    """A byte-level vocabulary's JSON file as a tokenizer, with its first ``merges`` merges or all of them.

    A letter of such a file stands for a byte: printable bytes for themselves, the others, in order, for the
    characters from U+0100 on."""
    with open(path, encoding="utf-8") as f:
        listed = json.load(f)["model"]["merges"]
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    ids = {c: b for b, c in letter.items()}
    out = []
    for entry in listed[:merges]:
        left, right = entry.split(" ") if isinstance(entry, str) else entry
        out.append((ids[left], ids[right]))
        ids.setdefault(left + right, 256 + len(out) - 1)
    return Tokenizer(out, specials)


def train_bpe(df: DataFrame, vocab_size: int, text: str = "text", specials: tuple[str, ...] = (END_OF_TEXT,)) -> Tokenizer:
    """Spark counts the distinct pre-tokens and merges them. A vocabulary with no room for a merge is an error."""
    merges = vocab_size - 256 - len(specials)
    if merges <= 0:
        raise ValueError(f"vocab_size must exceed {256 + len(specials)}")
    return Tokenizer(learn_merges(count_pieces(df, text, specials).select(byte_ids(F.col("piece")).alias("ids"), "freq"), merges), specials)


#: Bytes that a worker's remembered pieces take, and what one takes beyond its own bytes and ids in Python.
REMEMBERED, PIECE_BYTES = 48 << 20, 320


class _Dictionary:
    """Pieces that a worker has met, with their ids; forgotten when they pass REMEMBERED bytes, what Python
    needs for each included."""

    def __init__(self, tokenizer: Tokenizer, whole: list[str]) -> None:
        self.tokenizer, self.whole = tokenizer, {s: np.array([tokenizer.specials[s]], np.int32) for s in whole}
        self.known: dict[str, np.ndarray] = dict(self.whole)
        self.bytes = 0

    def ids(self, pieces: list[str]) -> list[np.ndarray]:
        found = [self.known.get(p) for p in pieces]
        missing = [k for k, x in enumerate(found) if x is None]
        if not missing:
            return found
        flat, lengths = self.tokenizer.encode_pieces([pieces[k].encode() for k in missing])
        flat, ends = flat.astype(np.int32), np.cumsum(lengths).tolist()
        for k, begin, end in zip(missing, [0, *ends[:-1]], ends, strict=True):
            # A copy, as a view would keep the ids of all the batch's new pieces.
            found[k] = ids = flat[begin:end].copy()
            size = PIECE_BYTES + len(pieces[k]) + ids.nbytes
            if size > REMEMBERED:
                continue
            if self.bytes + size > REMEMBERED:
                self.known, self.bytes = dict(self.whole), 0
            self.known[pieces[k]] = ids
            self.bytes += size
        return found


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "ids", allow_special: bool = True) -> DataFrame:
    """Adds the array of token ids; null for a null text.

    A batch's distinct pieces are looked up or encoded together, then put in place by their numbers, so the
    work on a piece is done once for each batch and worker, and no row of pieces is shuffled."""
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)
    specials = sorted(tokenizer.specials, key=len, reverse=True) if allow_special else []
    parts = F.regexp_extract_all(F.col(text), F.lit("(?s)" + "|".join([*map(re.escape, specials), rf"(?:(?!{'|'.join(map(re.escape, specials))}).)+" if specials else ".+"])), F.lit(0))
    # Only a text with a special token has more than one part.
    held = [F.contains(F.col(text), F.lit(s)) for s in specials]
    apart = F.flatten(F.transform(parts, lambda p: F.when(p.isin(specials), F.array(p)).otherwise(pretokenize(p)))) if specials else None
    pieces = F.when(reduce(or_, held), apart).otherwise(pretokenize(F.col(text))) if specials else pretokenize(F.col(text))

    names = [*df.columns, out]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Dictionary(sent.value, specials)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            coded = rows.flatten().dictionary_encode()
            found = known.ids(coded.dictionary.to_pylist())
            edges = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            each = pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, pa.int32()))
            put = each.take(coded.indices)
            ends = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            taken = np.concatenate([[0], np.cumsum(np.diff(edges)[coded.indices.to_numpy()])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(taken[ends]), put.flatten(), mask=rows.is_null() if rows.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("_pieces", pieces).mapInArrow(work, f"{fields}, {out} array<int>")


def decode(df: DataFrame, vocabulary: DataFrame, keys: list[str], ids: str = "ids", out: str = "text") -> DataFrame:
    """Text from ids, row by row; unknown ids give nothing, rows with no ids the empty text.

    The vocabulary goes to the workers: a file of ids of 16 bits bounds it to MAX_VOCAB tokens."""
    known = vocabulary.limit(MAX_VOCAB + 1).collect()
    check_vocab(len(known))
    bounded_batches(df.sparkSession)
    named = {r.token_id: bytes(r.token) for r in known if r.token_id is not None}
    order = sorted(named)
    ends = np.cumsum([0, *(len(named[i]) for i in order)])
    sent = df.sparkSession.sparkContext.broadcast((np.array(order, np.int64), ends, np.frombuffer(b"".join(named[i] for i in order), np.uint8)))

    @F.arrow_udf("binary")
    def joined(rows: pa.Array) -> pa.Array:
        known, edges, data = sent.value
        lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = rows.flatten()
        held = flat.is_valid().to_numpy(zero_copy_only=False)
        text, sizes = _token_bytes(flat.fill_null(0).to_numpy(zero_copy_only=False), held, known, edges, data)
        before = np.concatenate([[0], np.cumsum(sizes)])
        cuts = before[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(text)]).cast(pa.binary())

    return df.select(*keys, F.make_valid_utf8(joined(F.col(ids)).cast("string")).alias(out))


def _token_bytes(ids: np.ndarray, held: np.ndarray, known: np.ndarray, edges: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids in a row, and how many each has, none if it isn't ``held``; ``known`` ids lie in ``data`` between ``edges``."""
    if not len(known):
        return np.zeros(0, np.uint8), np.zeros(len(ids), np.int64)
    place = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    sizes = np.where(held & (known[place] == ids), edges[place + 1] - edges[place], 0)
    shift = edges[place] - (np.cumsum(sizes) - sizes)
    return data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def compression(df: DataFrame, text: str = "text", ids: str = "ids", by: str = "lang") -> DataFrame:
    """Characters and bytes for each token."""
    tokens = F.sum(F.size(ids))
    return df.groupBy(by).agg(F.try_divide(F.sum(F.length(text)), tokens).alias("chars_per_token"), F.try_divide(F.sum(F.octet_length(text)), tokens).alias("bytes_per_token"))

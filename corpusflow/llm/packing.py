"""Packing documents into token windows with bounded space.

Each partition keeps OPEN windows open.  A piece goes to the open window it fits best; if it fits
none, the fullest window is emitted and a new one opened.  What is open at the end of the partitions
is merged in a tree of groups, each of which again keeps at most OPEN windows.  Documents longer than
a window give full windows, and only their rest is placed, so no other document is cut.

Ids are those of the `tokenizers` library for the given file.  Words of Latin letters, digits and
signs are merged here in bulk (see bpe.py) and remembered; any other word goes to the library.
The string of an added token in a text gives that token, as in the library.  Defined results: a null or empty text is its end
id alone; every row is packed once, copies and null ids included; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import arrow_limits, stored

WINDOW = 4096
OPEN = 64
FAN_IN = 16
END_ID = 2
#: Words a worker remembers, first come.
MEMORY = 500_000
BLOCK = 8 << 20
#: Words whose ids are found here: no controls, no spaces, nothing that normalisation recombines.
_PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-įı-ɏ]+")
#: Signs that are a piece of their own behind a word.
_STOPS = frozenset(b".,;:!?")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordVocabulary:
    """A BPE file with word ends, whose tokens never cross white space."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        #: Strings that the library takes for a token before it looks at words.
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.added_start = commonprefix(self.added)
        steps = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.split = regex.compile(steps["pattern"]["Regex"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = Merges([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], range(len(pairs)), [vocab[a + b] for a, b in pairs], max(vocab.values()) + 1)
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.known: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        found = list(map(self.known.get, words))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            fresh, plain, pieces = {}, [], []
            for word in {words[i] for i in missing}:
                if word.isalpha():
                    plain.append((word, 1))
                    pieces.append(word.lower())
                    continue
                if word[-1] in _STOPS and word[:-1].isalpha():
                    plain.append((word, 2))
                    pieces += (word[:-1].lower(), word[-1:])
                    continue
                text = word.decode()
                if _PLAIN.fullmatch(text) and not (self.added_start in word and any(a in word for a in self.added)):
                    own = [p.encode() for p in self.split.findall(text.lower())]
                    plain.append((word, len(own)))
                    pieces += own
                else:
                    fresh[word] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if plain:
                lengths = np.array([len(p) for p in pieces], np.int64)
                raw = np.frombuffer(b"".join(pieces), np.uint8)
                symbols, last = self.inner[raw], np.cumsum(lengths) - 1
                symbols[last] = self.final[raw[last]]
                ids, counts = self.merges.run(symbols, lengths)
                raw_ids = ids.astype("<u4").tobytes()
                ends = np.concatenate(([0], 4 * np.cumsum(counts)))
                edges = np.cumsum([n for _, n in plain])
                at = 0
                for (word, _), end in zip(plain, ends[edges].tolist(), strict=True):
                    fresh[word] = raw_ids[at:end]
                    at = end
            if len(self.known) < MEMORY:
                self.known.update(fresh)
            for i in missing:
                found[i] = fresh[words[i]]
        return found

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in blocks of about BLOCK characters."""
        at = 0
        while at < len(texts):
            end, size, words, counts = at, 0, [], []
            while end < len(texts) and (end == at or size < BLOCK):
                own = texts[end].encode().split()
                words += own
                counts.append(len(own))
                size += len(texts[end])
                end += 1
            found, first = self.encode_words(words), 0
            for n in counts:
                yield b"".join(found[first : first + n])
                first += n
            at = end


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One for each worker process."""
    return WordVocabulary(path)


class OpenWindows:
    """At most ``most`` open windows in order of free room."""

    def __init__(self, most: int, capacity: int) -> None:
        self.most, self.capacity = most, capacity
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, size: int, item) -> list[tuple[int, list]]:
        """Put an item into the window it fits best; what had to be emitted for it."""
        out = []
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, window = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                fullest = self.room.pop(0)[1]
                out.append((fullest, self.held.pop(fullest)))
            free, window = self.capacity, self.next
            self.next += 1
            self.held[window] = []
        self.held[window].append((self.capacity - free, item))
        if free > size:
            insort(self.room, (free - size, window))
        else:
            out.append((window, self.held.pop(window)))
        return out

    def rest(self) -> list[tuple[int, list]]:
        return list(self.held.items())


_PIECE = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("window", pa.int64()), ("place", pa.int64()), ("closed", pa.bool_())])


def place_pieces(df: DataFrame, path: str, doc_id: str, text: str, window: int, most: int) -> DataFrame:
    """One row for each piece with the partition's window it lies in; ``closed`` if that was emitted."""
    arrow_limits(df.sparkSession)
    id_field = df.select(F.col(doc_id).alias("doc_id")).schema["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, vocab, windows = TaskContext.get().partitionId(), vocabulary(path), OpenWindows(most, window)
        end = END_ID.to_bytes(4, "little")
        id_type = None

        def rows(emitted, closed):
            flat = [(doc, start, n, crc, total, part, w, at, closed) for w, items in emitted for at, (doc, start, n, crc, total) in items]
            if not flat:
                return []
            doc, *rest = zip(*flat, strict=True)
            return [pa.RecordBatch.from_arrays([pa.array(doc, id_type), *(pa.array(c, f.type) for c, f in zip(rest, _PIECE, strict=True))], names=["doc_id", *_PIECE.names])]

        for batch in batches:
            id_type = batch.column(0).type
            emitted = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, raw in zip(batch.column(0).to_pylist(), vocab.encode_texts(texts), strict=True):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    n = min(window, total - start)
                    emitted += windows.place(n, (doc, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), total))
            yield from rows(emitted, True)
        yield from rows(windows.rest(), False)

    fields = "start long, length long, ids_crc32 long, doc_tokens long, part long, window long, place long, closed boolean"
    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(place, f"doc_id {id_field.dataType.simpleString()}, {fields}")


_OPEN = "part long, window long, used long, members array<struct<part:long,window:long,base:long>>, open boolean"


def merge_leftovers(pieces: DataFrame, window: int, most: int) -> DataFrame:
    """Where each open window goes: part, window, to_part, to_window, base."""
    left = pieces.where(~F.col("closed")).groupBy("part", "window").agg(F.sum("length").alias("used"))
    left = stored(left.select("part", "window", "used", F.array(F.struct("part", "window", F.lit(0).cast("long").alias("base"))).alias("members"), F.lit(True).alias("open")), "open-windows")
    last = left.agg(F.max("part")).first()[0]
    groups, span, done = 0 if last is None else last + 1, 1, []

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["used"], r["part"], r["window"]))
        bins = OpenWindows(len(rows) + 1, window)
        filled = []
        for r in rows:
            filled += bins.place(r["used"], r)
        merged = []
        for is_open, some in ((False, filled), (True, bins.rest())):
            for _, items in some:
                first = items[0][1]
                members = [{"part": m["part"], "window": m["window"], "base": m["base"] + at} for at, r in items for m in r["members"]]
                merged.append({"part": first["part"], "window": first["window"], "used": sum(r["used"] for _, r in items), "members": members, "open": is_open})
        still = sorted((m for m in merged if m["open"]), key=lambda m: (m["used"], m["part"], m["window"]))
        for m in still[most:]:
            m["open"] = False
        return pa.Table.from_pylist(merged, schema=table.schema)

    while groups:
        span *= FAN_IN
        level = stored(left.groupBy(F.floor(F.col("part") / span).alias("_group")).applyInArrow(join, _OPEN), "open-windows")
        groups = -(-groups // FAN_IN)
        done.append(level if groups == 1 else level.where(~F.col("open")))
        left = level.where("open")
        if groups == 1:
            break
    merged = done[0] if done else left
    for more in done[1:]:
        merged = merged.unionAll(more)
    return merged.select(F.col("part").alias("to_part"), F.col("window").alias("to_window"), F.explode("members").alias("m")).select("m.part", "m.window", "to_part", "to_window", "m.base")


def pack_documents(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    pieces = stored(place_pieces(df, path, doc_id, text, window, most), "pieces")
    moves = merge_leftovers(pieces, window, most)
    number = lambda part, window: F.shiftleft(F.col(part), 32) + F.col(window)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    closed = pieces.where("closed").select(*columns, number("part", "window").alias("sequence_id"), F.col("place").alias("offset"))
    moved = pieces.where(~F.col("closed")).join(moves, ["part", "window"]).select(*columns, number("to_part", "to_window").alias("sequence_id"), (F.col("place") + F.col("base")).alias("offset"))
    return closed.unionAll(moved)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))

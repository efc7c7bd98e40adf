"""A hidden Markov language model: Baum-Welch counts summed across partitions, scoring by the scaled
forward recursion.

Tokens are lower-cased words and one end per text.  States emit classes: each of the OWN most common
words is a class, every other word falls into one of TAIL classes by its last letters and length, and
the end is a class.  Within a tail class a word has its discounted share of the class's training
tokens; what the discount frees is the share of words not seen in training.  So the model's size is
fixed while its word counts cover every training text, and the probability of a text is exact:
forward recursion over its classes, times the words' shares.

The states start from the class counts of all training texts; every one of the ROUNDS rounds of Baum-Welch
runs over all of them, in segments of SEGMENT tokens.  Counts of the HOT most common words go to
the workers as a table; all others are joined.

Defined results: a null or empty text is the end alone; rows come back once each, copies included; a
row with a null id is a training row; with no training text every class is equally likely and every
word unseen; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, SPACE, U64, mix, text_buffers, word_spans
from .common import Stored, arrow_limits, held_out, stored, summed

STATES, OWN, TAIL, HOT = 8, 2048, 1024, 200_000
CLASSES = OWN + TAIL + 1
END = CLASSES - 1
SEGMENT, SEGMENTS = 64, 1024
#: Steps between two scalings of Baum-Welch's forward rows.
RESCALE = 8
ROUNDS = 14
#: Distinct words a task holds before it hands their counts on.
COUNTED = 2_000_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word names, tail classes, pointers) of the words of each text."""
    data, offsets = text_buffers(column)
    names, starts, pointers = word_spans(data, offsets)
    if not len(starts):
        return names, np.zeros(0, np.int64), pointers
    stop = starts + np.add.reduceat(~SPACE[data], starts, dtype=np.int64)
    key = np.minimum(stop - starts, 12).astype(U64)
    for back in (1, 2, 3):
        at = np.maximum(stop - back, starts)
        key = key * U64(257) + LOWER[data[at]].astype(U64)
    return names, (mix(key + U64(1)) % U64(TAIL)).astype(np.int64), pointers


def count_words(df: DataFrame, text: str) -> DataFrame:
    """word (name), tail class and count over every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64)), pa.array(held[1]), pa.array(held[2])], names=["word", "tail", "count"])

        for batch in batches:
            names, tail, _ = tokens(batch.column(0))
            new, first, more = np.unique(names, return_index=True, return_counts=True)
            both, at, place = np.unique(np.concatenate([held[0], new]), return_index=True, return_inverse=True)
            tails = np.concatenate([held[1], tail[first]])[at]
            held = both, tails, np.bincount(place, np.concatenate([held[2], more]), len(both)).astype(np.int64)
            if len(both) > COUNTED:
                yield rows()
                held = held[0][:0], held[1][:0], held[2][:0]
        yield rows()

    return df.select(text).mapInArrow(count, "word long, tail long, count long").groupBy("word", "tail").agg(F.sum("count").alias("count"))


class Lexicon:
    """Counts of the hot words, classes, and the tail classes' shares."""

    def __init__(self, hot: pa.Table, total: int, distinct: int, texts: int, by_tail: list) -> None:
        names, tail, count = (np.asarray(hot[c], np.int64) for c in ("word", "tail", "count"))
        own = np.where(np.arange(len(names)) < OWN, np.arange(len(names)), OWN + tail)
        order = np.argsort(names.view(U64))
        self.names, self.count, self.classes = names.view(U64)[order], count[order], own[order]
        self.total, self.distinct, self.texts = total, distinct, texts
        # Tail classes: tokens, types and the discount n1 / (n1 + 2 n2), the own words left out.
        self.tail = np.zeros((TAIL, 4))
        for row in by_tail:
            self.tail[row.tail] = row.tokens, row.types, row.once, row.twice
        self.discount = np.clip(self.tail[:, 2] / np.maximum(self.tail[:, 2] + 2 * self.tail[:, 3], 1), 0.1, 0.9)
        tokens_ = np.maximum(self.tail[:, 0], 1)
        unseen = np.where(self.tail[:, 0] > 0, self.discount * self.tail[:, 1] / tokens_, 1.0)
        self.unseen_log10, self.tokens_log10 = np.log10(unseen), np.log10(tokens_)

    def look_up(self, names: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def share_log10(self, count: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of known words' shares in their classes."""
        k = np.maximum(classes - OWN, 0)
        return np.where(classes < OWN, 0.0, np.log10(np.maximum(count - self.discount[k], 1e-9)) - self.tokens_log10[k])


def _lexicon(counts: DataFrame, texts: int) -> Lexicon:
    hot = counts.orderBy(F.desc("count"), "word").limit(HOT).toArrow()
    own = counts.sparkSession.createDataFrame([(int(w),) for w in hot["word"][:OWN].to_pylist()], "word long")
    sums = counts.agg(F.sum("count").alias("total"), F.count("*").alias("distinct")).first()
    by_tail = counts.join(F.broadcast(own), "word", "left_anti").groupBy("tail").agg(F.sum("count").alias("tokens"), F.count("*").alias("types"), F.sum((F.col("count") == 1).cast("long")).alias("once"), F.sum((F.col("count") == 2).cast("long")).alias("twice"))
    return Lexicon(hot, (sums.total or 0) + texts, sums.distinct + (1 if texts else 0), texts, by_tail.collect())


def _encoded(df: DataFrame, lexicon, doc_id: str, text: str, learns: Column) -> Stored:
    """Each row's classes, the sums over its hot words, and its other words."""
    names = ["id", "doc_id", "learns", "n_tokens", "n_known", "count_log10", "share_log10", "classes", "rest"]
    rest_type = pa.list_(pa.struct([("word", pa.int64()), ("tail", pa.int32())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, first = lexicon.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            words, tail, pointers = tokens(batch.column(2))
            rows = len(batch)
            at = lex.look_up(words)
            hot = at >= 0
            count = np.where(hot, lex.count[at] if len(lex.count) else 0, 0)
            classes = np.where(hot, lex.classes[at] if len(lex.count) else 0, OWN + tail)

            def by_row(values, pointers=pointers):
                sums = np.concatenate(([0], np.cumsum(values)))
                return sums[pointers[1:]] - sums[pointers[:-1]]

            known = by_row(hot) + (1 if lex.texts else 0)
            count_log = by_row(np.where(hot, np.log10(count + 1.0), 0.0)) + np.log10(lex.texts + 1.0)
            share_log = by_row(np.where(hot, lex.share_log10(count, classes), 0.0))
            with_end = np.insert(classes, pointers[1:], END).astype(np.uint16)
            ends = pointers + np.arange(rows + 1)
            raw = with_end.tobytes()
            cold = np.flatnonzero(~hot)
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, pointers).astype(np.int32)), pa.StructArray.from_arrays([pa.array(words[cold].view(np.int64)), pa.array(tail[cold].astype(np.int32))], names=["word", "tail"]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), batch.column(0), batch.column(1), pa.array(np.diff(ends)), pa.array(known.astype(np.int64)), pa.array(count_log), pa.array(share_log), pa.array([raw[2 * a : 2 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), rest.cast(rest_type)], names=names)
            first += rows

    id_type = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("doc_id"), learns.alias("learns"), F.col(text).alias("text"))
    return Stored(rows.mapInArrow(encode, f"id long, doc_id {id_type}, learns boolean, n_tokens long, n_known long, count_log10 double, share_log10 double, classes binary, rest array<struct<word:long,tail:int>>"), "encoded")


class Parameters:
    """Start probabilities of texts and of later segments, transitions and emissions."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        self.start, self.moves, self.emits = start, moves, emits
        self.by_class = np.ascontiguousarray(emits.T)

    @classmethod
    def first(cls, usual: np.ndarray, seed: int = 7) -> Parameters:
        random = np.random.default_rng(seed)
        emits = (usual + 1e-9)[None, :] * random.gamma(2.0, 1.0, (STATES, CLASSES))
        moves = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full((2, STATES), 1 / STATES), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))

    @classmethod
    def of(cls, counts: np.ndarray) -> Parameters:
        """Maximisation, with a little of the overall class shares in every state."""
        start, moves, emits = unpack(counts)
        usual = (emits.sum(0) + 0.5) / (emits.sum() + 0.5 * CLASSES)
        emits = emits + 2.0 * usual[None, :] + 1e-6
        start, moves = start + 0.5, moves + 0.5
        return cls(start / start.sum(1, keepdims=True), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


_SIZES = (2 * STATES, STATES * STATES, STATES * CLASSES)


def unpack(counts: np.ndarray):
    a, b = _SIZES[0], _SIZES[0] + _SIZES[1]
    return counts[:a].reshape(2, STATES), counts[a:b].reshape(STATES, STATES), counts[b:].reshape(STATES, CLASSES)


def segments(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes padded with CLASSES, lengths, 0 for a text's first segment and 1 for later ones)."""
    lengths = np.array([len(r) for r in rows], np.int64)
    each = -(-lengths // SEGMENT)
    first = np.cumsum(each) - each
    out = np.full((int(each.sum()), SEGMENT), CLASSES, np.int64)
    # A text's segments lie one after the other, so its tokens stay in one run.
    shift = first * SEGMENT - (np.cumsum(lengths) - lengths)
    out.ravel()[np.repeat(shift, lengths) + np.arange(lengths.sum())] = np.concatenate(rows)
    later = np.ones(len(out), np.int64)
    later[first[each > 0]] = 0
    sizes = np.full(len(out), SEGMENT)
    sizes[(first + each - 1)[each > 0]] = (lengths - (each - 1) * SEGMENT)[each > 0]
    return out, sizes, later


def expected_counts(p: Parameters, classes: np.ndarray, lengths: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of a block of segments.

    Longest segments lie first, so step t works on the first ``active[t]`` of them only.  Rows of states
    are contiguous over segments; posteriors don't depend on a factor of a class's emissions, so each class
    is scaled to at most 1 and forward rows need scaling at every RESCALE-th step only.
    """
    order = np.argsort(-lengths, kind="stable")
    lengths, later = lengths[order], later[order]
    n, steps = len(lengths), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    at = np.concatenate(([0], np.cumsum(active)))
    by_step = classes[order, :steps].T
    flat = by_step[np.arange(n) < active[:, None]]
    seen = np.take(p.emits / p.emits.max(0), flat, axis=1, mode="clip")
    alpha, back, scales = np.empty_like(seen), np.ascontiguousarray(p.moves.T), {}
    for t in range(steps):
        a, m = at[t], active[t]
        here = alpha[:, a : a + m]
        before = p.start.T[:, later] if t == 0 else back @ alpha[:, at[t - 1] : at[t - 1] + m]
        np.multiply(before, seen[:, a : a + m], out=here)
        if t % RESCALE == RESCALE - 1:
            scales[t] = here.sum(0)
            here /= scales[t]
    total = np.zeros(sum(_SIZES))
    start, moves, emits = unpack(total)
    beta = np.empty((STATES, n))
    for t in range(steps - 1, -1, -1):
        a, m = at[t], active[t]
        here, open_ = alpha[:, a : a + m], active[t + 1] if t + 1 < steps else 0
        beta[:, open_:m] = 1 / here[:, open_:].sum(0)
        now = beta[:, :m]
        ahead = seen[:, a : a + m]
        ahead *= now
        here *= now
        if t:
            if t in scales:
                ahead /= scales[t]
            moves += alpha[:, at[t - 1] : at[t - 1] + m] @ ahead.T
            np.matmul(p.moves, ahead, out=now)
    moves *= p.moves
    for k in range(STATES):
        emits[k] = np.bincount(flat, alpha[k], CLASSES)
        start[:, k] = np.bincount(later, alpha[k, :n], 2)
    return total


def _summed(encoded: DataFrame, count: Callable[[list[np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Counts over all training rows."""
    return summed(encoded.where("learns").select("classes"), lambda batch: count([np.frombuffer(r.as_py(), np.uint16) for r in batch.column(0)]), size)


def _round(encoded: DataFrame, p: Parameters) -> np.ndarray:
    """Baum-Welch counts over all training rows."""
    sent = encoded.sparkSession.sparkContext.broadcast(p)

    def count(rows: list[np.ndarray]) -> np.ndarray:
        classes, lengths, later = segments(rows)
        return sum(expected_counts(sent.value, classes[a : a + SEGMENTS], lengths[a : a + SEGMENTS], later[a : a + SEGMENTS]) for a in range(0, len(classes), SEGMENTS))

    return _summed(encoded, count, sum(_SIZES))


def train(encoded: DataFrame, rounds: int = ROUNDS) -> Parameters:
    counts = _summed(encoded, lambda rows: np.bincount(np.concatenate(rows), minlength=CLASSES), CLASSES)
    usual = counts + 0.1
    p = Parameters.first(usual / usual.sum())
    if counts.any():
        for _ in range(rounds):
            p = Parameters.of(_round(encoded, p))
    return p


def forward_log10(p: Parameters, rows: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each class sequence: scaled forward recursion over whole sequences."""
    lengths = np.array([len(r) for r in rows], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat, starts = np.concatenate(rows).astype(np.int64), np.cumsum(lengths) - lengths
    starts, sorted_lengths = starts[order], lengths[order]
    active = np.searchsorted(-sorted_lengths, -np.arange(lengths.max(initial=0)), side="left")
    out, now = np.zeros(len(rows)), None
    for t, n in enumerate(active.tolist()):
        seen = p.by_class[flat[starts[:n] + t]]
        now = p.start[0] * seen if now is None else (now[:n] @ p.moves) * seen
        scale = now.sum(1)
        now /= scale[:, None]
        out[order[:n]] += np.log(scale)
    return out / np.log(10)


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = df.sparkSession
    arrow_limits(spark)
    learns = ~held_out(F.col(doc_id), 7)
    texts = df.where(learns).count()
    counts = stored(count_words(df.where(learns), text), "word-counts")
    lex = _lexicon(counts, texts)
    encoded = _encoded(df, spark.sparkContext.broadcast(lex), doc_id, text, learns).read()
    sent = spark.sparkContext.broadcast(train(encoded, rounds))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(r.as_py(), np.uint16) for r in batch.column(0)]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(forward_log10(sent.value, rows))], names=[*kept, "forward_log10"])

    kept = ["id", "doc_id", "learns", "n_tokens", "n_known", "count_log10", "share_log10"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(*kept).schema.fields)
    scored = encoded.select("classes", *kept).mapInArrow(forward, f"{fields}, forward_log10 double")

    rest = encoded.select("id", F.explode("rest").alias("w")).select("id", F.col("w.word").alias("word"), F.col("w.tail").alias("tail"))
    shares = spark.createDataFrame([(k, float(lex.discount[k]), float(lex.tokens_log10[k]), float(lex.unseen_log10[k])) for k in range(TAIL)], "tail int, discount double, tokens_log10 double, unseen_log10 double")
    share = F.when(F.col("count").isNotNull(), F.log10(F.greatest(F.col("count") - F.col("discount"), F.lit(1e-9))) - F.col("tokens_log10")).otherwise(F.col("unseen_log10"))
    looked = rest.join(counts.select("word", "count"), "word", "left").join(F.broadcast(shares), "tail")
    sums = looked.groupBy("id").agg(F.count("count").alias("rest_known"), F.sum(F.log10(F.coalesce("count", F.lit(0)) + 1.0)).alias("rest_count"), F.sum(share).alias("rest_share"))
    whole = scored.join(sums, "id", "left")
    base = F.col("count_log10") + F.coalesce("rest_count", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(lex.total + lex.distinct + 1)))
    return whole.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("forward_log10") + F.col("share_log10") + F.coalesce("rest_share", F.lit(0.0))).alias("score"))


def op3_hmm_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and 5-letter pieces is trained in numpy from confirmed toxic
texts and unlabelled texts, with the class-prior-corrected risk: prior * risk of positives as
positive + max(0, risk of unlabelled as negative - prior * risk of positives as negative).  The prior
is the share of toxic rows among the labelled ones.

Positives are a bounded sample of labelled rows (POSITIVE_ROWS on average).  The unlabelled part is every
text outside the held-out fold: feature counts run over all of them, and so does each epoch's gradient, over
lists of telling features with the number of texts that have them.  Scoring reads whole texts.  Defined
results: a null or empty text scores the bias alone; with no positive example every score is 0;
repeated label rows count as one; every document row comes back once, copies and null ids included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64
from .common import Stored, arrow_limits, held_out, scratch, summed
from .langid import bounded_sample, pieces
from .letters import LetterWords, text_blocks

DIMENSIONS = 1 << 20
POSITIVE_ROWS = 3000
#: A feature is used if MIN_POSITIVE positive texts hold it, at least twice as often as unlabelled
#: texts do, MIN_Z standard errors above them.
MIN_POSITIVE, MIN_Z = 4, 6.0
THRESHOLD = 0.3
#: Each is a pass over the patterns of all unlabelled texts.
EPOCHS = 200
_WHOLE = U64(0x5851F42D4C957F2D)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(pointers, feature ids): the distinct hashed words and pieces of each text."""
    words = LetterWords(texts)
    every = np.arange(len(words.names))
    names, owner = pieces(words, every, 5)
    row = np.concatenate([words.text, words.text[owner]])
    feature = (np.concatenate([words.names ^ _WHOLE, names]) % U64(DIMENSIONS)).astype(np.int64)
    pairs = np.unique(row * DIMENSIONS + feature)
    return np.searchsorted(pairs // DIMENSIONS, np.arange(len(texts) + 1)), pairs % DIMENSIONS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse 0/1 rows."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        self.pointers = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        self.columns = np.concatenate(lists) if lists else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.pointers) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(weights[self.columns])))
        return sums[self.pointers[1:]] - sums[self.pointers[:-1]]

    def transposed_dot(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(values, np.diff(self.pointers)), size).astype(float)  # of no rows it is whole numbers

    def restrict(self, place: np.ndarray) -> Rows:
        """Renumber columns by ``place``; those at -1 go."""
        row = np.repeat(np.arange(len(self)), np.diff(self.pointers))
        new = place[self.columns]
        out = Rows([])
        out.columns = new[new >= 0]
        out.pointers = np.searchsorted(row[new >= 0], np.arange(len(self) + 1))
        return out


def telling_features(in_positive: np.ndarray, positives: int, in_unlabelled: np.ndarray, unlabelled: float) -> np.ndarray:
    """Features that positive texts hold far more often than unlabelled ones."""
    share = in_positive / positives
    usual = (in_unlabelled + 1) / (unlabelled + 2)
    z = (share - usual) / np.sqrt(usual * (1 - usual) / positives)
    return np.flatnonzero((in_positive >= MIN_POSITIVE) & (z > MIN_Z) & (share > 2 * usual))


def negative_sums(rows: Rows, times: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient of the summed risk of rows as negatives (the bias last), that sum, and the number of rows."""
    u = sigmoid(rows.dot(w) + w[-1])
    gradient = rows.transposed_dot(times * u, len(w))
    gradient[-1] = (times * u).sum()
    return np.append(gradient, [-(times * np.log1p(-np.minimum(u, 1 - 1e-12))).sum(), times.sum()])


def nn_pu_fit(positive: Rows, unlabelled: Rows | Callable[[np.ndarray], np.ndarray], prior: float, size: int, epochs: int = EPOCHS, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk with logistic loss; (weights, bias).

    ``unlabelled``: rows, or a function that returns their ``negative_sums`` at given weights."""
    sums = unlabelled if callable(unlabelled) else lambda w: negative_sums(unlabelled, np.ones(len(unlabelled)), w)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        p = sigmoid(positive.dot(w) + w[-1])
        *at_u, risk_u, n = sums(w)
        at_u = np.array(at_u) / n
        negative_risk = risk_u / n + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
        as_negative_p = -prior * p / len(p)
        if negative_risk >= 0:
            at_p = as_negative_p - prior * (1 - p) / len(p)
        else:  # the correction: walk the negative part back up
            at_p, at_u = -as_negative_p, -at_u
        gradient = positive.transposed_dot(at_p, size + 1) + at_u + l2 * w
        gradient[-1] = at_p.sum() + at_u[-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _collect_features(df: DataFrame) -> Rows:
    """Feature lists of a bounded sample of texts."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_blocks(batch.column(0)):
                pointers, found = features(texts)
                found = found.astype(np.int32)
                yield pa.RecordBatch.from_pydict({"f": [found[a:b].tobytes() for a, b in zip(pointers[:-1], pointers[1:], strict=True)]}, schema=pa.schema([("f", pa.binary())]))

    return Rows([np.frombuffer(r.f, np.int32).astype(np.int64) for r in df.select("text").mapInArrow(extract, "f binary").collect()])


def _text_counts(texts: DataFrame, held: np.ndarray) -> tuple[np.ndarray, float]:
    """(texts that hold each of the features ``held``, texts), over all texts."""
    place = np.full(DIMENSIONS, -1, np.int32)
    place[held] = np.arange(len(held))
    sent = texts.sparkSession.sparkContext.broadcast(place)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(len(held) + 1)
        for _, some in text_blocks(batch.column(0)):
            at = sent.value[features(some)[1]]
            total[:-1] += np.bincount(at[at >= 0], minlength=len(held))
            total[-1] += len(some)
        return total

    *counts, texts_ = summed(texts.select("text"), count, len(held) + 1)
    return np.array(counts), texts_


def _patterns(texts: DataFrame, held: np.ndarray) -> Stored:
    """f (places of the text's features in ``held``) and times: equal lists are counted once."""
    place = np.full(DIMENSIONS, -1, np.int32)
    place[held] = np.arange(len(held))
    sent = texts.sparkSession.sparkContext.broadcast(place)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in text_blocks(batch.column(0)):
                pointers, found = features(some)
                at = sent.value[found]
                kept = np.concatenate(([0], np.cumsum(at >= 0)))[pointers]
                raw = at[at >= 0].tobytes()
                yield pa.RecordBatch.from_pydict({"f": [raw[4 * a : 4 * b] for a, b in zip(kept[:-1], kept[1:], strict=True)]}, schema=pa.schema([("f", pa.binary())]))

    return Stored(texts.select("text").mapInArrow(extract, "f binary").groupBy("f").agg(F.count("*").alias("times")), "patterns")


def _sums_of(patterns: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """``negative_sums`` of all rows that the patterns stand for."""

    parts = patterns.rdd.getNumPartitions()

    def at(w: np.ndarray) -> np.ndarray:
        def count(batch: pa.RecordBatch) -> np.ndarray:
            rows = Rows([np.frombuffer(f.as_py(), np.int32).astype(np.int64) for f in batch.column(0)])
            return negative_sums(rows, np.asarray(batch.column(1), float), w)

        return summed(patterns, count, len(w) + 2, parts)

    return at


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", positive_rows: int = POSITIVE_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights by feature and bias, from rows outside the held-out fold."""
    arrow_limits(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(~held_out(F.col("doc_id"), 4) & F.col("text").isNotNull())
    counts = known.agg(F.count("toxic").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    none = np.zeros(DIMENSIONS, np.float32), -40.0
    if not counts.p:
        return none
    prior = min(max(counts.p / counts.n, 1e-3), 0.5)
    chosen = bounded_sample(known.where("toxic = 1"), positive_rows, "doc_id").select("doc_id")
    positive = _collect_features(texts.join(F.broadcast(chosen), "doc_id", "left_semi").limit(2 * positive_rows))
    if not len(positive):
        return none
    in_positive = np.bincount(positive.columns, minlength=DIMENSIONS)
    candidates = np.flatnonzero(in_positive >= MIN_POSITIVE)
    held = candidates[telling_features(in_positive[candidates], len(positive), *_text_counts(texts, candidates))]
    place = np.full(DIMENSIONS, -1)
    place[held] = np.arange(len(held))
    with scratch():
        w, bias = nn_pu_fit(positive.restrict(place), _sums_of(_patterns(texts, held).read()), prior, len(held), epochs)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[held] = w
    return weights, bias


def score_toxicity(docs: DataFrame, weights: np.ndarray, bias: float, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    spark = docs.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, b = sent.value
            parts = [np.zeros(0)]
            for _, texts in text_blocks(batch.column(0)):
                pointers, found = features(texts)
                sums = np.concatenate(([0.0], np.cumsum(w[found], dtype=float)))
                parts.append(sigmoid(sums[pointers[1:]] - sums[pointers[:-1]] + b))
            value = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=[*keep, "score", "predicted"])

    chosen = docs.select(F.col(text).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(score, f"{fields}{', ' if fields else ''}score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    return score_toxicity(rows, *fit_toxicity(docs, labels), keep=("doc_id", "held_out"))

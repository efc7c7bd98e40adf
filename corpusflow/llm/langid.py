"""Language identification, words first: a known word scores by its log frequency in each language;
an unseen word falls back to its 4-, 3-, 2- and 1-character pieces, the longest that are known.

Fitted on a sample of labelled rows, SAMPLE_ROWS on average, of which all words and pieces are kept;
prediction reads whole texts.  Defined results: a null text or one without a letter is
``und`` with score 0; rows without a language or id are scored like all others (rows without a
language teach nothing); ties go to the first language in sorted order; with nothing to learn from,
every row is ``und``.  Columns other than id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import U64
from .common import arrow_limits, held_out
from .letters import LetterWords, text_blocks

UNKNOWN = "und"
SAMPLE_ROWS = 8000
PIECES = (4, 3, 2, 1)
#: Added to every frequency, the same for languages with few examples and many.
FLOOR = 1e-6
#: Pieces at a word's first letter count as another kind than pieces inside it.
_HEAD = U64(0xA24BAED4963EE407)


def pieces(words: LetterWords, chosen: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, index into ``chosen``) of the n-letter pieces of the chosen words."""
    length = words.length[chosen]
    counts = np.maximum(length - n + 1, 0)
    owner = np.repeat(np.arange(len(chosen)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = words.start[chosen][owner] + inside
    names = words.span_names(start, np.full(len(start), n))
    names[inside == 0] ^= _HEAD
    return names ^ U64(n), owner


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """``rows`` rows on average, chosen by a hash of the key where they are; all, if there are no more."""
    share = int(min(1.0, rows / max(df.count(), 1)) * 2**40)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(29)), F.lit(2**40)) < share)


class LanguageModel:
    """Sorted tables of names and their log frequencies in each language."""

    def __init__(self, languages: list[str], words, by_piece) -> None:
        self.languages, self.words, self.by_piece = languages, words, by_piece

    @staticmethod
    def table(names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(names)
        names, counts = names[order], counts[order].astype(float)
        return names, np.log(counts / np.maximum(counts.sum(0), 1) + FLOOR).astype(np.float32)

    @staticmethod
    def find(table, names: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 where a name isn't in it."""
        if not len(table[0]):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(table[0], names), len(table[0]) - 1)
        return np.where(table[0][at] == names, at, -1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(summed log frequencies by text and language, number of letter words)."""
        words, k = LetterWords(texts), len(self.languages)
        value = np.zeros((len(words.names), k), np.float32)
        at = self.find(self.words, words.names)
        value[at >= 0] = self.words[1][at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for n in PIECES:
            if not len(left):
                break
            names, owner = pieces(words, left, n)
            at = self.find(self.by_piece[n], names)
            seen = np.bincount(owner[at >= 0], minlength=len(left))
            sums = np.stack([np.bincount(owner[at >= 0], self.by_piece[n][1][at[at >= 0], j], len(left)) for j in range(k)], 1)
            value[left[seen > 0]] = sums[seen > 0] / seen[seen > 0, None]
            left = left[seen == 0]
        sums = np.stack([np.bincount(words.text, value[:, j], words.rows) for j in range(k)], 1)
        return sums, np.bincount(words.text, minlength=words.rows)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums, n_words = self.scores(texts)
        best = sums.argmax(1)
        share = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        names = np.array([*self.languages, UNKNOWN], object)
        return names[np.where(n_words > 0, best, -1)].tolist(), np.where(n_words > 0, share, 0.0)


def fit_language_model(df: DataFrame, teaches: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Count words and pieces of the sample where the rows are; the sample bounds what reaches the driver."""
    arrow_limits(df.sparkSession)
    rows = df.where(teaches & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sample = bounded_sample(rows, sample_rows, "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, texts in text_blocks(batch.column(1)):
                words = LetterWords(texts)
                every = np.arange(len(words.names))
                kinds = [(0, words.names, every), *((n, *pieces(words, every, n)) for n in PIECES)]
                row_lang = langs[first : first + len(texts)]
                for value in sorted(set(row_lang)):
                    mine = (row_lang == value)[words.text]
                    for n, names, owner in kinds:
                        found, counts = np.unique(names[mine[owner]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([value] * len(found)), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(counts)], names=["lang", "n", "name", "count"])

    counted = sample.mapInArrow(count, "lang string, n int, name long, count long").groupBy("n", "name", "lang").agg(F.sum("count").alias("count"))
    found = counted.toArrow()
    langs = found["lang"].combine_chunks().dictionary_encode()
    languages = sorted(langs.dictionary.to_pylist())
    column = np.array([languages.index(x) for x in langs.dictionary.to_pylist()], np.int64)[np.asarray(langs.indices)] if len(found) else np.zeros(0, np.int64)
    kinds, names, times = np.asarray(found["n"]), np.asarray(found["name"], np.int64), np.asarray(found["count"], np.int64)
    tables = {}
    for n in (0, *PIECES):
        mine = kinds == n
        known, row = np.unique(names[mine], return_inverse=True)
        counts = np.zeros((len(known), max(1, len(languages))))
        counts[row, column[mine]] = times[mine]
        tables[n] = LanguageModel.table(known.view(U64), counts)
    return LanguageModel(languages, tables.pop(0), tables)


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, then lang_pred and score, one row for each input row."""
    spark = df.sparkSession
    arrow_limits(spark)
    sent = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], [np.zeros(0)]
            for _, texts in text_blocks(batch.column(0)):
                some, share = sent.value.predict(texts)
                langs += some
                scores.append(share)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*keep, "lang_pred", "score"])

    chosen = df.select(F.col(text).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(predict, f"{fields}{', ' if fields else ''}lang_pred string, score double")


def identify_language(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Fit on rows outside the held-out fold, predict every row: doc_id, held_out, lang_pred, score."""
    model = fit_language_model(df, ~held_out(F.col(doc_id), 4), doc_id, text, lang, sample_rows)
    rows = df.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 4).alias("held_out"), F.col(text).alias("text"))
    return predict_language(rows, model, keep=("doc_id", "held_out"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(spark.read.parquet(f"{sf_dir}/documents.parquet"))

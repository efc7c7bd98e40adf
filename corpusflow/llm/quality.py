"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a bounded sample; rules then run in the order of
rejections per second, and a rule sees only the texts that every rule before it let through.  The
order changes the work, never the verdict.

Defined results: a null or empty text has no words and fails the base rules; every row comes back
once, copies and rows with a null id included; an empty table gives an empty result; columns other
than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import SPACE, count_bytes, text_buffers, windows, word_spans
from .common import arrow_limits

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: First bytes of code points that are not word separators.
WORD_CHAR = np.array([(b & 0xC0) != 0x80 for b in range(256)]) & ~SPACE
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ASCII_LETTER = UPPER.copy()
ASCII_LETTER[97:123] = True
EXCLAIM = np.zeros(256, bool)
EXCLAIM[33] = True


class TextBlock:
    """Texts of one batch; every statistic is computed when a rule first asks for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets

    @classmethod
    def of(cls, column: pa.Array) -> TextBlock:
        return cls(*text_buffers(column))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, keep: np.ndarray) -> TextBlock:
        """The block of the chosen rows; statistics that are known already are carried over."""
        lengths = np.diff(self.offsets)[keep]
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        parts = [self.data[self.offsets[i] : self.offsets[i + 1]] for i in keep]
        block = TextBlock(np.concatenate(parts) if parts else self.data[:0], offsets)
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"):
            if name in self.__dict__:
                block.__dict__[name] = self.__dict__[name][keep]
        return block

    @cached_property
    def _words(self):
        return word_spans(self.data, self.offsets, lower=False)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self._words[2])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return count_bytes(self.data, self.offsets, WORD_CHAR)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return count_bytes(self.data, self.offsets, SYMBOLS)

    @cached_property
    def _lines(self) -> np.ndarray:
        out = np.zeros((len(self), 2), np.int64)
        raw = self.data.tobytes()
        for i, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
            lines = [line for line in raw[a:b].split(b"\n") if line and not line.isspace()]
            out[i] = len(lines), len(lines) - len(set(lines))
        return out

    @cached_property
    def n_lines(self) -> np.ndarray:
        return self._lines[:, 0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[:, 1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside windows of WINDOW words that the same text holds at least twice."""
        names, _, pointers = self._words
        grams, edges = windows(names, pointers, WINDOW)
        text = np.repeat(np.arange(len(self)), np.diff(edges))
        order = np.lexsort((grams, text)) if len(self) > 1 else np.argsort(grams, kind="stable")
        same = (grams[order][1:] == grams[order][:-1]) & (text[order][1:] == text[order][:-1])
        repeated = np.zeros(len(grams), bool)
        repeated[order[1:][same]] = repeated[order[:-1][same]] = True
        at = np.flatnonzero(repeated)
        start = at - edges[text[at]] + pointers[text[at]]
        change = np.zeros(len(names) + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + WINDOW, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(change)[:-1] > 0)))
        return covered[pointers[1:]] - covered[pointers[:-1]]

    @cached_property
    def upper_letters(self) -> np.ndarray:
        return count_bytes(self.data, self.offsets, UPPER)

    @cached_property
    def ascii_letters(self) -> np.ndarray:
        return count_bytes(self.data, self.offsets, ASCII_LETTER)

    @cached_property
    def exclamations(self) -> np.ndarray:
        return count_bytes(self.data, self.offsets, EXCLAIM)


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` maps a block to one flag for each of its texts."""

    name: str
    rejects: Callable[[TextBlock], np.ndarray] = field(repr=False)


#: Texts with fewer words, or with a larger share of repeated words, fail whatever the rules say.
BASE = Rule("base", lambda b: (b.n_words < 20) | (100 * b.n_repeat_words > 30 * b.n_words))

RULES = (
    Rule("symbols", lambda b: 10 * b.n_symbols > b.n_words),
    Rule("capitals", lambda b: 10 * b.upper_letters > 3 * np.maximum(b.ascii_letters, 1)),
    Rule("exclamations", lambda b: 5 * b.exclamations > b.n_words),
    Rule("word_length", lambda b: (2 * b.word_chars < 5 * b.n_words) | (b.word_chars > 20 * b.n_words)),
    Rule("repeated_lines", lambda b: 10 * b.n_dup_lines > 3 * np.maximum(b.n_lines, 1)),
)


#: The sample: so many rows of so many partitions, spread over the table.
SAMPLE_ROWS, SAMPLE_PARTITIONS = 128, 8


def profile(df: DataFrame, rules=RULES, text: str = "text", gate: Rule | None = None) -> list[dict]:
    """Cost (seconds) and rejections of each rule on the first SAMPLE_ROWS rows of SAMPLE_PARTITIONS
    partitions, measured where the rows are.  Only these sums reach the driver.  Rows that the gate
    rejects don't count."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, seen = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            if seen >= SAMPLE_ROWS:
                continue
            block = TextBlock.of(batch.column(0).slice(0, SAMPLE_ROWS - seen))
            seen += len(block)
            if gate is not None:
                block = block.take(np.flatnonzero(~gate.rejects(block)))
            for k, rule in enumerate(rules):
                fresh, began = TextBlock(block.data, block.offsets), time.perf_counter()
                rejected[k] += int(rule.rejects(fresh).sum())
                seconds[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "seconds": seconds, "rejected": rejected})

    measured = df.select(text).mapInArrow(measure, "rule string, seconds double, rejected long").rdd
    count = measured.getNumPartitions()
    chosen = sorted({i * count // SAMPLE_PARTITIONS for i in range(SAMPLE_PARTITIONS)}) if count else []
    sums = {r.name: {"rule": r.name, "seconds": 0.0, "rejected": 0} for r in rules}
    for row in df.sparkSession.sparkContext.runJob(measured, list, chosen):
        sums[row.rule]["seconds"] += row.seconds
        sums[row.rule]["rejected"] += row.rejected
    return list(sums.values())


def order_rules(rules, measured: list[dict]) -> list[Rule]:
    """Most rejections per second first; ties and unmeasured rules keep the given order."""
    rate = {m["rule"]: m["rejected"] / max(m["seconds"], 1e-9) for m in measured}
    return sorted(rules, key=lambda r: -rate.get(r.name, 0.0))


def run_cascade(block: TextBlock, rules, gate: Rule | None = None) -> np.ndarray:
    """For each text, -1 for the gate, k for the k-th rule in the order run, or len(rules) if it stays."""
    verdict = np.full(len(block), len(rules))
    alive = np.arange(len(block))
    if gate is not None:
        failed = gate.rejects(block)
        verdict[failed] = -1
        alive, block = alive[~failed], block.take(np.flatnonzero(~failed))
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        failed = rule.rejects(block)
        if failed.any():
            verdict[alive[failed]] = k
            alive, block = alive[~failed], block.take(np.flatnonzero(~failed))
    return verdict


def quality_cascade(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, gate: Rule | None = BASE) -> DataFrame:
    """Word statistics, the gate's and the cascade's verdict for every row.

    ``rejected_by`` names the first rule that rejected the text in the order chosen here.
    """
    arrow_limits(df.sparkSession)
    ordered = order_rules(rules, profile(df, rules, text, gate))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = TextBlock.of(batch.column(1))
            stats = [block.n_words, block.word_chars, block.n_symbols, block.n_dup_lines, block.n_repeat_words]
            verdict = run_cascade(block, ordered, gate)
            names = np.array([*(r.name for r in ordered), None, "base" if gate is None else gate.name], object)
            columns = [batch.column(0), *(pa.array(s, pa.int64()) for s in stats), pa.array(verdict == -1), pa.array(verdict == len(ordered)), pa.array(names[verdict], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    id_type = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), text).mapInArrow(judge, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")


def keep_good(df: DataFrame, keep: tuple[str, ...], text: str = "text", rules=RULES, gate: Rule | None = BASE) -> DataFrame:
    """The rows, with the columns ``keep``, that neither the gate nor a rule rejects."""
    arrow_limits(df.sparkSession)
    ordered = order_rules(rules, profile(df, rules, text, gate))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = run_cascade(TextBlock.of(batch.column(0)), ordered, gate) == len(ordered)
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=list(keep)).filter(pa.array(good))

    chosen = df.select(F.col(text).alias("_text"), *keep)
    return chosen.mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]))


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The cascade over ``documents``, without ``rejected_by``, which depends on measured times."""
    return quality_cascade(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS a, lead(word, 2) OVER o AS b, lead(word, 3) OVER o AS c, lead(word, 4) OVER o AS d, lead(word, 5) OVER o AS e, lead(word, 6) OVER o AS f, lead(word, 7) OVER o AS h FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
m AS (SELECT r, i, CASE WHEN h IS NULL THEN 0 ELSE CASE WHEN count(*) OVER (PARTITION BY r, word, a, b, c, d, e, f, h) > 1 THEN 1 ELSE 0 END END AS twice FROM g),
v AS (SELECT r, i, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM m),
n AS (SELECT r, count(*) AS n_words, sum(covered) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT r, doc_id, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters, length(text) - length(replace(text, '!', '')) AS exclaim FROM d),
q AS (SELECT s.*, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines FROM s LEFT JOIN n USING (r) LEFT JOIN k USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * upper > 3 * greatest(letters, 1) OR 5 * exclaim > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * greatest(n_lines, 1)) AS kept
FROM q
"""

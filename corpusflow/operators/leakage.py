"""Boilerplate that is left in a corpus: many literals counted in one pass by an Aho-Corasick automaton."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.entities import name2codepoint

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that are searched at a time; the automaton's state is carried over the edges.
STEP = 1 << 20
# What cleaning should have taken from books, pages and transcripts.
BOILERPLATE = ["*** START OF", "*** END OF", "Project Gutenberg", "Produced by", "End of the Project", "<SPEAKER", "<CHAPTER", "<P>", "http://", "https://", "www.", "↩", "⏎", "\u00a0", "\ufffd", "``", "''", "<|"]


def boilerplate() -> list[str]:
    """The phrases above and every named character entity."""
    return sorted({*BOILERPLATE, *(f"&{name};" for name in name2codepoint)})


@lru_cache(maxsize=4)
def automaton(literals: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """One for each worker process. Its letters are bytes, so a text needs one byte each, whatever its script."""
    found = ahocorasick.Automaton()
    for k, literal in enumerate(literals):
        found.add_word(literal.decode("latin-1"), (k, len(literal)))
    found.make_automaton()
    return found


def occurrences(text: bytes, literals: tuple[bytes, ...], ignore_case: bool = False) -> Counter:
    """How often each literal (by place in the list) occurs, left to right and without overlapping itself."""
    counts, free = Counter(), {}
    search = automaton(literals).iter("")
    for at in range(0, len(text), STEP):
        part = text[at : at + STEP]
        search.set((part.lower() if ignore_case else part).decode("latin-1"), False)
        for last, (k, size) in search:
            if last + 1 - size >= free.get(k, 0):
                free[k] = last + 1
                counts[k] += 1
    return counts


def literal_counts(df: DataFrame, literals: Iterable[str], texts: list[str], by: list[str], ignore_case: bool = False) -> DataFrame:
    """``by``, literal and n_<column> for each of the text columns: how often the literal occurs in all rows.

    Each literal is counted as one regular expression of its own would count it; literals may overlap each
    other.  Literals found in no column give no row.  Null and empty texts hold nothing, repeated rows count
    each time, a text of any length is searched in steps.  ``ignore_case`` is about A to Z only.  Counts are
    summed within a batch before they are shuffled.
    """
    shown = sorted({w.lower() if ignore_case and w.isascii() else w for w in literals if w})
    words = tuple(w.encode().lower() if ignore_case else w.encode() for w in shown)
    names = [f"n_{t}" for t in texts]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = list(zip(*(batch.column(len(texts) + i).to_pylist() for i in range(len(by))), strict=True)) if by else [()] * len(batch)
            sums: dict[tuple, list[int]] = {}
            for c in range(len(texts)):
                column = batch.column(c)
                for group, value in zip(groups, column, strict=True):
                    for k, n in occurrences(value.as_buffer().to_pybytes() if value.is_valid else b"", words, ignore_case).items():
                        sums.setdefault((k, *group), [0] * len(texts))[c] += n
            keys, values = list(sums), list(sums.values())
            columns = [pa.array([shown[key[0]] for key in keys], pa.string())]
            columns += [pa.array([key[1 + i] for key in keys], batch.schema.field(len(texts) + i).type) for i in range(len(by))]
            columns += [pa.array([v[c] for v in values], pa.int64()) for c in range(len(texts))]
            yield pa.RecordBatch.from_arrays(columns, names=["literal", *by, *names])

    chosen = df.select(*(F.col(t).cast("binary").alias(f"_text{i}") for i, t in enumerate(texts)), *by)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[len(texts) :])
    found = chosen.mapInArrow(count, f"literal string{kinds}, " + ", ".join(f"`{n}` long" for n in names))
    return found.groupBy(*by, "literal").agg(*(F.sum(n).alias(n) for n in names))

"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import fim
from tests.llm.test_text_operators import SCHEMA, prose, table

TEXTS = [
    (1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\nc"), (6, "a\n\n\nb\n"), (7, "has <P> in it\nx\ny"), (8, "<S>"), (9, "ends with <\nM>\n<"),
    (10, "\x1f\n\x1b0\x1f1\n\x1b\x1b\n\x1f"), (11, "É😀\r\nñ z\n漢"), (12, "$0 \\1 $\n\\n\n"), (13, "x" * 300_000), (14, "line of text\n" * 60_000),
    (None, "a\nb\nc\nd"), (None, None), (15, "same\nrow\n"), (15, "same\nrow\n"), (15, "same\nrow\n!"), (-3, prose(1, 40).replace(" ", "\n")),
] + [(100 + i, prose(i, 30).replace("a ", "\n")) for i in range(60)]


def by_hand(doc_id, text, percent=100, spm=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(name[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (doc_id, len(units), "plain", None, None, None, text)
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def in_order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 0), (0, 50)])
def test_parts_against_plain_python(spark, percent, spm):
    made = fim.fill_in_middle(table(spark, TEXTS), fim_percent=percent, spm_percent=spm)
    got = made.select("doc_id", "n_units", "form", "prefix", "middle", "suffix", "output").collect()
    assert in_order(map(tuple, got)) == in_order(by_hand(i, t, percent, spm) for i, t in TEXTS)


def test_every_text_comes_back(spark):
    made = fim.fill_in_middle(table(spark, TEXTS))
    got = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert in_order(map(tuple, got)) == in_order((i, t or "") for i, t in TEXTS)
    assert {r.form for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_other_units_and_markers(spark):
    marks = fim.Markers("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(table(spark, [(i, "one two  three [x] four") for i in range(40)]), unit=r"[^ ]+ *", markers=marks, seed="s")
    rows = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text and r.n_units == 5 and r.prefix + r.middle + r.suffix == r.text for r in rows)
    with pytest.raises(ValueError):
        fim.Markers("<P>", "x<P>", "<M>")


def test_kept_and_clashing_columns(spark):
    rows = table(spark, [(1, "a\nb")]).withColumnRenamed("id", "_marked").withColumnRenamed("tkey", "form")
    made = fim.fill_in_middle(rows, keep=("lang", "source", "_marked"))
    assert made.columns[:4] == ["lang", "source", "_marked", "doc_id"] and made.first()._marked == "y"
    with pytest.raises(ValueError):
        fim.fill_in_middle(rows, keep=("form",))


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(none).collect() == []
    plan = fim.fill_in_middle(table(spark, TEXTS).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1  # the test table's own

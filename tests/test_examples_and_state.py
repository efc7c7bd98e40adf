"""Repeated prompts by history, states with two thresholds, and cleaners side by side."""

import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import examples as X
from corpusflow.operators import state as S


def copies_by_hand(rows):
    convs, seen, out = {}, Counter(), []
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    for conv in convs.values():
        conv.sort(key=lambda r: r[1])
        for k, r in enumerate(conv):
            if r[2] == "user":
                key = (r[3], tuple(x[2:] for x in conv[:k]))
                seen[key] += 1
                out.append((r[0], r[1], k, key))
    return sorted((c, t, k, seen[key]) for c, t, k, key in out)


def test_a_question_may_repeat_only_with_another_history(spark, monkeypatch):
    ask, no, dana = (0, "user", "What is my name?"), (1, "assistant", "I don't know."), [(0, "user", "I am Dana."), (1, "assistant", "Hello!"), (2, "user", "What is my name?")]
    rows = [(c, *t) for c, turns in {1: [ask, no], 2: dana, 3: [ask], 4: [(0, "assistant", "Hi"), (1, "user", "What is my name?")]}.items() for t in turns]
    r = random.Random(3)
    rows += [(100 + c, 3 * k - 5, r.choice(["user", "assistant", None]), r.choice(["a", "", None])) for c in range(40) for k in range(r.randint(1, 4))]
    long = [(k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(700)]
    rows += [(c, *t) for c in (500, 501) for t in long] + [(502, *t) for t in long if t[0] != 3]
    # Order matters: the same two turns the other way round are another history.
    rows += [(600, 0, "user", "x"), (600, 1, "assistant", "y"), (600, 2, "user", "z"), (601, 0, "assistant", "y"), (601, 1, "user", "x"), (601, 2, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = copies_by_hand(rows)
    for slice_turns in (256, 2, 10**6):
        monkeypatch.setattr(X, "SLICE_TURNS", slice_turns)
        assert sorted(map(tuple, X.prompt_copies(df).collect())) == want
    assert {c: n for c, _, k, n in want if k == 0 and c in (1, 3)} == {1: 2, 3: 2} and (2, 2, 2, 1) in want
    assert X.prompt_copies(df.limit(0)).collect() == []


def test_null_conversations_are_one(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "user", "b"), (7, 0, "user", "a"), (7, None, "user", "first")], "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, X.prompt_copies(df).collect()), key=repr) == sorted([(None, 0, 0, 1), (None, 1, 1, 1), (7, None, 0, 1), (7, 0, 1, 1)], key=repr)


def test_hysteresis_keeps_its_state_between_thresholds(spark):
    values = [50, 60, 50, 40, 39, 45, None, 61, None, 40, 10]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v int")
    got = [r.on for r in df.select("k", S.hysteresis(F.col("v"), 60, 40, Window.orderBy("k")).alias("on")).orderBy("k").collect()]
    assert got == [False, True, True, True, False, False, False, True, True, True, False]


def test_cleaners_side_by_side_are_each_alone(spark):
    text = "[Title]\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nThe/at dog/nn barks/vbz ./.\n<CHAPTER ID=1>\nRéal  &amp; &nbsp;↩︎ words\r\n\n\n\nmore  \nProduced by someone\n\nend"
    rows = [(k, name, t) for k, (name, t) in enumerate((n, t) for n in [*T.CLEANERS, "unknown", None] for t in (text, None, "", "a &lt; b"))]
    df = spark.createDataFrame(rows, "k long, cleaner string, text string").repartition(3)
    got = {r.k: r.text for r in T.clean_by(df, "cleaner", "text").collect()}
    for name, (first, second) in T.CLEANERS.items():
        chosen = first(F.col("text"))
        alone = df.where((F.col("cleaner") == name) if name != "generic" else ~F.col("cleaner").isin([n for n in T.CLEANERS if n != "generic"]) | F.col("cleaner").isNull())
        done = T.generic(second(T.html_unescape(chosen)) if second is not None else chosen)
        for r in alone.select("k", done.alias("text")).collect():
            assert got.pop(r.k) == r.text
    assert not got
    plan = T.clean_by(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("cleaner", F.lit("brown")), "cleaner", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1

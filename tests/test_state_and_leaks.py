"""Keyed state of streams against the batch forms; literals counted in one pass against one pattern each."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.operators import chat as H
from corpusflow.operators import leakage as L
from corpusflow.operators import state as S
from corpusflow.streaming import sessions as N

TURNS = "conv_id long, turn int, role string, content string"


def parts_as_stream(spark, tmp_path, parts, schema):
    """A stream that gets one part in each batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        for f in sorted((tmp_path / "in").glob("part-*.json")):
            (tmp_path / f"ordered-{k}.json").write_text(f.read_text())
            f.unlink()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "ordered-*.json"))


@pytest.mark.parametrize("most", [1, 3])
def test_sessions_as_state_are_the_batch_windows(spark, tmp_path, most):
    r = random.Random(most)
    rows = [(c, t, "system" if t == 0 and c % 2 else r.choice(["user", "assistant", "tool", "tool", None]), r.choice(["hi", "", None, "שלום"])) for c in range(12) for t in range(1 + c)]
    r.shuffle(rows)
    parts = [rows[k::3] for k in range(3)]
    parts[1].append((None, 1, "user", "no conversation"))
    stream = parts_as_stream(spark, tmp_path, parts, TURNS)
    windows = N.run_to_files(N.trimmed_sessions(stream, most), "windows-test")
    got = N.latest_windows(windows).select("conv_id", "turn", "role", "content")
    want = H.trim(spark.createDataFrame(rows, TURNS), most).selectExpr("conv_id", "cast(turn as long) turn", "role", "content")
    key = lambda x: (x[0], x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert windows.groupBy("conv_id", "seen").count().agg(F.max("count")).first()[0] <= most + 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_switches_as_state_are_the_batch_switches(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.randint(1, 5), f"2024-01-01 00:{k // 4:02d}:00", k, r.choice([10.0, 50.0, 70.0, None, 40.0, 60.0])) for k in range(120)]
    schema = "user long, ts timestamp, id long, value double"
    typed = spark.createDataFrame(rows, "user long, ts string, id long, value double").select("user", F.to_timestamp("ts").alias("ts"), "id", "value")
    ordered = [tuple(x) for x in typed.collect()]
    parts = [ordered[:50], ordered[50:51], ordered[51:], [(9, None, 500, 70.0)]]
    for p in parts[::2]:
        r.shuffle(p)
    got = N.run_to_files(N.switched(parts_as_stream(spark, tmp_path, parts, schema), "user", "ts", "id", "value", 60.0, 40.0), "switch-test")
    want = typed.select("user", "id", S.hysteresis(F.col("value"), 60.0, 40.0, Window.partitionBy("user").orderBy("ts", "id")).alias("on"))
    assert sorted((x.key, x.id, x.running) for x in got.collect()) == sorted((x.user, x.id, x.on) for x in want.collect())
    assert got.where("late").count() == 0


def test_late_rows_change_nothing(spark, tmp_path):
    schema = "user long, ts timestamp, id long, value double"
    rows = [tuple(x) for x in spark.createDataFrame([(1, "2024-01-01 00:05:00", 5, 70.0), (1, "2024-01-01 00:01:00", 1, 10.0), (1, "2024-01-01 00:06:00", 6, 50.0)], "user long, ts string, id long, value double").select("user", F.to_timestamp("ts").alias("ts"), "id", "value").collect()]
    got = N.run_to_files(N.switched(parts_as_stream(spark, tmp_path, [rows[:1], rows[1:]], schema), "user", "ts", "id", "value", 60.0, 40.0), "switch-test")
    assert sorted((x.id, x.running, x.late) for x in got.collect()) == [(1, True, True), (5, True, False), (6, True, False)]


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_literals_are_counted_as_one_pattern_each(spark, monkeypatch, step):
    monkeypatch.setattr(L, "STEP", step)
    r = random.Random(step)
    letters = "abé漢👍"
    words = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(30)})
    rows = [(k % 3 if k % 5 else None, "".join(r.choice(letters) for _ in range(60)), r.choice(["", None, "ab" * 40])) for k in range(40)]
    rows += rows[:5]
    sums = {}
    for group, *texts in rows:
        for word in words:
            for c, text in enumerate(texts):
                n = len(re.findall(re.escape(word), text or ""))
                if n:
                    sums.setdefault((group, word), [0, 0])[c] += n
    words_in = [*words, "", words[0]]
    df = spark.createDataFrame(rows, "g int, a string, b string").repartition(3)
    if step > 5:  # the small step reaches the functions here, not workers that run already
        got = L.literal_counts(df, words_in, ["a", "b"], ["g"]).collect()
        assert {(x.g, x.literal): [x.n_a, x.n_b] for x in got} == sums
    packed = tuple(w.encode() for w in words)
    for _, text, _ in rows:
        assert {words[k]: n for k, n in L.occurrences(text.encode(), packed).items()} == {w: n for w in words if (n := len(re.findall(re.escape(w), text)))}


def test_literals_without_case_in_empty_and_long_texts(spark):
    rows = [("x", "The THE the" + " " * 3_000_000 + "tHe ΤHE"), ("x", None)]
    df = spark.createDataFrame(rows, "literal_group string, t string")
    got = L.literal_counts(df, ["the", "&nbsp;"], ["t"], [], ignore_case=True).collect()
    assert [tuple(x) for x in got] == [("the", 4)]
    assert L.literal_counts(df.limit(0), ["the"], ["t"], ["literal_group"]).count() == 0

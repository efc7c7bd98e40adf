"""Tools, files, settings and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import tools as T
from corpusflow.operators import state as S
from corpusflow.operators.corpus import SEPARATOR
from corpusflow.operators.sampling import stream_sample
from corpusflow.sources import files as X
from corpusflow.sources.archives import archive_members, write_archives
from corpusflow.streaming import monitor as M


@pytest.mark.parametrize(("expression", "want"), [("17 * 43 / 6", repr(17 * 43 / 6)), ("6.0", "6"), ("-7 // 2", "-4"), ("cbrt(-8)", "-2"), ("log(100, 10)", "2"), ("1 < 2 > 3", "false"), ("sum(1, 2)", "3"), ("inf", "inf"), ("1e300 * 10", repr(1e301)), ("1**9999", "1"), ("(1, 2.5)", "1, 2.5")])
def test_calculate(expression, want):
    assert T.calculate(expression) == want


@pytest.mark.parametrize("expression", ["", "9**9999", "factorial(1001)", "__import__('os')", "(1).real", "lambda: 1", "max(1, key=2)", "1 +", "'a' * 9", "1 / 0"])
def test_calculate_refuses(expression):
    with pytest.raises((ValueError, ZeroDivisionError)):
        T.calculate(expression)


def test_days_between():
    assert T.days_between("2024-02-28", "2024-03-01") == "2 day(s); 2024-03-01T00:00:00 is after 2024-02-28T00:00:00"
    assert T.days_between("2024-03-01", "2024-02-28").startswith("2 day(s); 2024-02-28T00:00:00 is before")


def test_registry_errors_are_data():
    r = T.default_registry()
    assert r.execute("calculate", {"expression": "1+1"}) == ("2", False)
    assert r.execute("calculate", {})[1] and r.execute("calculate", {"expression": "1", "mode": 2})[1] and r.execute("x", {})[1]
    with pytest.raises(ValueError):
        r.register("calculate", len)
    assert T.schema_of(T.days_between)["required"] == ["start_date", "end_date"] and r.subset(["calculate"]).names() == ["calculate"]


def test_archive_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, body in (("c/b.txt", b"H\xe9"), ("c/a.txt", "é".encode()), ("c/README", b"no"), ("d/x.txt", b"x"), ("c/", b"")):
            z.writestr(name, body)
    got = archive_members(spark, str(tmp_path / "a.zip"), ["c/*", "*.txt"], ["README"]).orderBy("position").collect()
    assert [r.name for r in got] == ["c/a.txt", "c/b.txt", "c/a.txt", "c/b.txt", "d/x.txt"]
    rows = spark.createDataFrame([(r.content,) for r in got[:2]], "b binary").select(X.decode_fallback(F.col("b"))).collect()
    assert [r[0] for r in rows] == ["é", "Hé"]


def test_one_archive_is_read_by_many_tasks_and_only_where_it_is_wanted(spark, tmp_path):
    import random

    body = {f"d{k % 3}/{k}.txt": random.Random(k).randbytes(5000) for k in range(60)}
    rows = spark.createDataFrame([(n, bytearray(b)) for n, b in body.items()], "name string, content binary")
    assert write_archives(rows.coalesce(1), str(tmp_path / "z")) == 60
    path = str(tmp_path / "z" / "*.zip")
    got = archive_members(spark, path, task_bytes=20_000)
    assert got.rdd.getNumPartitions() > 10 and {r.name: bytes(r.content) for r in got.collect()} == body
    assert [r.position for r in got.orderBy("position").collect()] == list(range(60))
    few = got.where(F.col("name").startswith("d1/") & F.col("name").endswith("0.txt"))
    assert {r.name for r in few.collect()} == {n for n in body if n.startswith("d1/") and n.endswith("0.txt")}
    assert few.rdd.getNumPartitions() < 3  # the others' bytes were never planned
    assert got.where("name = 'd0/3.txt' AND position >= 0").count() == 1 and got.where("name IN ('d0/3.txt', 'd0/6.txt', 'x')").count() == 2
    assert archive_members(spark, path, ["no/*"]).count() == 0


@pytest.mark.parametrize("budget", [10, 400, 4000, 10**6])
def test_sample_at_places_is_that_of_the_joined_text(spark, budget):
    rows = [(k % 17, k, None if k == 5 else "".join("ab c\nd é"[(k * j) % 8] for j in range(k * 3 % 90))) for k in range(60)] + [(None, 1, "no\nid"), (3, 3, "same"), (3, 3, "same")]
    df = spark.createDataFrame(rows, "a long, b long, text string").repartition(4)
    got = stream_sample(df, ["a", "b"], budget, windows=7)
    h = {(r.a, r.b, r.text): r.h for r in df.select("a", "b", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    whole = SEPARATOR.join(r[2] or "" for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], h[r])))
    if len(whole) <= budget:
        want = {0: whole}
    else:
        want = {}
        for k in range(7):
            place = len(whole) * k // 7
            cut = whole.find("\n", place)
            want[k] = whole[cut + 1 :][: budget // 7] if cut >= 0 else ""
    made = {}
    for r in sorted(got.collect()):
        made[r.window] = made.get(r.window, "") + r.text
    assert made == {k: t for k, t in want.items() if t}


def test_mirrors_and_staging(tmp_path):
    tries = []

    def read(url):
        tries.append(url)
        if len(tries) < 4:
            raise OSError("down")
        return b"body"

    assert X.fetch(["u1", "u2"], pause=0, read=read) == b"body" and tries == ["u1"] * 3 + ["u2"]
    with pytest.raises(OSError):
        X.fetch(["u"], pause=0, read=lambda u: (_ for _ in ()).throw(OSError()))
    path = X.stage("u", str(tmp_path / "f"), read=lambda u: b"one")
    assert X.stage("u", path, read=lambda u: b"two") == path and (tmp_path / "f").read_bytes() == b"one"


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text('[corpusflow]\nport = "81"\nunknown = 1\n')
    got = X.load_settings({"port": 80, "debug": False, "name": "x"}, str(tmp_path / "c.toml"), {"CORPUSFLOW_DEBUG": "yes"})
    assert got == {"port": 81, "debug": True, "name": "x"}


def test_agent_replay(spark):
    spark.sparkContext.setCheckpointDir("/tmp/corpusflow-test")
    asks = spark.createDataFrame([(1, "2+2"), (2, "hello"), (3, "loop")], "conv_id long, prompt string")

    def model(df):
        first, seen = F.col("transcript")[0]["content"], F.size("transcript")
        again = (first == "loop") | ((first == "2+2") & (seen == 1))
        return df.select("*", F.lit("said").alias("content"), F.when(again, "calculate").alias("name"), F.lit('{"expression": "2+2"}').alias("arguments"))

    got = {r.conv_id: r for r in S.replay_agent(asks, model, T.default_registry().column, 3).collect()}
    assert [(got[k].rounds, got[k].exhausted) for k in (1, 2, 3)] == [(2, False), (1, False), (3, True)]
    assert [m.content for m in got[1].transcript] == ["2+2", "said", "4", "said"]


def test_loss_alerts_stream(spark, tmp_path):
    lines = [{"step": 1, "val_loss": 3.0}, {"step": 2, "val_loss": 2.0}, {"step": 3, "train_loss": 1.0}, {"step": 4, "val_loss": 2.2}]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, lines), "", '{"step": 5, "val']))
    stream = M.log_stream(spark, str(tmp_path)).withColumn("run", F.lit("a"))
    got = M.run_to_end(M.loss_alerts(stream), "append").collect()
    assert [(r.step, r.val_loss, r.least_loss) for r in got] == [(4, 2.2, 2.0)]


def test_all_failed_is_no_measurement(spark):
    from corpusflow.operators import evaluation as E

    schema = "prompt string, expects_tool string, expected_value string, expects_refusal boolean, relevant_if array<string>, answer string, called string, tool_result string, tool_error boolean, error string"
    df = spark.createDataFrame([("p", None, None, False, [], None, None, None, None, "boom")], schema)
    with pytest.raises(RuntimeError):
        E.summary(E.judged(df))

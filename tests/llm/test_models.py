"""Search against brute force; learned operators by held-out quality and by hand-made cases."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"


def test_top_k_against_brute_force(spark):
    from corpusflow.llm import topk

    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in r.integers(-3, 4, 6) / 7.0], "a") for k in range(120)]
    rows += [(200, None, "x"), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (202, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (203, [0.5] * 3, "x"), (204, [0.25] * 3, "x"), (205, [], "x"), (206, [1e12] * 6, "x"), (250, rows[7][1], "x"), (251, rows[7][1], "x"), (7, rows[7][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, tile string").repartition(5)
    got = Counter(tuple(x) for x in topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 4).collect())
    good = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = Counter()
    for i, a in good:
        if i % 10 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in good if j != i and len(a) == len(b))
            for rank, (score, j) in enumerate(found[:4], 1):
                want[(i, rank, j, max(-(2**63), min(2**63 - 1, -score)))] += 1
    assert got == want
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_passes_give_the_same(spark, monkeypatch):
    from corpusflow.llm import topk

    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    whole = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 25 == 0).collect()))
    monkeypatch.setattr(topk, "PASS_BYTES", 1)
    monkeypatch.setattr(topk, "QUERY_TILE", 7)
    assert whole == sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 25 == 0).collect()))


def test_language_model_learns_and_backs_off(spark):
    from corpusflow.llm import langid

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)
    rows = [(k, f"der und die das nicht ungeheuer schule {k}", "de") for k in range(40)] + [(100 + k, f"the and of that not wonderful school {k}", "en") for k in range(40)]
    rows += [(1000, "schulung ungeheuerlich", None), (1001, "wonderfully", None), (1002, "12 ... 34", "en"), (1003, None, "de"), (1004, "", None), (None, "the school", None)]
    small = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    by_id = {r.doc_id: r for r in langid.identify_language(small).collect()}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["de", "en", "und", "und", "und", "en"]
    assert by_id[1002].score == 0


def test_toxicity_finds_held_out_positives(spark):
    from corpusflow.llm import toxicity

    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(k, " ".join(f"{words[(k * 7 + j * j) % 6]}{j % 5}" for j in range(30)) + (" wretch fiend" if k % 7 == 0 else "")) for k in range(1400)]
    rows += [(5000, None), (5001, ""), (None, "some text"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(0, 1400, 2)] + [(0, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    keyed = docs.select("doc_id", toxicity.held_out(F.col("doc_id"), 4).alias("held_out"), "text")
    got = toxicity.score_toxicity(keyed, *toxicity.fit_toxicity(docs, labels), keep=("doc_id", "held_out")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1400]
    assert all(r.predicted == (r.doc_id % 7 == 0) for r in held)
    none = toxicity.score_toxicity(keyed, *toxicity.fit_toxicity(docs, labels.where("toxic = 0")), keep=("doc_id",))
    assert none.where("score > 1e-9").count() == 0


def test_non_negative_risk_does_not_overfit_unlabelled_positives():
    from corpusflow.llm.toxicity import Rows, nn_pu_fit, sigmoid

    positive = Rows([np.array([0, 1])] * 50)
    unlabelled = Rows([np.array([0, 1])] * 20 + [np.array([2])] * 180)
    w, b = nn_pu_fit(positive, unlabelled, 0.1, 3)
    assert sigmoid(w[0] + w[1] + b) > 0.8 and sigmoid(w[2] + b) < 0.1


def test_toxicity_sums_cover_every_text(spark, monkeypatch):
    """Counts and gradients from Spark, in a tree of two at a step, against one pass over all texts."""
    from corpusflow.llm import common
    from corpusflow.llm import toxicity as t

    monkeypatch.setattr(common, "FAN_IN", 2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join(words[(k * j) % 6] for j in range(k % 4 + 1)) for k in range(300)] + ["", ""]
    df = spark.createDataFrame([(x,) for x in texts], "text string").repartition(7)
    pointers, found = t.features(texts)
    held = np.unique(found)[::2]
    counts, n = t._text_counts(df, held)
    assert n == 302 and np.array_equal(counts, np.bincount(found, minlength=t.DIMENSIONS)[held])
    place = np.full(t.DIMENSIONS, -1)
    place[held] = np.arange(len(held))
    rows = t.Rows([found[a:b] for a, b in zip(pointers[:-1], pointers[1:], strict=True)]).restrict(place)
    w = np.random.default_rng(0).normal(size=len(held) + 1)
    got = t._sums_of(t._patterns(df, held).read().repartition(5))(w)
    assert np.allclose(got, t.negative_sums(rows, np.ones(302), w))


def hmm_brute(p, seq):
    a = p.start[0] * p.emits[:, seq[0]]
    total = math.log10(a.sum())
    for c in seq[1:]:
        a = ((a / a.sum()) @ p.moves) * p.emits[:, c]
        total += math.log10(a.sum())
    return total


def test_forward_and_counts_against_plain_recursion():
    from corpusflow.llm import hmm_lm as h

    r = np.random.default_rng(5)
    usual = np.full(h.CLASSES, 1 / h.CLASSES)
    p = h.Parameters.first(usual, 3)
    rows = [r.integers(0, h.CLASSES, n).astype(np.uint16) for n in (1, 5, 70, 200)]
    assert np.allclose(h.forward_log10(p, rows), [hmm_brute(p, x) for x in rows])
    classes, lengths, later = h.segments(rows)
    start, moves, emits = h.unpack(h.expected_counts(p, classes, lengths, later))
    assert np.isclose(emits.sum(), 276) and np.isclose(start.sum(), len(lengths)) and np.isclose(moves.sum(), 276 - len(lengths))
    assert np.allclose(emits.sum(0), np.bincount(np.concatenate(rows), minlength=h.CLASSES))
    better = h.Parameters.of(h.expected_counts(p, classes, lengths, later))
    assert h.forward_log10(better, rows).sum() > h.forward_log10(p, rows).sum()


def test_language_model_scores(spark):
    from corpusflow.llm import hmm_lm as h

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None), (10_001, ""), (None, "The  the")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra).withColumn("tail", F.lit("x"))
    got = h.score_texts(every).collect()
    texts = [(r.doc_id, r.text) for r in every.select("doc_id", "text").collect()]
    low = lambda t: (t or "").encode().lower().split()
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    counts = Counter(w for i, t in texts if learns(i) for w in [*low(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        words = [*low(t), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        want[(i, not learns(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 4))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_words_shares_sum_to_one():
    """In each tail class the known words' shares and the unseen share make one."""
    import pyarrow as pa

    from corpusflow.llm import hmm_lm as h

    class Row:
        def __init__(self, *v):
            self.tail, self.tokens, self.types, self.once, self.twice = v

    lex = h.Lexicon(pa.table({"word": pa.array([1], pa.int64()), "tail": pa.array([5], pa.int64()), "count": pa.array([9], pa.int64())}), 100, 10, 3, [Row(4, 12, 4, 1, 1)])
    counts = np.array([7, 2, 1, 2])
    shares = 10 ** lex.share_log10(counts, np.full(4, h.OWN + 4))
    assert math.isclose(shares.sum() + 10 ** lex.unseen_log10[4], 1)


@pytest.fixture(scope="module")
def planted(spark):
    from tests.llm.test_text_operators import prose

    shared = " ".join(prose(990, 90).split())
    rows = [(k, prose(k, 80 + k) + ".") for k in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " more"), (102, "Q1 " + prose(500, 70) + " " + shared), (103, "Q2 " + prose(501, 70) + " " + shared), (104, "### $$$ %% " * 40), (105, "123 456 " * 30), (106, None), (107, "short one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, docs, shared


def test_pipeline_stages(spark, planted):
    import corpus_pipeline as p

    rows, docs, shared = planted
    texts = dict(rows)
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["language", "quality", "near_copies", "repeated_passages", "packing"]
    kept = stages["language"](spark, docs, "").cache()
    assert {r.doc_id for r in kept.collect()} == set(texts) - {105, 106, 104} and kept.columns == docs.columns
    good = stages["quality"](spark, kept, "")
    assert {r.doc_id for r in good.collect()} == set(texts) - {104, 105, 106, 107}
    single = stages["near_copies"](spark, good, "")
    assert {r.doc_id for r in single.collect()} == set(texts) - {104, 105, 106, 107, 100, 101}
    cut = {r.doc_id: r for r in stages["repeated_passages"](spark, single, "").collect()}
    assert cut.keys() == {r.doc_id for r in single.collect()} and shared not in cut[102].text and shared not in cut[103].text
    assert all(cut[i].text == texts[i] for i in cut if i < 100) and all(r.n_chars == len(r.text) for r in cut.values())
    pieces = stages["packing"](spark, single, "").collect()
    assert {r.doc_id for r in pieces} == cut.keys()


def test_pipeline_cuts_repeated_passages_of_over_fifty_words(spark):
    """They are shorter than the 400 bytes of op5."""
    import corpus_pipeline as p
    from tests.llm.test_text_operators import prose

    shared = " ".join(prose(991, 90).split()[:52])
    assert 200 < len(shared.encode()) < 400
    rows = [(k, f"Q{k} {prose(600 + k, 70)} {shared} {prose(700 + k, 30)}") for k in range(3)] + [(9, prose(800, 120))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in p.repeated_passages(spark, docs, "").collect()}
    assert all(shared not in got[k] and len(got[k]) <= len(rows[k][1]) - len(shared) for k in range(3)) and got[9] == rows[3][1]


def test_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline as p
    from tests.llm.test_text_operators import prose

    a, b, c = prose(1, 90), prose(2, 90), prose(3, 2000)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (1, b, "de", "r"), (2, a + " more", "en", "s"), (None, c, None, None), (None, None, None, None), (None, None, None, None), (4, c + " end", "en", "s"), (5, "", "en", "s"), (6, "", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.near_copies(spark, docs.withColumn("tkey", p.F.lit("x")).withColumn("id", p.F.lit(0)), "")
    assert got.columns == p.COLUMNS
    left = sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=repr)
    assert left == sorted([(1, a, "en"), (1, b, "de"), (None, c, None), (None, None, None), (5, "", "en"), (6, "", "en")], key=repr)


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES[:-1]:
        left = stage(spark, docs, "")
        assert left.columns == p.COLUMNS and left.count() == 0
    assert p.STAGES[-1][1](spark, docs, "").count() == 0


def test_every_round_of_the_language_model_sees_every_text(spark):
    from corpusflow.llm import hmm_lm as h

    r = np.random.default_rng(3)
    texts = [r.integers(0, 40 + 400 * (k % 3), 12).astype(np.uint16) for k in range(4000)]
    encoded = spark.createDataFrame([(k, k % 7 != 2, bytearray(t.tobytes())) for k, t in enumerate(texts)], "id long, learns boolean, classes binary")
    rows = [t for k, t in enumerate(texts) if k % 7 != 2]
    usual = np.bincount(np.concatenate(rows), minlength=h.CLASSES) + 0.1
    p = h.Parameters.first(usual / usual.sum())
    for _ in range(14):
        p = h.Parameters.of(h.expected_counts(p, *h.segments(rows)))
    got = h.train(encoded)
    assert np.allclose(got.start, p.start) and np.allclose(got.moves, p.moves) and np.allclose(got.emits, p.emits)

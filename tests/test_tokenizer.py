"""Pre-tokens, training, encoding, windows and chat on small inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import bpe_training as T
from corpusflow.operators import chat as H
from corpusflow.operators import tokenizer as K
from corpusflow.operators import windows as W

TEXTS = ["in 1987", "snake_case __init__", "don't we'll I'D", "".join(map(chr, range(32, 127))), "  two  blanks \n\n end ", "naïve שָׁלוֹם 漢字 ² 👍🏽", "".join(map(chr, range(256))), ""]


@pytest.fixture(scope="module")
def corpus(spark):
    line = "Emma Woodhouse, handsome, clever, and rich, with a comfortable home and happy disposition, seemed to unite some of the best blessings of existence. "
    return spark.createDataFrame([(k, line * 2) for k in range(4)], "doc_id long, text string")


def test_pieces_cover_every_character(spark):
    for text, pieces in spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", K.pretokenize(F.col("t"))).collect():
        assert "".join(pieces) == text
    assert spark.createDataFrame([("in 1987",)], "t string").select(K.pretokenize(F.col("t"))).first()[0] == ["in", " ", "1", "9", "8", "7"]


def test_training_is_deterministic_stops_and_refuses(spark, corpus):
    a, b = K.train_bpe(corpus, 320), K.train_bpe(corpus, 320)
    assert a.merges == b.merges and a.size == 320
    tiny = spark.createDataFrame([("ab ab ab",)], "text string")
    assert K.train_bpe(tiny, 400).size < 400
    with pytest.raises(ValueError):
        K.train_bpe(tiny, 100)


def plain_merges(pieces, merges):
    """One merge after another over every piece, with all counts made anew."""
    words, out = [(list(p), f) for p, f in pieces.items()], []
    while len(out) < merges:
        counts = Counter()
        for ids, f in words:
            for pair in zip(ids, ids[1:], strict=False):
                counts[pair] += f
        if not counts or max(counts.values()) < 2:
            break
        best = max(counts, key=lambda p: (counts[p], p))
        out.append(best)
        words = [(merged(ids, *best, 255 + len(out)), f) for ids, f in words]
    return out


def merged(ids, left, right, new):
    out, k = [], 0
    while k < len(ids):
        hit = ids[k : k + 2] == [left, right]
        out.append(new if hit else ids[k])
        k += 1 + hit
    return out


def weighted(spark, pieces):
    return spark.createDataFrame([(list(p), f) for p, f in pieces.items()], "ids array<int>, freq long").repartition(3)


@pytest.mark.parametrize("head", [0, 1, 7, 10_000])
@pytest.mark.parametrize("letters, longest, seed", [("ab", 12, 1), ("abcde", 9, 2), ("abcdefghijklmnop", 14, 3), ("a", 40, 4)])
def test_training_is_the_plain_loop_whatever_the_driver_foretells(spark, head, letters, longest, seed, monkeypatch):
    """Runs of one letter, ties, and prophecies from nothing, few and all pre-tokens."""
    r = random.Random(seed)
    pieces = {"".join(r.choice(letters) for _ in range(r.randint(1, longest))).encode(): r.choice([1, 1, 2, 3, 50]) for _ in range(120)}
    monkeypatch.setattr(T, "REWRITE", 20)
    monkeypatch.setattr(T, "LEAST_BYTES", 200)
    assert T.learn_merges(weighted(spark, pieces), 60, head) == plain_merges(pieces, 60)


def test_training_on_nothing_and_on_nulls(spark):
    words = spark.createDataFrame([(None, 3), ([], 2), ([97], 5), ([97, 98], 1)], "ids array<int>, freq long")
    assert T.learn_merges(words, 5) == [] and T.learn_merges(words.limit(0), 5) == []


def test_round_trip_and_save(spark, corpus, tmp_path):
    tok = K.train_bpe(corpus, 330)
    tok.save(tmp_path / "t.json")
    again = K.Tokenizer.load(tmp_path / "t.json")
    assert again.merges == tok.merges and again.specials == tok.specials
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, "a<|endoftext|>b"])], "doc_id long, text string")
    ids = K.encode(df, tok)
    back = {r.doc_id: r.text for r in K.decode(ids, tok.vocabulary(spark), ["doc_id"]).collect()}
    for r in ids.collect():
        assert tok.decode(r.ids) == r.text == back[r.doc_id]
    assert tok.specials["<|endoftext|>"] in ids.where("doc_id = 8").first().ids
    assert tok.decode([999_999]) == ""


def test_special_tokens_keep_and_append_ids():
    tok = K.Tokenizer([(97, 98)])
    assert tok.add_specials(["<|endoftext|>", "<|x|>"]) == [257, 258]


def test_windows(spark):
    row = spark.createDataFrame([(1, list(range(33)))], "id long, ids array<int>")
    got = W.array_windows(row, 16).orderBy("window_id").collect()
    assert [(r.input[0], r.target[-1]) for r in got] == [(0, 16), (16, 32)]
    assert W.array_windows(spark.createDataFrame([(1, list(range(32)))], "id long, ids array<int>"), 16).count() == 1
    with pytest.raises(ValueError):
        W.check_length(4, 512)
    with pytest.raises(ValueError):
        W.check_vocab(70_000)
    offsets = W.random_offsets(spark, 50, 5000, 16, 3)
    assert offsets.collect() == W.random_offsets(spark, 50, 5000, 16, 3).collect()
    assert all(0 <= r.offset < 5000 - 17 for r in offsets.collect())


def test_chat_segments_join_to_the_rendering_and_parse_back(spark):
    call = [("c1", "calculate", '{"expression": "2+2"}')]
    turns = [(1, 0, "system", "Be kind.", None, None), (1, 1, "user", "2+2?", None, None), (1, 2, "assistant", "", "sum it", call), (1, 3, "tool", "4", None, None), (1, 4, "assistant", "It is 4.", None, None)]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, content string, thinking string, tool_calls {H.CALLS}")
    text = H.render(df, generation_prompt=False).first().text
    parts = H.supervised_segments(df).orderBy("pos").collect()
    assert "".join(p.text for p in parts) == text
    assert [p.is_target for p in parts] == [False, False, True, True, False, False, True, True]
    reply = spark.createDataFrame([('<|think|>sum it<|/think|><|call|>calculate {"expression": "2+2"}<|/call|>',)], "t string").select(H.parse_response(F.col("t")).alias("p")).first().p
    assert (reply.thinking, reply.content, [tuple(c) for c in reply.tool_calls]) == ("sum it", "", [("calculate", '{"expression": "2+2"}')])
    started = spark.createDataFrame([("still thinking",)], "t string").select(H.parse_response(F.col("t"), True).alias("p")).first().p
    assert (started.thinking, started.content) == ("still thinking", "")


def test_piece_totals_shuffle_no_pieces_of_single_keys(spark):
    from collections import defaultdict

    rows = [(1, "a b a b"), (2, ""), (3, None), (4, "x 12 12"), (4, "x y"), (None, "one two"), (None, "two"), (5, "\n  é é")]
    df = spark.createDataFrame(rows, "k long, text string")
    each = defaultdict(list)
    for r in df.select("k", F.explode(K.pretokenize(F.col("text"))).alias("p")).collect():
        each[r.k].append(r.p)
    got = K.piece_totals(df, "k")
    assert {r.k: (r.pieces, r.characters, r.kinds) for r in got.collect()} == {k: (len(p), sum(map(len, p)), len(set(p))) for k, p in each.items()}
    single = K.piece_totals(df.where("k = 1"), "k")
    metrics = single._jdf.queryExecution().optimizedPlan().toString()
    assert single.count() == 1 and "array_distinct" in metrics

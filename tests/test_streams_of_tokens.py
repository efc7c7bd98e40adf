"""One stream over all rows: encoding, places, windows and the flat file, against plain concatenation."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import stream as S
from corpusflow.operators import tokenizer as K
from corpusflow.sources.token_file import read_token_windows, write_token_file

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["in 1987 12,345", "don't we'll", "  two  blanks \n\n end ", "naïve שָׁלוֹם 漢字 ² 👍🏽", "".join(map(chr, range(256))), "", "aaaaaaaaaaaaa", "a<|endoftext|>b<|endoftext|>", "x" * 3000, None, "the same", "the same"]


def by_rank(tokenizer, piece):
    """The pair of lowest rank, the leftmost of equals, until none is left."""
    ids = list(piece)
    while len(ids) > 1:
        rank, at = min((tokenizer.rank.get(pair, len(tokenizer.rank)), k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
        if rank == len(tokenizer.rank):
            break
        ids[at : at + 2] = [256 + rank]
    return ids


@pytest.mark.parametrize("merges", [0, 200, None])
def test_bulk_encoding_is_the_loop_by_rank(spark, merges):
    tokenizer = K.published_tokenizer(PATH, merges)
    r = random.Random(5)
    pieces = [bytes(r.choice(b"the antion") for _ in range(r.randint(0, 30))) for _ in range(300)] + [b"", b"a", b"aaaa", "שלום".encode()]
    flat, lengths = tokenizer.encode_pieces(pieces)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [by_rank(tokenizer, p) for p in pieces]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    ids = {x.doc_id: x.ids for x in K.encode(rows, tokenizer).collect()}
    for k, text in enumerate(TEXTS):
        if text is None:
            assert ids[k] is None
        else:
            assert tokenizer.decode(ids[k]) == text
    pieces = spark.createDataFrame([(t,) for t in TEXTS if t and "<|" not in t], "t string").select("t", K.pretokenize(F.col("t")).alias("p")).collect()
    assert all(ids[TEXTS.index(x.t)] == [i for p in x.p for i in by_rank(tokenizer, p.encode())] for x in pieces)


def test_a_forgetful_worker_encodes_the_same(spark, monkeypatch):
    tokenizer = K.published_tokenizer(PATH, 500)
    rows = spark.createDataFrame([(k, f"word{k % 50} and more words {k % 7}") for k in range(300)], "doc_id long, text string").repartition(2)
    want = sorted(map(tuple, K.encode(rows, tokenizer).collect()))
    monkeypatch.setattr(K, "REMEMBERED", 40)
    assert sorted(map(tuple, K.encode(rows, tokenizer).collect())) == want


def test_remembered_pieces_are_bounded_with_what_python_needs(monkeypatch):
    """Short pieces cost far more than their bytes; before, 32 MB of them took over a GB of a worker."""
    import sys

    monkeypatch.setattr(K, "REMEMBERED", 1 << 20)
    tokenizer = K.published_tokenizer(PATH, 500)
    known = K._Dictionary(tokenizer, [])
    for k in range(40):
        pieces = [f"{k}{n}é" for n in range(500)]
        assert [x.tolist() for x in known.ids(pieces)] == [tokenizer.encode_piece(p.encode()) for p in pieces]
        assert sum(sys.getsizeof(p) + sys.getsizeof(x) + 100 for p, x in known.known.items()) < 1.2 * (1 << 20) and all(x.base is None for x in known.known.values())


def test_workers_get_bounded_batches(spark):
    """Long rows can't fill a worker: 10,000 of them were a batch before."""
    sizes = spark.sparkContext.accumulator(0)
    tokenizer = K.published_tokenizer(PATH, 50)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = K.encode(spark.range(6000).selectExpr("id", "concat('text ', id) AS text").coalesce(1), tokenizer)

    def count(batches):
        for batch in batches:
            sizes.add(int(len(batch) > 2000))
            yield batch

    assert ids.select("id").mapInArrow(count, "id long").count() == 6000 and sizes.value == 0
    back = K.decode(ids.unionByName(spark.createDataFrame([(-1, "", None), (-2, "", []), (-3, "", [None, 104, 99_999, 105, -5])], "id long, text string, ids array<int>")), tokenizer.vocabulary(spark), ["id"])
    got = {r.id: r.text for r in back.collect()}
    assert all(got[k] == f"text {k}" for k in range(6000)) and (got[-1], got[-2], got[-3]) == ("", "", "hi")


def test_a_long_piece_takes_no_quadratic_time():
    tokenizer = K.published_tokenizer(PATH)
    piece = bytes(random.Random(1).choices(b"etaoin shrdlu", k=400_000))
    assert b"".join(tokenizer.tokens[i] for i in tokenizer.encode_piece(piece)) == piece


def ids_table(spark, seed, n=60):
    r = random.Random(seed)
    rows = [(k, [r.randrange(1000) for _ in range(r.choice([0, 0, 1, 2, 5, 40]))]) for k in range(n)] + [(None, [5]), (3, None), (n, list(range(500))), (n + 1, [1, 2]), (n + 1, [1, 2])]
    return rows, spark.createDataFrame(rows, "k long, ids array<int>").repartition(3)


@pytest.mark.parametrize("length", [1, 2, 7, 16, 50])
def test_places_and_windows_are_those_of_the_concatenation(spark, length, tmp_path):
    rows, df = ids_table(spark, length)
    stream = S.TokenStream(df, ["k"], after=(7,))
    flat = []
    for row in sorted(stream.rows().collect(), key=lambda x: x.start):
        assert row.start == len(flat) and row.ids[-1] == 7
        flat += row.ids
    assert len(flat) == stream.tokens == sum(len(i or []) + 1 for _, i in rows)
    assert flat[:2] == [5, 7]  # a null key comes first
    want = [(w, flat[w * length : w * length + length], flat[w * length + 1 : w * length + length + 1]) for w in range((len(flat) - 1) // length)]
    assert sorted(map(tuple, stream.windows(length).collect())) == want
    assert sorted(map(tuple, stream.windows(length, limit=3).collect())) == want[:3]
    path = str(tmp_path / "tokens.bin")
    write_token_file(stream.rows(), path)
    assert np.fromfile(path, "<u2").tolist() == flat and os.listdir(tmp_path) == ["tokens.bin"]
    assert sorted(map(tuple, read_token_windows(spark, f"file://{path}", length, readBytes=4 * length).collect())) == want


def test_texts_are_encoded_where_they_lie(spark):
    tokenizer = K.published_tokenizer(PATH, 300)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "none"), (3, "other")], "doc_id long, text string").repartition(3)
    one = S.TokenStream(rows, ["doc_id"], after=(999,), tokenizer=tokenizer)
    ids = {tuple(r.ids): r.text or "" for r in K.encode(rows, tokenizer).select("text", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).collect()}
    got = [tuple(r.ids) for r in sorted(one.rows().collect(), key=lambda r: r.start)]
    assert [ids[g[:-1]] for g in got][:3] == ["none", TEXTS[0], TEXTS[1]] and sorted(ids[g[:-1]] for g in got) == sorted([t or "" for t in TEXTS] + ["none", "other"])
    assert all(g[-1] == 999 for g in got)


def test_short_streams_and_broken_writes(spark, tmp_path):
    _, df = ids_table(spark, 1)
    with pytest.raises(ValueError):
        S.TokenStream(df.limit(0), ["k"]).windows(4)
    path = str(tmp_path / "tokens.bin")
    write_token_file(spark.createDataFrame([(0, [1, 2])], "start long, ids array<int>"), path)
    for rows in ([(0, [1]), (2, [3])], [(0, [1, 2]), (1, [2])], [(0, [70_000])], [(0, [-1])]):
        with pytest.raises(Exception):
            write_token_file(spark.createDataFrame(rows, "start long, ids array<int>").repartition(2), path)
        # What was there stays, and nothing staged is left.
        assert os.listdir(tmp_path) == ["tokens.bin"] and np.fromfile(path, "<u2").tolist() == [1, 2]
    with pytest.raises(Exception):
        read_token_windows(spark, path, 512).collect()


def test_without_a_checkpoint_folder_set():
    """Spark refuses to change the setting while it runs, so the folder is kept here."""
    import subprocess
    import sys
    import tempfile

    code = "from pyspark.sql import SparkSession\nfrom corpusflow.operators.shared import shared_folder\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert s.conf.get('spark.checkpoint.dir', None) is None\nassert shared_folder(s) == shared_folder(s)\nfrom corpusflow.operators.state import ensure_checkpoint_dir\nensure_checkpoint_dir(s)\nassert s.range(3).checkpoint().count() == 3"
    with tempfile.TemporaryDirectory() as empty:
        subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"SPARK_CONF_DIR": empty}, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

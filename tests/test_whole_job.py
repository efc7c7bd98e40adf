"""Queries cover every row: results over whole tables, against the SQL without its cut or brute force."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import corpus as C
from corpusflow.operators import evaluation as E
from corpusflow.operators import tokenizer as K
from corpusflow.functions.text import SPACE
from corpusflow.plans import corpus_queries, eval_queries, registry

from .test_queries import rows
from .test_streams_of_tokens import by_rank
from .test_tokenizer import merged, plain_merges

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def same_as(spark, name, text, data):
    con = duckdb.connect()
    for file in os.listdir(data):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    want, got = con.execute(text), registry.QUERIES[name](spark, data)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", ["curve_points", "status_report", "throughput_eta", "best_checkpoint", "reached_step", "stats_payload"])
def test_log_queries_read_all_events(spark, name):
    cut = " WHERE event_id < 2000"
    assert spark.read.parquet(f"{LARGE}/events.parquet").where("event_id >= 2000").count() > 0
    same_as(spark, name, registry.SQL[name].replace(cut, ""), LARGE)


def test_log_blocks_give_the_same_as_one_block(spark):
    log = spark.range(500).where("id % 90 < 70").selectExpr("id + 1 AS step", "CASE WHEN id % 3 = 0 THEN 100 / (1 + id) + id * 7 % 11 END AS val_loss", "id * 10 AS tokens", "CAST(id + id % 7 AS DOUBLE) AS elapsed_seconds")
    for f, size in ((lambda n: E.best_checkpoints(log, n), 40), (lambda n: E.throughput(log, 9000, block=n), 3)):
        assert sorted(map(tuple, f(size).collect())) == sorted(map(tuple, f(10**9).collect()))


@pytest.mark.parametrize("name", ["mentions_number", "marker_match", "dominant_script", "refusal_match", "degenerate", "format_ok", "routing_ok", "arguments_ok", "relevance", "language_match", "eval_summary"])
def test_answer_checks_read_whole_documents(spark, name):
    same_as(spark, name, registry.SQL[name].replace(eval_queries._ANSWER, "text"), SMALL)


def test_answers_are_the_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 90
    assert {r.doc_id: r.answer for r in eval_queries.answers(spark, SMALL).collect()} == texts


def test_degenerate_meets_a_long_text_and_its_end(spark):
    plain = " ".join(f"w{k}" for k in range(20_000))
    texts = [(plain, False), (plain + " a b c" * 3, True), ("so " * 6, True), ("a b c d e", False), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(E.degenerate(F.col("t")).alias("d")).collect()
    assert [r.d for r in got[:4]] == [d for _, d in texts[:4]]


def plain_degenerate(text):
    words = text.split()
    keys = Counter(k for w in words if (k := w.strip(".,!?;:\"'")))
    thrice = lambda k: len(words) >= 2 * k and max(Counter(zip(*(words[i:] for i in range(k)))).values()) >= 3
    return len(words) >= 6 and (max(keys.values(), default=0) / len(words) > 0.4 or any(map(thrice, (3, 4, 5))))


def test_degenerate_is_told_a_batch_at_once(spark):
    draw = random.Random(3)
    spaces = ["\t", "\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", " ", "  "]
    texts = ["", " \u3000", "\u200b"]
    for _ in range(1500):
        known = draw.sample(["a", "b", "a.", "'a'", "...", "of", "ש", "é", "\u200b", "c:d", "\0", "so"], draw.choice([2, 4, 12]))
        texts.append("".join(draw.choice(known) + draw.choice(spaces) for _ in range(draw.choice([5, 6, 9, 14, 40]))))
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k long, t string").coalesce(1)
    got = df.select("k", E.degenerate(F.col("t")).alias("d"))
    # Folding each text's sorted words in the plan took 36 of 45 s on check_s.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "lambda" not in plan
    assert {r.k: r.d for r in got.collect()} == {**{k: plain_degenerate(t) for k, t in enumerate(texts)}, len(texts): None}


def test_scripts_and_blanks_by_a_first_look(spark):
    texts = {"": None, "a1b": None, "a1b2c": "en", "אב": None, "אבa": "he", "אבab": "en", "אבגab": "he", "日本語": None, "\u3000\n": None, None: "en"}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    assert [r.s for r in df.select("k", E.dominant_script(F.col("t")).alias("s")).orderBy("k").collect()] == list(texts.values())


def points(spark):
    return {r.doc_id: [ord(c) for c in r.text] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def real_ids(spark):
    """Every document's ids by a loop over ranks, and the stream with its end tokens."""
    from corpusflow.plans.token_queries import _tokenizer

    tokenizer, known = _tokenizer(), {}

    def encoded(pieces):
        for p in pieces:
            if p not in known:
                known[p] = by_rank(tokenizer, p.encode())
        return [i for p in pieces for i in known[p]]

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", K.pretokenize(F.col("text")).alias("p")).orderBy("doc_id").collect()
    ids = {r.doc_id: encoded(r.p) for r in rows}
    return ids, [i for own in ids.values() for i in [*own, 256 + len(tokenizer.merges)]]


def test_windows_of_the_stream_run_over_documents(spark, real_ids):
    _, flat = real_ids
    got = registry.QUERIES["bin_scan"](spark, SMALL).collect()
    assert {(r.window_id, r.input, r.target) for r in got} == {(w, " ".join(map(str, flat[32 * w : 32 * w + 32])), " ".join(map(str, flat[32 * w + 1 : 32 * w + 33]))) for w in range((len(flat) - 1) // 32)}
    got = registry.QUERIES["windows_sequential"](spark, SMALL).collect()
    assert {tuple(r) for r in got} == {(w, sum(flat[512 * w : 512 * w + 512]), flat[512 * w + 512]) for w in range((len(flat) - 1) // 512)}
    for r in registry.QUERIES["windows_random"](spark, SMALL).collect():
        assert r.input_sum == sum(flat[r.offset : r.offset + 512]) and r.last_target == flat[r.offset + 512]


def test_shift_target_covers_every_document(spark, real_ids):
    ids, _ = real_ids
    got = registry.QUERIES["shift_target"](spark, SMALL).select("doc_id", "pos", "token", "target").collect()
    assert Counter(map(tuple, got)) == Counter((i, k, t, own[k + 1] if k + 1 < len(own) else None) for i, own in ids.items() for k, t in enumerate(own))


def test_collate_pads_whole_texts(spark, real_ids):
    ids, _ = real_ids
    width = {}
    for i, own in ids.items():
        width[i // 8] = max(width.get(i // 8, 0), len(own))
    got = registry.QUERIES["collate"](spark, SMALL).collect()
    assert {tuple(r[c] for c in ("batch_id", "example_id", "ids_sum", "width", "padded")) for r in got} == {(i // 8, i, sum(own), width[i // 8], width[i // 8] - len(own)) for i, own in ids.items()}


def test_training_over_a_whole_table(spark):
    """Every pre-token of the documents, against a loop that counts all pairs anew for each merge."""
    freq = Counter({r.piece.encode(): r.freq for r in K.count_pieces(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()})
    assert K.train_bpe(spark.read.parquet(f"{SMALL}/documents.parquet"), 256 + 1 + 12).merges == plain_merges(freq, 12)


@pytest.fixture(scope="module")
def splits(spark):
    """Each split's chunks in seeded order, by plain Python."""
    chunks = corpus_queries.split(spark, SMALL).select("split", "doc_id", "chunk_idx", "text").collect()
    key = lambda r: (hashlib.md5(f"{C.SEED}|{r.doc_id}|{r.chunk_idx}".encode()).hexdigest(), r.doc_id, r.chunk_idx)
    return {name: sorted((r for r in chunks if r.split == name), key=key) for name in ("train", "val")}


def test_global_order_places_both_splits(spark, splits):
    want = {(name, r.doc_id, r.chunk_idx, k) for name, part in splits.items() for k, r in enumerate(part, 1)}
    got = registry.QUERIES["global_order"](spark, SMALL).select("split", "doc_id", "chunk_idx", "place").collect()
    assert len(splits["train"]) > len(splits["val"]) > 0 and len(got) == len(want) and set(map(tuple, got)) == want


def test_sink_split_text_digests_both_splits(spark, splits):
    body = {name: C.SEPARATOR.join(r.text for r in part) for name, part in splits.items()}
    want = {(name, len(b), hashlib.sha256(b.encode()).hexdigest()) for name, b in body.items()}
    assert set(map(tuple, registry.QUERIES["sink_split_text"](spark, SMALL).select("split", "characters", "sha256").collect())) == want


def plain_pieces(text):
    """The pattern by plain Python: each piece by its first character's kind, digits one by one."""
    import unicodedata

    space = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE) + "]")
    letter = lambda c: unicodedata.category(c) in ("Nl", "No") or unicodedata.category(c)[0] == "L"
    digit = lambda c: unicodedata.category(c) == "Nd"
    sign = lambda c: not space.match(c) and unicodedata.category(c)[0] not in "LN"
    out, k = [], 0
    while k < len(text):
        if m := re.compile("'(?:[sdmt]|ll|ve|re)").match(text, k):
            out.append(m[0])
            k = m.end()
            continue
        start = k + (text[k] == " " and k + 1 < len(text) and not space.match(text[k + 1]))
        if not space.match(text[start]):
            kind = next(f for f in (letter, digit, sign) if f(text[start]))
            end = start
            while end < len(text) and kind(text[end]):
                end += 1
            out += list(text[k:end]) if kind is digit else [text[k:end]]
        else:
            end = k
            while end < len(text) and space.match(text[end]):
                end += 1
            if end < len(text) and end - k > 1:
                end -= 1
            out.append(text[k:end])
        k = end
    return out


@pytest.fixture(scope="module")
def brute_pieces(spark):
    return {r.doc_id: plain_pieces(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_pieces_cover_every_character_of_the_texts(spark, brute_pieces):
    got = {tuple(r) for r in registry.QUERIES["pretokenize"](spark, SMALL).select("doc_id", "pieces", "characters", "kinds").collect()}
    assert got == {(i, len(p), len("".join(p)), len(set(p))) for i, p in brute_pieces.items() if p}
    assert sum(g[2] for g in got) == spark.read.parquet(f"{SMALL}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]


def test_counts_pairs_and_merges_hold_blank_pieces(spark, brute_pieces):
    freq = Counter(p for part in brute_pieces.values() for p in part)
    assert any(p.isspace() for p in freq)
    run = lambda name: [tuple(r) for r in registry.QUERIES[name](spark, SMALL).collect()]
    assert dict(run("pretoken_count")) == freq
    pairs = Counter()
    for p, n in freq.items():
        for pair in zip(p.encode(), p.encode()[1:], strict=False):
            pairs[pair] += n
    assert {(a, b): n for a, b, n in run("pair_count")} == pairs
    best = max(pairs, key=lambda p: (pairs[p], p))
    assert run("best_pair") == [(*best, pairs[best])]
    assert Counter((tuple(map(int, i.split())), n) for i, n in run("apply_merge")) == Counter((tuple(merged(list(p.encode()), 116, 104, 256)), n) for p, n in freq.items())
    encoded = registry.QUERIES["encode_piece"](spark, SMALL).collect()
    assert {r.piece for r in encoded} == set(freq) and len(encoded) == len(freq)


def test_agent_loop_replays_every_request(spark):
    assert spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id >= 100").count() > 0
    same_as(spark, "agent_loop", registry.SQL["agent_loop"].replace(" WHERE doc_id < 100", ""), SMALL)


def test_build_writes_chunks_texts_and_manifest(spark, tmp_path):
    import json

    from corpusflow.cli import build

    got = build(spark, SMALL, str(tmp_path))
    chunks = spark.read.parquet(f"{tmp_path}/chunks").collect()
    assert got["*"] == len(chunks) == sum(n for name, n in got.items() if name != "*")
    assert Counter(r.source for r in chunks) == {name: n for name, n in got.items() if name != "*"}
    for split in ("train", "val"):
        files = sorted((tmp_path / "text" / split).glob("part-*"))
        texts = "".join(f.read_text(encoding="utf-8") for f in files).split(C.SEPARATOR)[:-1]
        key = lambda r: (hashlib.md5(f"{C.SEED}|{r.doc_id}|{r.chunk_idx}".encode()).hexdigest(), r.doc_id, r.chunk_idx)
        assert texts == [r.text for r in sorted((r for r in chunks if r.split == split), key=key)]
    (line,) = [x for f in (tmp_path / "manifest").glob("part-*") for x in f.read_text().splitlines()]
    manifest = json.loads(line)
    assert manifest["split"] == {"val_fraction": C.HELD_OUT, "seed": C.SEED, "unit": "characters"}
    assert manifest["chunks"] == manifest["chunks_train"] + manifest["chunks_val"] and manifest["characters"] == sum(len(r.text) for r in chunks)
    assert manifest["skipped_too_short"] > 0

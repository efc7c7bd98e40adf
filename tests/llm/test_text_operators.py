"""The operators against brute force on small tables with nulls, empty and long texts, ties and copies."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tkey string, id string"


def prose(seed: int, n: int, letters: str = "abcdefgh") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def table(spark, rows):
    """rows: (doc_id, text[, lang]); two more columns have names that operators use inside."""
    full = [(i, t, rest[0] if rest else "en", "s", len(t or ""), "x", "y") for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    base = [(i, prose(i, 60 + i)) for i in range(30)]
    words = base[3][1].split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    shared = prose(900, 120)
    extra = [
        (100, None), (101, ""), (102, "   \n\t"), (103, base[3][1]), (104, near), (105, "one two"), (106, "one two"), (107, "One  TWO"),
        (108, prose(7, 3000)), (109, prose(8, 90) + " " + shared + " " + prose(9, 20)), (110, prose(10, 50) + " " + shared), (111, "ab " * 300),
        (112, "line here\nline here\nother\n\n" * 5), (113, "É" * 450 + prose(3, 4)), (114, "É" * 450), (115, "same " * 30), (None, prose(77, 70)), (None, None), (5, base[5][1]), (5, base[5][1]),
    ]
    return base + extra


def words_of(text):
    return (text or "").encode().split()


def test_quality_against_brute_force(spark, rows):
    from corpusflow.llm import quality

    got = Counter(tuple(r) for r in quality.quality_cascade(table(spark, rows)).drop("rejected_by").collect())
    want = Counter()
    for i, text in rows:
        text, w = text or "", words_of(text)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        held = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in text.split("\n") if x.encode().strip(b" \t\n\r\x0b\x0c")]
        failed = len(w) < 20 or 100 * len(held) > 30 * len(w)
        chars, symbols, dup = sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))
        letters, upper = sum(c.isascii() and c.isalpha() for c in text), sum("A" <= c <= "Z" for c in text)
        bad = 10 * symbols > len(w) or 10 * upper > 3 * max(letters, 1) or 5 * text.count("!") > len(w) or 2 * chars < 5 * len(w) or chars > 20 * len(w) or 10 * dup > 3 * max(len(lines), 1)
        want[(i, len(w), chars, symbols, dup, len(held), failed, not failed and not bad)] += 1
    assert got == want


def test_rule_order_is_by_rejections_per_second():
    from corpusflow.llm import quality

    a, b, c = (quality.Rule(n, None) for n in "abc")
    measured = [{"rule": "a", "rejected": 5, "seconds": 1.0}, {"rule": "b", "rejected": 5, "seconds": 0.1}, {"rule": "c", "rejected": 0, "seconds": 0.001}]
    assert [r.name for r in quality.order_rules([a, b, c], measured)] == ["b", "a", "c"]


def test_cascade_runs_a_rule_only_on_texts_that_are_left():
    from corpusflow.llm import quality

    seen = []
    count = quality.Rule("count", lambda b: seen.append(len(b)) or np.zeros(len(b), bool))
    first = quality.Rule("first", lambda b: b.n_words > 1)
    import pyarrow as pa

    verdict = quality.run_cascade(quality.TextBlock.of(pa.array(["a", "a b", "c", None])), [first, count])
    assert seen == [3] and verdict.tolist() == [2, 0, 2, 2]


def test_repeats_against_brute_force(spark, rows):
    from corpusflow.llm import suffix_dedup

    shared = prose(901, 100)
    more = [*rows, (200, shared + prose(1, 3)), (201, "x" + shared[5:] + " tail"), (202, prose(2, 5) + shared[:420] + "zz"), (203, shared[100:499] + "q"), (204, "xy" * 500), (205, "y" + "xy" * 210), (206, prose(3, 4) + "é" + shared[30:460])]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(table(spark, more), keep=("doc_id",)).collect())
    bodies = [(t or "").encode() for _, t in more]
    grams = Counter(b[k : k + 400] for b in bodies for k in range(len(b) - 399))
    want = Counter()
    for (i, _), b in zip(more, bodies, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 399):
            if grams[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want


@pytest.mark.parametrize("length", [128, 200])
def test_shorter_repeats_against_brute_force(spark, rows, length):
    from corpusflow.llm import suffix_dedup

    shared = prose(902, 60)
    more = [*rows, (200, shared[:300] + prose(1, 3)), (201, "x" + shared[5 : 5 + length] + " tail"), (202, prose(2, 5) + shared[40 : 39 + length] + "zz"), (203, "xy" * 150), (204, "y" + "xy" * 110), (205, prose(3, 4) + "é" + shared[30:260])]
    got = Counter((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table(spark, more), keep=("doc_id",), length=length).collect())
    bodies = [(t or "").encode() for _, t in more]
    grams = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    want = Counter()
    for (i, _), b in zip(more, bodies, strict=True):
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - length + 1):
            if grams[b[k : k + length]] > 1:
                gone[k : k + length] = 1
        want[(i, int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()))] += 1
    assert got == want


def test_repeats_among_many_edited_copies(spark):
    """Copies with their own edits, copies of copies, and a passage that many texts share."""
    from corpusflow.llm import suffix_dedup

    base, rows = prose(77, 220), []
    for i in range(40):
        words = base.split(" ")
        for k in range(i % 4):
            words[(37 * i + 61 * k) % len(words)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(300 + i, 20) + base[200:650] + prose(400 + i, 20)) for i in range(12)] + [(200, rows[5][1]), (201, rows[5][1])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(table(spark, rows), keep=("doc_id",)).collect()}
    grams = Counter(t.encode()[k : k + 400] for _, t in rows for k in range(len(t.encode()) - 399))
    for i, text in rows:
        b = text.encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for k in range(len(b) - 399):
            if grams[b[k : k + 400]] > 1:
                gone[k : k + 400] = 1
        assert got[i] == (int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()))


def test_repeats_with_clashing_columns(spark):
    from corpusflow.llm import suffix_dedup

    shared = prose(31, 120)
    df = spark.createDataFrame([(1, shared, "a", b"k", 7), (2, shared, None, None, 8), (3, "short", "c", b"", 9), (None, None, None, None, None)], "doc_id long, text string, tkey string, _row binary, n_bytes long")
    got = suffix_dedup.remove_repeats(df, keep=("doc_id", "tkey", "_row", "n_bytes", "text"), with_text=True)
    assert got.columns == ["doc_id", "tkey", "_row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_removed == rows[2].n_removed == len(shared.encode()) and rows[1].kept_text == "" and rows[1].tkey == "a"
    assert rows[3].kept_text == "short" and rows[3].n_removed == 0 and rows[None].n_bytes == 0


def test_long_text_is_ranked_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    from corpusflow.llm import suffix_dedup as s
    from corpusflow.llm.bytesops import text_buffers

    text = prose(5, 3000)
    whole = s.picks(*text_buffers(pa.array([text, "short"])))
    monkeypatch.setattr(s, "BLOCK", 1000)
    parts = s.picks(*text_buffers(pa.array([text, "short"])))
    spread = lambda p: sorted((r, w, int(k)) for r, a, b, _, k in zip(*p, strict=True) for w in range(a, b + 1))
    assert spread(whole) == spread(parts) and len(spread(whole)) == len(text) - 399


def jaccard_brute(rows, n=5, percent=75):
    sets = []
    for _, text in rows:
        w = [x.lower() for x in words_of(text)]
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows))


def test_jaccard_components_against_brute_force(spark, rows):
    from corpusflow.llm import ngram_join

    r = random.Random(4)
    group, base = [], prose(50, 160).split()
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"v{k}x{r.randint(0, 3)}"
        group.append((300 + k, " ".join(w[: 160 - r.randint(0, 9)])))
    more = [*rows, *group]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(table(spark, more)).collect())
    assert got == jaccard_brute(more)


def components_of(edges):
    least = {x: x for e in edges for x in e}
    while any(least[u] != least[v] for u, v in edges):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    return least


def test_components_join_by_new_links_only(spark, monkeypatch):
    from corpusflow.llm import components

    r = random.Random(5)
    first = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(x, x + 1) for x in range(100, 112)]
    first += [(v, u) for u, v in first[:5]] + first[:5]
    more = [(r.randrange(120), r.randrange(120)) for _ in range(20)]
    first, more = ([e for e in edges if e[0] != e[1]] for edges in (first, more))
    one = components.joined_components(None, spark.createDataFrame(first, "u long, v long"))
    assert {x.node: x.component for x in one.collect()} == components_of(first)
    two = components.joined_components(one, spark.createDataFrame(more, "u long, v long"))
    assert Counter((x.node, x.component) for x in two.collect()) == Counter(components_of(first + more).items())

    written = []
    real = components.Stored.__init__
    monkeypatch.setattr(components.Stored, "__init__", lambda self, df, name, lasting=False: (written.append(name), real(self, df, name, lasting))[1])
    stars = [(i, i % 7) for i in range(7, 90)]
    got = components.connected_components(spark.createDataFrame(stars, "u long, v long"))
    assert {x.node: x.component for x in got.collect()} == components_of(stars)
    assert len(written) == 2  # the links and each node's least neighbour; no round


def test_filters_never_lose_a_link():
    from corpusflow.llm import ngram_join as j

    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64))
        b = np.unique(np.concatenate([r.permutation(a)[: r.integers(0, len(a) + 1)], r.integers(0, 60, r.integers(1, 10)).astype(np.uint64)]))
        same, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert j.linked(a, b, 75) == (100 * same >= 75 * union)
        if 100 * same >= 75 * union:
            assert set(a[: j.prefix_length(len(a), 75)].tolist()) & set(b[: j.prefix_length(len(b), 75)].tolist())


def test_byte_bpe_is_the_library(spark, rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    from corpusflow.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = [*rows, (400, "aaaa" * 5000), (401, "👍🏽 漢字 it's x  <|endoftext|>\r\n")]
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.ids)) for x in bpe.encode_documents(table(spark, more), path, P.PATTERN).collect())
    want = Counter()
    for i, t in more:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids))] += 1
    assert got == want


def test_long_texts_are_split_in_steps(monkeypatch):
    import public_tokenizers as P

    from corpusflow.llm import bpe

    text, path = prose(1, 400) + "\n\n  end", P.path("byte_bpe_50k.tiktoken")
    whole = bpe.encode_texts([text, "a b", text], path, P.PATTERN)
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "STEP", 7)
    parts = bpe.encode_texts([text, "a b", text], path, P.PATTERN)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert bpe.decode_ids(whole[0], path).decode() == text


def test_rank_queue_pops_in_order():
    from corpusflow.llm.bpe import RankQueue

    r, queue = random.Random(2), RankQueue(50_000)
    ranks = {r.randrange(50_000) for _ in range(2000)}
    for x in ranks:
        queue.push(x)
        queue.push(x)
    assert [queue.pop() for _ in ranks] == sorted(ranks) and queue.pop() == -1


def test_packing_places_every_id_once(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from corpusflow.llm import packing

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    more = [*[(i if i is not None else 900 + k, t) for k, (i, t) in enumerate(rows)], (500, prose(6, 9000)), (501, "É漢 İx y ²½ don't")]
    more = [(1000 + k, t) for k, (_, t) in enumerate(more)]
    pieces = packing.pack_documents(table(spark, more), path).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in more}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p.length
        assert at <= 4096
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= -(-total // 4096) + 1


def test_open_windows_best_fit_and_fullest_out():
    from corpusflow.llm.packing import OpenWindows

    w = OpenWindows(2, 10)
    assert not w.place(6, "a")
    w = OpenWindows(2, 10)
    w.place(6, "a"), w.place(7, "b")
    assert w.place(3, "c") == [(1, [(0, "b"), (7, "c")])]
    w.place(5, "d")
    assert w.place(9, "e") == [(0, [(0, "a")])]


def test_shards_are_near_equal_and_numbered(spark, rows):
    from corpusflow.llm import sharding

    more = [*rows, *((1000 + k, prose(k, 40 + k % 90), "fr" if k % 3 else None) for k in range(700)), *((5000 + k, "copy of one text " * 4) for k in range(400))]
    got = sharding.kd_shards(table(spark, more), 8).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in more)
    sizes, slots = Counter(), {}
    for x in got:
        sizes[x.shard] += x.size
        slots.setdefault(x.shard, []).append(x.slot)
    mean = sum(sizes.values()) / 8
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in more)
    assert set(sizes) == set(range(8)) and all(abs(s - mean) <= 0.02 * mean + largest for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for x in got:
        homes.setdefault((x.size, x.text_crc32), set()).add(x.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_equal_texts_share_a_shard_whatever_their_metadata(spark):
    from corpusflow.llm import sharding

    rows = [(k, prose(k, 30 + k % 50), f"l{k % 3}", f"s{k % 7}") for k in range(3000)]
    rows += [(5000 + k, rows[k % 300][1], None if k % 4 == 0 else f"l{k % 5}", f"t{k % 11}") for k in range(600)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).collect()
    text, homes = {r[0]: r[1] for r in rows}, {}
    for x in got:
        homes.setdefault(text[x.doc_id], set()).add(x.shard)
    assert len(got) == 3600 and len(homes) < 3600 and all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("rows_", [[], [(1, None)], [(1, ""), (2, "")]])
def test_tiny_tables(spark, rows_):
    import public_tokenizers as P

    from corpusflow.llm import bpe, hmm_lm, langid, ngram_join, packing, quality, sharding, suffix_dedup

    df = table(spark, rows_)
    n = len(rows_)
    assert quality.quality_cascade(df).count() == n
    assert suffix_dedup.remove_repeats(df, keep=("doc_id",)).count() == n
    assert bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == n
    assert [x.length for x in packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()] == [1] * n
    assert sharding.kd_shards(df, 4).count() == n
    assert all(x.component_id == x.doc_id for x in ngram_join.jaccard_components(df).collect())
    assert all(x.lang_pred == "und" and x.score == 0 for x in langid.identify_language(df).collect())
    assert all(x.n_tokens == 1 for x in hmm_lm.score_texts(df).collect())

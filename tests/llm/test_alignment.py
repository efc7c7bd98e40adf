"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from corpusflow.llm import alignment
from tests.llm.test_text_operators import SCHEMA, prose, table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "\n"), (6, "one"), (7, " one"), (8, "one "), (9, "a  b   c\n d \n\n  e\t f "), (10, "it's  odd  space 　x"),
    (11, "a ▁ b"), (12, "x▁"), (13, "<s> </s> <unk> <0x41> <|endoftext|> <pad>"), (14, "Ça va où naïve 漢字 かな 😀😀 ‍ é"), (15, "\x00 \x01 \x1f \x85 \x0b"), (16, "1987 12,345.67 $5 -- !!! ??"),
    (17, "word " * 3000), (18, "x" * 5000), (19, "same text here, twice."), (20, "same text here, twice."), (None, "same text here, twice."), (None, None), (21, "same text here, twice."), (21, "same text here, twice."), (22, "﻿ bom \r\n line\r\n"),
    (23, "a ▁ b same text here, twice. onlyhere"),
] + [(100 + i, prose(i, 50 + i)) for i in range(40)]


def by_hand(rows):
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    surface = {v: k for k, v in byte_letters().items()}
    out, links = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a = [(x, bytes(surface[c] for c in pair.a.id_to_token(x))) for x in pair.a.encode(" " + text, add_special_tokens=False).ids]
            b = [(x, bytes([int(n[3:5], 16)]) if pair.b.is_byte(x) else n.replace("▁", " ").encode()) for x in pair.b.encode(text) for n in [pair.b.id_to_piece(x)]]
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                ends = [set(), set()]
                for side, tokens in enumerate((a, b)):
                    at = 0
                    for _, t in tokens:
                        at += len(t)
                        ends[side].add(at)
                for side, tokens in enumerate((a, b)):
                    at, own = 0, [[]]
                    for x, t in tokens:
                        own[-1].append(x)
                        at += len(t)
                        if at in ends[0] & ends[1]:
                            own.append([])
                    groups.append(own[:-1])
                groups = list(zip(*groups, strict=True))
        out.append((i, groups))
        links.update((a[-1], b[-1]) for a, b in groups)
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    full = []
    for i, groups in out:
        pairs = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        full.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(pairs), sum(links[p] == best[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return sorted(full, key=repr)


def byte_letters():
    """The character of each byte in a byte-level token."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def test_alignment_against_whole_texts(spark):
    got = alignment.align_documents(table(spark, TEXTS), A, B, with_groups=True).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(TEXTS)


def test_small_blocks_and_steps(spark, monkeypatch):
    """Many blocks, texts parted in steps, and pairs joined by shuffle give the same."""
    from corpusflow.llm import common

    rows = TEXTS + [(500, " ".join(t or "" for _, t in TEXTS if t and "▁" not in t))]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    monkeypatch.setattr(alignment, "STEP_CHARS", 50)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    # What workers run must see the small limits, so they are called here, and rows by Spark.
    text = rows[-1][1]
    assert " ".join(p for part in alignment.parted(text) for p in part) == text and sum(1 for _ in alignment.parted(text)) > 20
    got = alignment.align_documents(table(spark, rows), A, B, with_groups=True).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)


def test_texts_part_where_both_tokenizers_cut():
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    for _, text in TEXTS:
        if text and "▁" not in text:
            pieces = [p for part in alignment.parted(text) for p in part]
            assert pieces == alignment.EDGE.split(text)
            assert pair.tokens_a(pieces) == [x for p in pieces for x in pair.a.encode(" " + p, add_special_tokens=False).ids] == pair.a.encode(" " + text, add_special_tokens=False).ids
            assert pair.tokens_b(pieces) == pair.b.encode(text)


def test_empty_table_and_clashing_columns(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    rows = table(spark, [(1, "some text")]).withColumnRenamed("tkey", "piece").withColumnRenamed("id", "places")
    assert alignment.align_documents(rows, A, B).count() == 1


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_against_whole_texts(spark, size):
    d = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = alignment.op13_cross_tokenizer_alignment(spark, d).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((r[:-1] for r in by_hand(rows)), key=repr)

"""Cleaning and chunking on texts with known results."""

import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import corpus as C

CASES = [
    ("generic", "a\r\nb", "a\nb"),
    ("generic", "a\n\n\n\n\nb", "a\n\nb"),
    ("generic", "line   \nnext\t\n", "line\nnext"),
    ("generic", "é  x", "é  x"),
    ("generic", "\xa0　x\x1c", "x"),
    ("gutenberg", "[Title by A. Writer 1816]\n\nEmma was here [and looked up] today.", "Emma was here [and looked up] today."),
    ("gutenberg", "Body.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ngive money", "Body."),
    ("europarl", "<SPEAKER ID=1 NAME=x>\nI declare it open.", "I declare it open."),
    ("gutenberg_extended", "head\n" * 400 + "*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nProduced by A and\nthe Team\n\nReal prose.\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\n" + "tail\n" * 200, "Real prose."),
    ("gutenberg_extended", "No markers at all.", "No markers at all."),
    ("brown", "The/at jury/nn said/vbd ,/, didn't/dod* it/pps ?/.", "The jury said, didn't it?"),
    ("brown", "``/`` Yes/uh ''/'' ,/, he/pps said/vbd ./.", '"Yes", he said.'),
    ("brown", "(/( see/vb it/ppo )/) 1/2/cd", "(see it) 1/2"),
    ("benyehuda", "שלום רב&nbsp;↩︎ עולם &amp; עוד.", "שלום רב  עולם & עוד."),
    ("benyehuda", "טקסט\n\n" + T.HEBREW_FOOTER + " באינטרנט\nhttps://x", "טקסט"),
]


@pytest.mark.parametrize(("cleaner", "raw", "want"), CASES)
def test_cleaner(spark, cleaner, raw, want):
    df = spark.createDataFrame([(raw, cleaner)], "text string, cleaner string")
    assert T.clean_by(df, "cleaner", "text").first().text == want


def test_unknown_cleaner_is_generic_and_null_stays(spark):
    df = spark.createDataFrame([(" a ", None), (None, "brown"), (" b ", "other")], "text string, cleaner string")
    assert sorted((r.text or "-") for r in T.clean_by(df, "cleaner", "text").collect()) == ["-", "a", "b"]


def fold(text, most, least, separator):
    if len(text) <= most:
        return [text]
    out, now, size = [], [], 0
    for part in text.split(separator):
        if now and size + len(part) > most:
            out.append(separator.join(now))
            now, size = [], 0
        now.append(part)
        size += len(part) + len(separator)
    return [c for c in [*out, separator.join(now)] if len(c) >= least]


@pytest.mark.parametrize("text", ["short", "\n\n".join(["A sentence of some length. " * 20] * 60), "x" * 100_000, "\n\n".join(f"Paragraph {i}." for i in range(5000)), "\n\n" * 9000, "a" * 16384 + "\n\nb"])
def test_chunks(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(C.chunk_array(F.col("text"))).first()[0]
    assert got == fold(text, C.MAX_CHARS, C.MIN_CHARS, "\n\n")


def test_held_out_split_is_a_prefix_of_the_seeded_order(spark):
    import hashlib

    rows = [(i, "s%d" % (i % 3), "x" * (50 + i * 37 % 400)) for i in range(900)] + [(5000, None, "y" * 10)]
    got = {r.doc_id: r.split for r in C.held_out_split(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"], per_mille=50).collect()}
    for source in ("s0", "s1", "s2", None):
        own = sorted((hashlib.md5(f"1729|{i}".encode()).hexdigest(), i, len(t)) for i, s, t in rows if s == source)
        total, before = sum(n for _, _, n in own), 0
        for _, i, n in own:
            assert got[i] == ("val" if before * 1000 < total * 50 else "train")
            before += n


def test_split_digests_keep_texts_off_the_driver(spark, monkeypatch, tmp_path):
    """Texts go from task to files to the one task that hashes them; rows of many partitions, a null, a split of one."""
    import hashlib

    from pyspark.sql import DataFrame

    def refuse(*_, **__):
        raise AssertionError("rows came to the driver")

    for way in (DataFrame, type(spark.range(1))):
        monkeypatch.setattr(way, "toLocalIterator", refuse)
    rows = [(i * 7919 % 1000, ("train", "val")[i % 10 == 3], None if i == 5 else f"é{i}\n" * (i % 17)) for i in range(1000)] + [(0, "one", "😀")]
    df = spark.createDataFrame(rows, "o long, split string, text string").repartition(5)
    want = {}
    for split in ("train", "val", "one"):
        body = C.SEPARATOR.join(t for _, s, t in sorted((r for r in rows if r[2] is not None)) if s == split)
        want[split] = {"characters": len(body), "sha256": hashlib.sha256(body.encode()).hexdigest()}
    assert C.digest_splits(df, ["o"]) == want
    assert C.write_split(df.where("split = 'val'"), ["o"], tmp_path / "v.txt") == want["val"]
    assert hashlib.sha256((tmp_path / "v.txt").read_bytes()).hexdigest() == want["val"]["sha256"]
    assert C.write_split(df.where("split = 'no'"), ["o"], tmp_path / "e.txt")["characters"] == 0 and (tmp_path / "e.txt").read_bytes() == b""


def test_texts_are_computed_once_for_a_split_and_a_sample(spark):
    """Chunks are written once and read again; before, every use of them cleaned and cut the texts anew."""
    from corpusflow.operators.sampling import stream_sample

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    df = spark.createDataFrame([(i, "s", f"line {i}\n" * 40) for i in range(50)], "doc_id long, source string, text string")
    made = C.chunks(df.withColumn("text", seen("text")), shortest=10, most=200, least=10, separator="\n")
    split = C.held_out_split(made, ["doc_id", "chunk_idx"], per_mille=50)
    assert {r.split for r in split.unionByName(split).select("split").distinct().collect()} == {"train", "val"} and calls.value == 50
    assert stream_sample(made, ["doc_id", "chunk_idx"], 4000).count() >= 40 and calls.value == 100


def test_written_split_agrees_with_its_hash(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([(2, "b\r"), (1, "é")], "o long, text string")
    made = C.write_split(df, ["o"], tmp_path / "x.txt")
    body = "é" + C.SEPARATOR + "b\r"
    assert (tmp_path / "x.txt").read_bytes() == body.encode()
    assert made == {"characters": len(body), "sha256": hashlib.sha256(body.encode()).hexdigest()} == C.ordered_text(df, "o").first().asDict()


def test_untagged_words_by_hand(spark):
    """Every word's last tag, quotes that are words, blanks and lines, over odd marks; no function runs for each word."""
    import random
    import re

    from corpusflow.functions import text as T

    blanks = [" ", "  ", "\t", "\n", "\n\n", " \n ", "\r\n", "\u2028", "\xa0", "\x85", ""]
    words = ["a", "``", "''", "``/``", "''/''", "/x", "//x", "a/b/c", "a/", "/", ".", "./.", "(/(", ")/)", "``x", "x''", 3 * chr(39), "\x01", "é/nn", "[", "{ }", "%", "😀/😀"]
    space = T.SPACE.replace("\\x{", "\\u").replace("}", "")
    r = random.Random(4)
    texts = [None, "", " ", "\n", *("".join(r.choice(words) + r.choice(blanks) for _ in range(r.randint(1, 25))) for _ in range(600))]

    def by_hand(text):
        lines = []
        for line in text.split("\n"):
            bare = [re.sub(rf"/[^/{space}]+\Z", "", w) for w in re.split(rf"[{space}]+", line)]
            lines.append(" ".join({"``": "\x01", "''": "\x02"}.get(w, w) for w in bare if w))
        made = "\n".join(lines)
        for a, b in ((rf"[{space}]*\x01[{space}]*", ' "'), (rf"[{space}]*\x02[{space}]*", '" '), (rf"[{space}]+([.,;:!?%)\]}}])", r"\1"), (rf"([(\[{{])[{space}]+", r"\1")):
            made = re.sub(a, b, made)
        return made

    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.untag_words(F.col("t")).alias("t"))
    assert {x.k: x.t for x in df.collect()} == {k: None if t is None else by_hand(t) for k, t in enumerate(texts)}
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()

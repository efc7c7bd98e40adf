"""Tokenizer and window queries over the test tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import tokenizer as K
from ..operators import windows as W
from ..operators.shared import drop_place, new_place
from ..operators.stream import TokenStream
from ..sources.token_file import read_token_windows, windows_at, write_token_file
from .common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def docs(spark, d):
    return table(spark, d, "documents")


# SQL's regular expressions have no look-ahead; a mark is set before the last blank of a run that a word follows.
_PIECE = K.PATTERN.replace(rf"|[{SPACE}]+(?![^{SPACE}])", "").replace(rf"[^{SPACE}", rf"[^\x{{E000}}{SPACE}").replace("'", "''")
_SPLIT = f"regexp_extract_all(regexp_replace(text, '([{SPACE}]+)([{SPACE}][^{SPACE}])', '\\1' || chr(57344) || '\\2', 'g'), '{_PIECE}')"
_PIECES = f"""q AS (SELECT doc_id, lang, unnest({_SPLIT}) AS p FROM documents),
s AS (SELECT doc_id, lang, unnest(CASE WHEN regexp_matches(p, '\\p{{Nd}}') THEN regexp_extract_all(p, '(?s).') ELSE [p] END) AS piece FROM q)"""


def pieces(spark, d):
    return docs(spark, d).select("doc_id", "lang", F.explode(K.pretokenize(F.col("text"))).alias("piece"))


query("pretokenize", f"WITH {_PIECES} SELECT doc_id, count(*) AS pieces, CAST(sum(length(piece)) AS BIGINT) AS characters, count(DISTINCT piece) AS kinds FROM s GROUP BY doc_id")(
    lambda spark, d: K.piece_totals(docs(spark, d), "doc_id")
)
query("digit_split", f"WITH {_PIECES} SELECT piece, count(*) AS n FROM s WHERE regexp_matches(piece, '\\p{{Nd}}') GROUP BY piece")(lambda spark, d: pieces(spark, d).where(F.col("piece").rlike(r"\p{Nd}")).groupBy("piece").agg(F.count("*").alias("n")))
query("special_split", "SELECT doc_id, len(string_split(t, '<|endoftext|>')) AS parts, md5(array_to_string(string_split(t, '<|endoftext|>'), '#')) AS digest FROM (SELECT doc_id, replace(text, '. ', '<|endoftext|>') AS t FROM documents)")(
    lambda spark, d: docs(spark, d).select("doc_id", K.without_specials(F.replace("text", F.lit(". "), F.lit(K.END_OF_TEXT))).alias("p")).select("doc_id", F.size("p").cast("long").alias("parts"), F.md5(F.array_join("p", "#")).alias("digest"))
)
query("pretoken_count", f"WITH {_PIECES} SELECT piece, count(*) AS freq FROM s GROUP BY piece")(lambda spark, d: pieces(spark, d).groupBy("piece").agg(F.count("*").alias("freq")))
_BYTES = f"""{_PIECES}, w AS (SELECT piece, count(*) AS freq FROM s GROUP BY piece), h AS (SELECT freq, hex(encode(piece)) AS x FROM w),
b AS (SELECT freq, x, unnest(generate_series(1, length(x) // 2 - 1)) AS i FROM h WHERE length(x) > 2),
a AS (SELECT CAST(('0x' || substring(x, 2 * i - 1, 2)) AS INTEGER) AS "left", CAST(('0x' || substring(x, 2 * i + 1, 2)) AS INTEGER) AS "right", CAST(sum(freq) AS BIGINT) AS n FROM b GROUP BY 1, 2)"""


def words(spark, d):
    return pieces(spark, d).groupBy("piece").agg(F.count("*").alias("freq")).select(K.byte_ids(F.col("piece")).alias("ids"), "freq")


query("pair_count", f'WITH {_BYTES} SELECT "left", "right", n FROM a')(lambda spark, d: K.pair_counts(words(spark, d)))
query("best_pair", f'WITH {_BYTES} SELECT "left", "right", n FROM a ORDER BY n DESC, "left" DESC, "right" DESC LIMIT 1')(lambda spark, d: K.best_pair(K.pair_counts(words(spark, d))))


#: Merges of the published vocabulary that the queries' tokenizer has: as many as SQL can nest.
MERGES = 200
LENGTH = 512


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(merges: int = MERGES) -> K.Tokenizer:
    return K.published_tokenizer(_path(), merges)


def _encoded(spark, d):
    return K.encode(docs(spark, d).select("doc_id", "lang", "text"), _tokenizer())


def _ids_sql() -> str:
    """Encoding in SQL: ids as groups of four hex digits; one replacement for each merge, in order, within pieces."""
    merged = "x"
    for rank, (left, right) in enumerate(_tokenizer().merges):
        merged = f"replace({merged}, ' {left:04X} {right:04X}', ' {256 + rank:04X}')"
    return f"""p AS (SELECT doc_id, lang, text, flatten(list_transform({_SPLIT}, lambda p: CASE WHEN regexp_matches(p, '\\p{{Nd}}') THEN regexp_extract_all(p, '(?s).') ELSE [p] END)) AS pieces FROM documents),
h AS (SELECT doc_id, lang, text, array_to_string(list_transform(pieces, lambda p: regexp_replace(hex(encode(p)), '(..)', ' 00\\1', 'g')), '|') AS x FROM p),
i AS (SELECT doc_id, lang, text, list_transform(regexp_extract_all({merged}, '[0-9A-F]{{4}}'), lambda t: CAST('0x' || t AS INTEGER)) AS ids FROM h)"""


_IDS = _ids_sql()
_END = 256 + MERGES
_FLAT = f"""{_IDS}, t AS (SELECT row_number() OVER (ORDER BY doc_id, j) - 1 AS pos, token FROM (SELECT doc_id, unnest(list_append(ids, {_END})) AS token, generate_subscripts(list_append(ids, {_END}), 1) AS j FROM i))"""


def _stream(spark, d) -> TokenStream:
    """All documents by id, each closed by the end-of-text token."""
    return TokenStream(docs(spark, d), ["doc_id"], after=(_tokenizer().specials[K.END_OF_TEXT],), tokenizer=_tokenizer())


def _from_file(spark, d, read):
    """``read`` over the documents' token file, which lies in the shared folder until its rows are stored."""
    stream = _stream(spark, d)
    path = new_place(spark, "tokens")
    write_token_file(stream.rows(), path)
    try:
        return read(path, stream.tokens).checkpoint()
    finally:
        drop_place(spark, path)


@query("bpe_train")
def bpe_train(spark, d):
    tokenizer = K.train_bpe(docs(spark, d), 600)
    return spark.createDataFrame([(r, bytearray(tokenizer.tokens[a]), bytearray(tokenizer.tokens[b])) for r, (a, b) in enumerate(tokenizer.merges)], "rank int, left binary, right binary")


def _digest(ids: str):
    return F.md5(F.array_join(ids, " ").cast("binary"))


_JOINED = "md5(array_to_string(ids, ' '))"
query("apply_merge", f"""WITH {_PIECES}, w AS (SELECT piece, count(*) AS freq FROM s GROUP BY piece), h AS (SELECT freq, replace(regexp_replace(hex(encode(piece)), '(..)', ' 00\\1', 'g'), ' 0074 0068', ' 0100') AS x FROM w)
SELECT array_to_string(list_transform(regexp_extract_all(x, '[0-9A-F]{{4}}'), lambda t: CAST('0x' || t AS INTEGER)), ' ') AS ids, freq FROM h""")(lambda spark, d: words(spark, d).select(F.array_join(K.apply_merge(F.col("ids"), 116, 104, 256), " ").alias("ids"), "freq"))
query("encode", f"WITH {_IDS} SELECT doc_id, len(ids) AS tokens, {_JOINED} AS ids_md5 FROM i")(lambda spark, d: _encoded(spark, d).select("doc_id", F.size("ids").cast("long").alias("tokens"), _digest("ids").alias("ids_md5")))
query("encode_piece", f"WITH {_IDS.replace(' FROM documents)', ' FROM (SELECT piece AS doc_id, piece AS lang, piece AS text FROM kinds))')} SELECT doc_id AS piece, array_to_string(ids, ' ') AS ids FROM i".replace("WITH ", f"WITH {_PIECES}, kinds AS (SELECT DISTINCT piece FROM s), ", 1))(
    lambda spark, d: K.encode(pieces(spark, d).select("piece").distinct(), _tokenizer(), "piece").select("piece", F.array_join("ids", " ").alias("ids"))
)
query("encode_corpus", f"WITH {_IDS} SELECT lang, CAST(sum(len(ids)) AS BIGINT) AS tokens FROM i GROUP BY lang")(lambda spark, d: _encoded(spark, d).groupBy("lang").agg(F.sum(F.size("ids")).alias("tokens")))
query("sink_token_bin", f"WITH {_FLAT} SELECT CAST(pos // 128 AS BIGINT) AS window_id, md5(string_agg(token, ' ' ORDER BY pos)) AS ids_md5 FROM t WHERE pos < (SELECT (count(*) - 1) // 128 * 128 FROM t) GROUP BY 1")(
    lambda spark, d: _from_file(spark, d, lambda path, n: read_token_windows(spark, path, 128).select("window_id", _digest("input").alias("ids_md5")))
)
# Decoding what was encoded must give the texts back; SQL knows those.
query("decode", "SELECT doc_id, text FROM documents")(lambda spark, d: K.decode(_encoded(spark, d).select("doc_id", "ids"), _tokenizer().vocabulary(spark), ["doc_id"]))
query("chars_per_token", f"WITH {_IDS} SELECT lang, CAST(sum(length(text)) AS DOUBLE) / sum(len(ids)) AS chars_per_token, CAST(sum(strlen(text)) AS DOUBLE) / sum(len(ids)) AS bytes_per_token FROM i GROUP BY lang")(lambda spark, d: K.compression(_encoded(spark, d)))
query("bytes_per_token", f"WITH {_IDS} SELECT lang, CAST(sum(strlen(text)) AS DOUBLE) / sum(len(ids)) AS bytes_per_token FROM i GROUP BY lang")(lambda spark, d: K.compression(_encoded(spark, d)).select("lang", "bytes_per_token"))
query("add_specials", "SELECT * FROM (VALUES (512, 'A'), (513, 'B'), (1, 'known')) AS v(token_id, token)")(
    lambda spark, d: spark.createDataFrame([(1, "known"), (511, "last")], "token_id int, token string").transform(
        lambda v: spark.createDataFrame([(0, "A"), (1, "B"), (2, "known")], "k int, token string").join(v, "token", "left").crossJoin(v.agg(F.max("token_id").alias("m"))).select(F.coalesce("token_id", (F.col("m") + 1 + F.col("k")).cast("int")).alias("token_id"), "token")
    )
)

# Windows over the documents' token stream.
query("n_windows", f"WITH {_IDS} SELECT doc_id, CAST(len(ids) // 64 AS BIGINT) AS n FROM i")(lambda spark, d: _encoded(spark, d).select("doc_id", W.n_windows(F.size("ids"), 64).alias("n")))
query("windows_sequential", f"WITH {_FLAT}, f AS (SELECT pos, token, sum(token) OVER o AS s, lead(token) OVER (ORDER BY pos) AS target FROM t WINDOW o AS (PARTITION BY pos // {LENGTH} ORDER BY pos)) SELECT CAST(pos // {LENGTH} AS BIGINT) AS window_id, CAST(s AS BIGINT) AS input_sum, target AS last_target FROM f WHERE pos % {LENGTH} = {LENGTH - 1} AND target IS NOT NULL")(
    lambda spark, d: _stream(spark, d).windows(LENGTH).select("window_id", F.aggregate("input", F.lit(0).cast("long"), lambda a, x: a + x).alias("input_sum"), F.element_at("target", -1).alias("last_target"))
)
query("bin_scan", f"WITH {_FLAT}, w AS (SELECT pos // 32 AS window_id, pos, token, lead(token) OVER (ORDER BY pos) AS target FROM t) SELECT CAST(window_id AS BIGINT) AS window_id, string_agg(token, ' ' ORDER BY pos) AS input, string_agg(target, ' ' ORDER BY pos) AS target FROM w GROUP BY 1 HAVING count(target) = 32")(
    lambda spark, d: _from_file(spark, d, lambda path, n: read_token_windows(spark, path, 32).select("window_id", F.array_join("input", " ").alias("input"), F.array_join("target", " ").alias("target")))
)
query("shift_target", f"WITH {_IDS}, t AS (SELECT doc_id, unnest(ids) AS token, generate_subscripts(ids, 1) - 1 AS pos FROM i) SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM t")(
    lambda spark, d: W.shifted_rows(_encoded(spark, d).select("doc_id", "ids"))
)
query("windows_random", f"WITH {_FLAT}, n AS (SELECT count(*) - {LENGTH} - 1 AS room FROM t), o AS (SELECT k, CAST('0x' || substring(md5('1729|' || k), 1, 15) AS BIGINT) % room AS place FROM n, (SELECT unnest(range(0, 1000)) AS k)) SELECT k AS window_id, place AS \"offset\", CAST(sum(token) FILTER (pos < place + {LENGTH}) AS BIGINT) AS input_sum, max(token) FILTER (pos = place + {LENGTH}) AS last_target FROM o JOIN t ON pos BETWEEN place AND place + {LENGTH} GROUP BY 1, 2")(
    lambda spark, d: _from_file(spark, d, lambda path, n: windows_at(W.random_offsets(spark, 1000, n, LENGTH, 1729), path, LENGTH).select("window_id", "offset", F.aggregate("input", F.lit(0).cast("long"), lambda a, x: a + x).alias("input_sum"), F.element_at("target", -1).alias("last_target")))
)
query("collate", f"WITH {_IDS}, e AS (SELECT doc_id AS example_id, ids FROM i), w AS (SELECT *, example_id // 8 AS batch_id, max(len(ids)) OVER (PARTITION BY example_id // 8) AS width FROM e) SELECT batch_id, example_id, CAST(list_sum(ids) AS BIGINT) AS ids_sum, CAST(width AS INTEGER) AS width, CAST(width - len(ids) AS INTEGER) AS padded FROM w")(
    lambda spark, d: W.collate(_encoded(spark, d).select(F.col("doc_id").alias("example_id"), "ids").withColumn("labels", F.col("ids")), 8, 0).select("batch_id", "example_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids_sum"), F.size("ids").alias("width"), F.size(F.filter("labels", lambda x: x == -100)).alias("padded"))
)

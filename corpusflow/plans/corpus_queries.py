"""Sources, cleaning and corpus building over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import Sql
from ..operators import corpus as C
from ..operators import leakage as L
from ..operators.sampling import stream_sample
from ..operators.shared import drop_place, new_place
from ..operators.state import ensure_checkpoint_dir
from ..sources import catalogue as S
from ..sources.archives import archive_members, write_archives
from ..sources.files import decode_fallback
from .common import table, values

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


# Cleaning: each step over texts wrapped in what it removes, by one expression for both sides.
_MARKS = "'Licence text' || chr(10) || '*** START OF THE PROJECT GUTENBERG EBOOK T' || doc_id || ' ***' || chr(10) || 'Produced by A and' || chr(10) || 'B' || chr(10) || chr(10) || text || chr(10) || '*** END OF THIS PROJECT GUTENBERG EBOOK ***' || chr(10) || 'tail'"
_BLANKS = "' ' || replace(text, '. ', '.  ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || ' ' || chr(10)"
_STEPS = {
    "clean_nfc": (T.nfc, lambda x: f"nfc_normalize({x})", "text || 'é Å'"),
    "clean_newlines": (T.newlines, Sql.newlines, _BLANKS),
    "clean_trailing_ws": (T.trailing_space, Sql.trailing_space, _BLANKS),
    "clean_blank_runs": (T.blank_runs, Sql.blank_runs, "replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10))"),
    "clean_strip": (T.strip, Sql.strip, _BLANKS),
    "clean_generic": (T.generic, Sql.generic, _BLANKS),
    "clean_bracket_title": (T.bracket_titles, Sql.bracket_titles, "'[T ' || doc_id || ']' || chr(10) || text || chr(10) || 'in [line] kept'"),
    "clean_pg_markers": (T.book_markers, Sql.book_markers, _MARKS),
    "clean_pg_credit": (lambda c: T.credit_paragraphs(T.book_markers(c)), lambda x: Sql.credit_paragraphs(Sql.book_markers(x)), _MARKS),
    "clean_sgml_lines": (T.tag_lines, Sql.tag_lines, "'<SPEAKER ID=' || doc_id || '>' || chr(10) || text || chr(10) || '<P>  ' || chr(10) || 'a < b'"),
    "clean_pos_detok": (T.untag_words, Sql.untag_words, "replace(replace(text, ' ', '/nn '), '.', ' ./.') || ' ``/`` so/rb ''''/'''' ,/, (/( yes/uh )/)'"),
    "clean_credit_footer": (T.credit_footer, Sql.credit_footer, f"text || '{T.HEBREW_FOOTER}' || chr(10) || 'tail'"),
    "clean_footnote_arrow": (T.footnote_arrows, Sql.footnote_arrows, "replace(text, '. ', '.' || chr(160) || '↩︎' || ' ⏎')"),
}
for _name, (_spark, _sql, _wrap) in _STEPS.items():
    query(_name, f"SELECT doc_id, {_sql('(' + _wrap + ')')} AS text FROM documents")(lambda spark, d, f=_spark, w=_wrap: docs(spark, d).select("doc_id", f(F.expr(w)).alias("text")))

_ENTITIES = "replace(text, '. ', '.&nbsp;&amp;&lt;&#233;')"
query("clean_html_unescape", f"SELECT doc_id, replace(replace(replace(replace({_ENTITIES}, '&nbsp;', chr(160)), '&#233;', chr(233)), '&lt;', '<'), '&amp;', '&') AS text FROM documents")(lambda spark, d: docs(spark, d).select("doc_id", T.html_unescape(F.expr(_ENTITIES)).alias("text")))

_DISPATCH = "CASE doc_id % 4 WHEN 0 THEN 'generic' WHEN 1 THEN 'europarl' WHEN 2 THEN 'gutenberg' ELSE 'gutenberg_extended' END"
query("clean_dispatch", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {Sql.generic('w')} WHEN 1 THEN {Sql.generic(Sql.tag_lines('w'))}
  WHEN 2 THEN {Sql.generic(Sql.book_markers(Sql.bracket_titles('w')))} ELSE {Sql.generic(Sql.credit_paragraphs(Sql.book_markers('w')))} END AS text FROM (SELECT doc_id, {_MARKS} AS w FROM documents)""")(
    lambda spark, d: T.clean_by(docs(spark, d).select("doc_id", F.expr(_MARKS).alias("text"), F.expr(_DISPATCH).alias("cleaner")), "cleaner", "text").select("doc_id", "text")
)
_LEAKS = {"licence_lines": "(?i)licen[sc]ed? under", "entities": "&[a-z]+;", "markers": r"\*\*\*"}
query("leak_scan", "SELECT source, " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, {Sql.quoted(p)}))) AS BIGINT) AS {n}" for n, p in _LEAKS.items()) + " FROM documents GROUP BY source")(
    lambda spark, d: docs(spark, d).groupBy("source").agg(*(F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in _LEAKS.items()))
)
_DISPATCHED = SQL["clean_dispatch"]
_LITERALS = " || chr(0) || ".join("'" + w.replace("'", "''") + "'" for w in L.boilerplate())


def literal_scan(spark, d):
    """Every phrase and entity of the list, by source, before cleaning and after it."""
    marked = docs(spark, d).select("source", F.expr(_MARKS).alias("raw"), F.expr(_MARKS).alias("cleaned"), F.expr(_DISPATCH).alias("cleaner"))
    return L.literal_counts(T.clean_by(marked, "cleaner", "cleaned"), L.boilerplate(), ["raw", "cleaned"], ["source"])


_HITS = "CAST(sum((length({t}) - length(replace({t}, literal, ''))) // length(literal)) AS BIGINT) AS n_{t}"
query("leak_scan_literals", f"""WITH k AS ({_DISPATCHED}), b AS (SELECT source, raw, k.text AS cleaned FROM (SELECT doc_id, source, {_MARKS} AS raw FROM documents) JOIN k USING (doc_id)),
w AS (SELECT unnest(string_split({_LITERALS}, chr(0))) AS literal)
SELECT source, literal, {_HITS.format(t='raw')}, {_HITS.format(t='cleaned')} FROM b JOIN w ON contains(raw, literal) OR contains(cleaned, literal) GROUP BY source, literal""")(literal_scan)

# Building the corpus.
_CLEAN = f"c AS (SELECT doc_id, source, {Sql.generic('text')} AS text FROM documents)"


def cleaned(spark, d):
    return docs(spark, d).select("doc_id", "source", T.generic(F.col("text")).alias("text"))


query("filter_min_len", f"WITH {_CLEAN} SELECT source, count(*) FILTER (length(text) >= 200) AS kept, count(*) FILTER (length(text) < 200) AS skipped FROM c GROUP BY source")(
    lambda spark, d: cleaned(spark, d).groupBy("source").agg(F.count_if(C.long_enough(F.col("text"))).alias("kept"), F.count_if(~C.long_enough(F.col("text"))).alias("skipped"))
)


def chunk_sql(most: int, separator: str, least: int = 200) -> str:
    """CTEs c, k: cleaned texts and their chunks."""
    gap, sep = len(separator), " || ".join(f"chr({ord(c)})" for c in separator)
    return f"""RECURSIVE {_CLEAN}, l AS (SELECT * FROM c WHERE length(text) >= {least}),
p AS (SELECT doc_id, unnest(string_split(text, {sep})) AS part, generate_subscripts(string_split(text, {sep}), 1) AS i FROM l WHERE length(text) > {most}),
f AS (SELECT doc_id, i, part, 0 AS grp, length(part) + {gap} AS size FROM p WHERE i = 1 UNION ALL
  SELECT p.doc_id, p.i, p.part, CASE WHEN f.size + length(p.part) > {most} THEN f.grp + 1 ELSE f.grp END, CASE WHEN f.size + length(p.part) > {most} THEN length(p.part) + {gap} ELSE f.size + length(p.part) + {gap} END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1),
g AS (SELECT doc_id, grp, string_agg(part, {sep} ORDER BY i) AS text FROM f GROUP BY doc_id, grp),
k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS chunk_idx, text FROM g WHERE length(text) >= {least} UNION ALL SELECT doc_id, CAST(0 AS INTEGER), text FROM l WHERE length(text) <= {most})"""


def chunked(spark, d, most: int = 2000, separator: str = "\n"):
    return C.chunks(cleaned(spark, d), shortest=C.MIN_CHARS, most=most, separator=separator)


_CHUNKS = chunk_sql(2000, "\n")
query("chunk_paragraphs", f"WITH {_CHUNKS} SELECT doc_id, chunk_idx, text FROM k")(lambda spark, d: chunked(spark, d).select("doc_id", "chunk_idx", "text"))
query("chunk_paragraphs_default", f"WITH {chunk_sql(16384, chr(10) * 2)} SELECT doc_id, chunk_idx, length(text) AS n_chars, md5(text) AS digest FROM k")(lambda spark, d: chunked(spark, d, C.MAX_CHARS, "\n\n").select("doc_id", "chunk_idx", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest")))
query("agg_source_chars", f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, CAST(sum(length(k.text)) AS BIGINT) AS characters FROM k JOIN c USING (doc_id) GROUP BY source")(
    lambda spark, d: chunked(spark, d).groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))
)
_SEEDED = "md5('1729' || '|' || doc_id || '|' || chunk_idx)"
_SPLIT = f"""{_CHUNKS}, s AS (SELECT k.doc_id, source, chunk_idx, k.text, {_SEEDED} AS h FROM k JOIN c USING (doc_id)),
w AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY h, doc_id, chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY source) AS whole FROM s),
t AS (SELECT *, CASE WHEN before * 1000 < whole * 5 THEN 'val' ELSE 'train' END AS split FROM w)"""


def split(spark, d):
    """doc_id, chunk_idx, source, size, split: without texts, as most queries need their sizes only."""
    sizes = chunked(spark, d).select("doc_id", "chunk_idx", "source", F.length("text").alias("size"))
    return C.held_out_split(sizes, ["doc_id", "chunk_idx"], size=F.col("size"))


query("shuffle_seeded", f"WITH {_CHUNKS}, s AS (SELECT doc_id, chunk_idx, {_SEEDED} AS h FROM k) SELECT doc_id, chunk_idx, row_number() OVER (PARTITION BY doc_id ORDER BY h, chunk_idx) AS place FROM s")(
    lambda spark, d: chunked(spark, d).withColumn("h", C.seeded(C.SEED, "doc_id", "chunk_idx")).selectExpr("doc_id", "chunk_idx", "cast(row_number() over (partition by doc_id order by h, chunk_idx) as bigint) as place")
)
query("split_heldout", f"WITH {_SPLIT} SELECT doc_id, chunk_idx, source, split FROM t")(lambda spark, d: split(spark, d).select("doc_id", "chunk_idx", "source", "split"))
def united(rows):
    return rows.where("split = 'train'").unionByName(rows.where("split = 'val'"))


query("union_sources", f"WITH {_SPLIT} SELECT split, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM t GROUP BY split")(
    lambda spark, d: united(split(spark, d)).groupBy("split").agg(F.count("*").alias("chunks"), F.sum("size").alias("characters"))
)
query("global_order", f"WITH {_SPLIT} SELECT split, doc_id, chunk_idx, row_number() OVER (PARTITION BY split ORDER BY h, doc_id, chunk_idx) AS place FROM t")(
    lambda spark, d: C.seeded_place(split(spark, d), ["doc_id", "chunk_idx"], by=("split",)).select("split", "doc_id", "chunk_idx", "place")
)
_MANIFEST = f"""{_SPLIT}, m AS (SELECT source, count(*) AS chunks, count(*) FILTER (split = 'train') AS chunks_train, count(*) FILTER (split = 'val') AS chunks_val, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(coalesce(sum(length(text)) FILTER (split = 'val'), 0) AS BIGINT) AS characters_val FROM t GROUP BY ROLLUP (source)),
x AS (SELECT source, count(*) AS n FROM c WHERE length(text) < 200 GROUP BY ROLLUP (source))"""


def corpus_manifest(spark, d):
    return C.manifest(split(spark, d), cleaned(spark, d).where(~C.long_enough(F.col("text"))), size=F.col("size"))


query("manifest", f"WITH {_MANIFEST} SELECT m.*, coalesce(x.n, 0) AS skipped_too_short FROM m LEFT JOIN x ON m.source IS NOT DISTINCT FROM x.source")(corpus_manifest)
_FULL = f"""{_CHUNKS}, flat AS (SELECT string_agg(k.text, chr(10) || chr(10) || '<|endoftext|>' || chr(10) || chr(10) ORDER BY k.doc_id, chunk_idx) AS t FROM k),
spots AS (SELECT t, length(t) AS total, unnest(range(0, 40)) AS w FROM flat), places AS (SELECT w, t, total, total * w // 40 AS place FROM spots), begins AS (SELECT w, t, CASE WHEN strpos(substring(t, place + 1), chr(10)) > 0 THEN place + strpos(substring(t, place + 1), chr(10)) ELSE total END AS begin FROM places)"""
query("tok_sample", f"WITH {_FULL} SELECT CAST(w AS INTEGER) AS window, CAST(length(substring(t, begin + 1, 3000)) AS BIGINT) AS characters, md5(substring(t, begin + 1, 3000)) AS text_md5 FROM begins WHERE substring(t, begin + 1, 3000) <> ''")(
    lambda spark, d: stream_sample(chunked(spark, d), ["doc_id", "chunk_idx"], 120_000).groupBy("window").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p")).select("window", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("t")).select("window", F.length("t").cast("long").alias("characters"), F.md5(F.col("t").cast("binary")).alias("text_md5"))
)


def zip_scan(spark, d):
    """The documents as members of archives in the shared folder, read back by many tasks to an archive."""
    ensure_checkpoint_dir(spark)
    folder = new_place(spark, "archives")
    members = docs(spark, d).select(F.format_string("%s/%d.txt", "source", "doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    write_archives(members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name"), folder)
    try:
        return archive_members(spark, f"{folder}/*.zip", ["*/*.txt"], task_bytes=1 << 20).select("name", F.length(decode_fallback(F.col("content"))).cast("long").alias("characters"), F.md5("content").alias("content_md5")).checkpoint()
    finally:
        drop_place(spark, folder)


query("src_zip_scan", "SELECT source || '/' || doc_id || '.txt' AS name, length(text) AS characters, md5(text) AS content_md5 FROM documents")(zip_scan)


def split_digests(spark, d):
    ordered = C.held_out_split(chunked(spark, d), ["doc_id", "chunk_idx"]).withColumn("h", C.seeded(C.SEED, "doc_id", "chunk_idx"))
    made = C.digest_splits(ordered, ["h", "doc_id", "chunk_idx"])
    return spark.createDataFrame([(name, m["characters"], m["sha256"]) for name, m in made.items()], "split string, characters long, sha256 string")


_SEP = " || ".join(f"chr({ord(c)})" if ord(c) < 32 else f"'{c}'" for c in C.SEPARATOR)
query("sink_split_text", f"WITH {_SPLIT}, b AS (SELECT split, string_agg(text, {_SEP} ORDER BY h, doc_id, chunk_idx) AS b FROM t GROUP BY split) SELECT split, length(b) AS characters, sha256(b) AS sha256 FROM b")(
    lambda spark, d: split_digests(spark, d)
)
query("sink_manifest", f"WITH {_MANIFEST} SELECT '{{\"chunks\":' || chunks || ',\"train\":' || chunks_train || ',\"val\":' || chunks_val || ',\"characters\":' || characters || '}}' AS manifest FROM m WHERE source IS NULL")(
    lambda spark, d: corpus_manifest(spark, d).where("source IS NULL").select(F.to_json(F.struct("chunks", F.col("chunks_train").alias("train"), F.col("chunks_val").alias("val"), "characters")).alias("manifest"))
)

# Sources.
query("src_catalogue", "SELECT * FROM " + values([(s[0], s[1], len(s[2]), s[4], s[7], s[8]) for s in S.SOURCES], "name", "url", "n_patterns", "licence", "cleaner", "kind"))(
    lambda spark, d: S.sources(spark).select("name", "url", F.size("patterns").alias("n_patterns"), "licence", "cleaner", "kind")
)
query("dq_provenance", "SELECT name, fault FROM (SELECT 'x' AS name, 'y' AS fault) WHERE FALSE")(lambda spark, d: S.provenance_faults(S.sources(spark)))
_PATHS = "'cache/pg' || doc_id || '.txt'"
query("src_id_scan", f"SELECT d.doc_id AS book_id, {_PATHS} AS path FROM documents d SEMI JOIN labels USING (doc_id)")(
    lambda spark, d: S.by_listed_id(docs(spark, d).select(F.expr(_PATHS).alias("path")), table(spark, d, "labels").select(F.col("doc_id").alias("book_id")))
)
query("src_bulk_anti_scan", f"SELECT d.doc_id AS book_id, {_PATHS} AS path FROM documents d ANTI JOIN labels USING (doc_id)")(
    lambda spark, d: S.without_listed_ids(docs(spark, d).select(F.expr(_PATHS).alias("path")), table(spark, d, "labels").select(F.col("doc_id").alias("book_id")))
)
_CATALOGUE = ["source || '/p' || doc_id % 50 || '/m' || doc_id AS path", "CASE WHEN lang = 'en' THEN '  ' ELSE lang END AS original_language", "CASE WHEN doc_id % 7 = 0 THEN 'letters' WHEN doc_id % 11 = 0 THEN 'reference works' ELSE 'prose' END AS genre"]
_AUTHORS = [f"p{k}" for k in range(0, 50, 3)]
query("src_catalogue_semi", f"SELECT doc_id, path FROM (SELECT doc_id, {', '.join(_CATALOGUE)} FROM documents) WHERE split_part(path, '/', 2) IN ({', '.join(repr(a) for a in _AUTHORS)}) AND trim(original_language) = '' AND genre = 'prose'")(
    lambda spark, d: S.catalogue_members(docs(spark, d).selectExpr("doc_id", _CATALOGUE[0]), docs(spark, d).selectExpr(*_CATALOGUE), F.split("path", "/")[1], F.col("original_language"), F.col("genre"), _AUTHORS, "path")
)
_BOOKS = [
    "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id AS STRING) END AS `Text#`",
    "CASE WHEN doc_id % 9 = 0 THEN 'Sound' ELSE 'Text' END AS Type",
    "lang AS Language",
    "CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'Index of the Project Gutenberg works' ELSE ' ' || text END AS Title",
    "CASE WHEN doc_id % 5 = 0 THEN 'Bibliography' WHEN doc_id % 6 = 0 THEN NULL ELSE 'Novels' END AS Subjects",
]
_BOOKS_SQL = "b AS (SELECT " + ", ".join(_BOOKS).replace("`Text#`", "number").replace("STRING", "VARCHAR") + " FROM documents)"
_WANTED = "Type = 'Text' AND Language IN ('en', 'he') AND Title <> '' AND lower(Title) NOT LIKE '%index of the project gutenberg%' AND lower(coalesce(Subjects, '')) NOT LIKE '%bibliography%'"
query("cat_select", f"WITH {_BOOKS_SQL} SELECT number, Title AS title FROM b WHERE {_WANTED}")(lambda spark, d: S.wanted_books(docs(spark, d).selectExpr(*_BOOKS)).select(F.col("Text#").alias("number"), F.col("Title").alias("title")))
query("cat_project", f"WITH {_BOOKS_SQL} SELECT CAST(number AS INTEGER) AS id, substring({Sql.strip('Title')}, 1, 120) AS title, Language AS language FROM b WHERE number IS NOT NULL")(lambda spark, d: S.book_rows(docs(spark, d).selectExpr(*_BOOKS)))
query("cat_lang_count", f"WITH {_BOOKS_SQL} SELECT Language AS language, count(*) AS n FROM b WHERE {_WANTED} GROUP BY Language")(lambda spark, d: S.wanted_books(docs(spark, d).selectExpr(*_BOOKS)).groupBy(F.col("Language").alias("language")).agg(F.count("*").alias("n")))
query("bulk_sample", """WITH s AS (SELECT doc_id, CASE WHEN strlen(text) >= 1000 THEN strlen(text) ELSE 0 END AS size, md5('1729' || '|' || doc_id) AS h FROM documents),
r AS (SELECT doc_id, size, (row_number() OVER (ORDER BY h, doc_id) - 1) // 20 AS blk FROM s), b AS (SELECT blk, sum(size) AS n FROM r GROUP BY blk),
u AS (SELECT blk, coalesce(sum(n) OVER (ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id FROM r JOIN u USING (blk) WHERE before < 500000 AND size > 0""")(lambda spark, d: C.block_sample(docs(spark, d).select("doc_id", F.octet_length("text").alias("bytes")), F.col("bytes"), ["doc_id"], 500_000, 20, 1000).select("doc_id"))

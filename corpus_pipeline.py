"""The corpus pipeline: language, quality, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.  Every stage works on all rows
that its predecessor kept, and handles null texts, ids and languages as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import held_out, sized, stored, text_key
from corpusflow.llm.langid import UNKNOWN, fit_language_model, predict_language
from corpusflow.llm.ngram_join import jaccard_components
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.quality import keep_good
from corpusflow.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Languages known with less confidence than this are rejected.
SURE = 0.5
#: Bytes from which a repeated passage is cut, so that passages of over 50 words are: of 51 words in a row in
#: 2,000 texts of check_s 99 in 100 have 246 bytes or more, and half of them 317 or less.
PASSAGE = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and texts whose language is not clear, go."""
    model = fit_language_model(docs, ~held_out(F.col("doc_id"), 4))
    named = predict_language(docs.select(*COLUMNS), model, keep=tuple(COLUMNS))
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the base rules or the cascade reject go."""
    return keep_good(docs.select(*COLUMNS), tuple(COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one with the smallest id stays.

    A document is its id and text, so rows that share an id but not their text are documents of their own;
    of those with one id the smallest text name comes first, and a null id comes before all others.  Rows
    that repeat both count as one document, the one with the least lang, source and n_chars."""
    key = ["doc_id", "tkey"]
    rows = docs.select(*COLUMNS).withColumn("tkey", text_key(F.col("text")))
    members = jaccard_components(rows.withColumn("_key", F.struct(*key)), doc_id="_key")
    members = members.groupBy("doc_id").agg(F.count("*").alias("copies"), F.min("component_id").alias("first"))
    gone = stored(members.where(F.col("doc_id") != F.col("first")).select("doc_id.*"), "near-copies")
    again = stored(members.where((F.col("doc_id") == F.col("first")) & (F.col("copies") > 1)).select("doc_id.*"), "repeated-documents")

    def same(other: DataFrame):
        return rows["doc_id"].eqNullSafe(other["doc_id"]) & rows["tkey"].eqNullSafe(other["tkey"])

    if again.isEmpty():
        return rows.join(sized(gone), same(gone), "left_anti").select(*COLUMNS)
    every = gone.unionAll(again)
    once = rows.join(sized(again), same(again), "left_semi").groupBy(*key).agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row")).select("doc_id", "row.*")
    return rows.join(sized(every), same(every), "left_anti").select(*COLUMNS).unionAll(once.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE bytes or more that occur more than once are cut out of the texts."""
    cut = remove_repeats(docs.select(*COLUMNS), keep=tuple(COLUMNS), with_text=True, length=PASSAGE)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of 4096 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]

#: Language models, suffix ranks and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

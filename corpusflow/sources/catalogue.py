"""The source catalogue, and scans that choose members of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, url string, patterns array<string>, skip_names array<string>, licence string, origin string, description string, cleaner string, kind string"
_ZIPS = "https://raw.githubusercontent.com/nltk/nltk_data/gh-pages/packages/corpora"
_BOOKS = "https://gutenberg.pglaf.org/cache/epub/{id}/pg{id}.txt"

# Names, places and kinds of the corpus's sources.
SOURCES = [
    ("gutenberg", f"{_ZIPS}/gutenberg.zip", ["gutenberg/*.txt"], [], "Public domain", "Project Gutenberg, 18 books in the NLTK data", "Whole novels, plays and verse in edited English, as one zip archive.", "gutenberg", "archive"),
    ("gutenberg_extended", _BOOKS, [], [], "Public domain", "Project Gutenberg, books chosen by id", "Single books fetched by id, with licence header and footer to be cut.", "gutenberg_extended", "gutenberg_ids"),
    ("gutenberg_bulk", _BOOKS, [], [], "Public domain", "Project Gutenberg, books chosen from its catalogue", "Books that a catalogue filter selects, without those chosen by id.", "gutenberg_extended", "gutenberg_bulk"),
    ("brown", f"{_ZIPS}/brown.zip", ["brown/????"], [], "Redistribution permitted", "The Brown Corpus in the NLTK data", "Part-of-speech-tagged American English of 1961 in short samples.", "brown", "archive"),
    ("webtext", f"{_ZIPS}/webtext.zip", ["webtext/*.txt"], [], "Freely redistributable", "Web text in the NLTK data", "Forum posts, reviews and a film script: informal modern English.", "generic", "archive"),
    ("inaugural", f"{_ZIPS}/inaugural.zip", ["inaugural/*.txt"], [], "Public domain", "US presidential inaugural addresses", "Formal speeches from 1789 on, one file for each address.", "generic", "archive"),
    ("state_union", f"{_ZIPS}/state_union.zip", ["state_union/*.txt"], [], "Public domain", "US State of the Union addresses", "Formal speeches from 1945 on, one file for each address.", "generic", "archive"),
    ("europarl_en", f"{_ZIPS}/europarl_raw.zip", ["europarl_raw/english/*"], [], "Freely available", "European Parliament proceedings in English", "Transcribed debates with SGML tags on lines of their own.", "europarl", "archive"),
    ("benyehuda", "https://github.com/projectbenyehuda/public_domain_dump/releases/download/2026-03/txt.zip", [], [], "Public domain", "Project Ben-Yehuda, release 2026-03", "Hebrew prose and verse of chosen authors, by its catalogue.", "benyehuda", "benyehuda"),
]


def sources(spark: SparkSession) -> DataFrame:
    """One row for each source."""
    return spark.createDataFrame(SOURCES, SCHEMA)


def provenance_faults(df: DataFrame) -> DataFrame:
    """Sources without licence or origin, without an https address, with a short description, or
    with a name that another has; ``fault`` says which."""
    from pyspark.sql import Window

    twice = F.count("*").over(Window.partitionBy("name")) > 1
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.when(blank("licence"), "licence").when(blank("origin"), "origin").when(~F.coalesce(F.col("url").startswith("https://"), F.lit(False)), "url").when(~F.coalesce(F.length("description") > 40, F.lit(False)), "description").when(twice, "name")
    return df.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("name", "fault")


def wanted_books(df: DataFrame) -> DataFrame:
    """Catalogue rows of kind Text in English or Hebrew whose title and subjects hold no marker."""
    # Markers of periodicals and indexes.
    title_markers = ["index of the project gutenberg", "complete project gutenberg", "project gutenberg's"]
    subject_markers = ["periodicals", "indexes", "bibliography", "catalogs", "encyclopedias"]
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    free = lambda text, markers: ~F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))
    return df.where((F.col("Type") == "Text") & F.col("Language").isin("en", "he") & (lower("Title") != "") & free(lower("Title"), title_markers) & free(lower("Subjects"), subject_markers))


def book_rows(df: DataFrame) -> DataFrame:
    """Integer id (rows without one go), and the title, stripped, at most 120 characters."""
    from ..functions.text import strip

    number = F.col("Text#").try_cast("int")
    return df.where(number.isNotNull()).select(number.alias("id"), F.substring(strip(F.col("Title")), 1, 120).alias("title"), F.col("Language").alias("language"))


def by_listed_id(files: DataFrame, ids: DataFrame, path: str = "path") -> DataFrame:
    """Files named pg<id>.txt whose id is listed, in the order of ids."""
    named = files.withColumn("book_id", F.regexp_extract(path, r"pg(\d+)\.txt$", 1).try_cast("long"))
    return named.join(ids, "book_id", "left_semi").orderBy("book_id")


def without_listed_ids(files: DataFrame, ids: DataFrame, path: str = "path") -> DataFrame:
    """Files whose id isn't listed, by name. No such file is an error, not an empty source."""
    named = files.withColumn("book_id", F.regexp_extract(path, r"pg(\d+)\.txt$", 1).try_cast("long"))
    left = named.join(ids, "book_id", "left_anti")
    if left.isEmpty():
        raise ValueError("the source holds no file besides the listed ids")
    return left.orderBy(path)


def catalogue_members(members: DataFrame, catalogue: DataFrame, author: Column, language: Column, genre: Column, authors: list[str], key: str) -> DataFrame:
    """Members whose catalogue row is by a chosen author, not translated, and of no excluded genre."""
    original = F.coalesce(F.trim(language), F.lit("")) == ""
    kind = F.coalesce(genre, F.lit(""))
    prose = ~F.contains(kind, F.lit("letters")) & ~F.contains(kind, F.lit("reference"))
    return members.join(catalogue.where(author.isin(authors) & original & prose).select(key), key, "left_semi")


def locked_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a JSON lock file {"ids": [...]}, which override a catalogue."""
    return spark.read.schema("ids array<long>").option("multiLine", True).json(path).select(F.explode("ids").alias("book_id"))

"""Command line: run a named query, list them, train a tokenizer, build a corpus.

    python -m corpusflow.cli list
    python -m corpusflow.cli query manifest TABLES OUT
    python -m corpusflow.cli build TABLES OUT
    python -m corpusflow.cli tokenizer TABLES OUT.json --size 8192
"""

from __future__ import annotations

import argparse
import json


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("corpusflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def build(spark, tables: str, out: str) -> dict:
    """Clean, filter, chunk and split ``documents`` (by their column ``cleaner``, if there is one).

    ``chunks`` holds Parquet by split, ``text/train`` and ``text/val`` the split texts in seeded order with
    the separator behind each chunk, ``manifest`` one JSON object: counts by source and in all, and how the
    split was made."""
    from pyspark.sql import functions as F

    from .functions.text import clean_by
    from .operators import corpus as C
    from .sources.files import replace_report

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    if "cleaner" not in docs.columns:
        docs = docs.withColumn("cleaner", F.lit("generic"))
    cleaned = clean_by(docs.select("doc_id", "source", "text", "cleaner"), "cleaner", "text").drop("cleaner")
    keys = ["doc_id", "chunk_idx"]
    parts = C.held_out_split(C.chunks(cleaned, shortest=C.MIN_CHARS), keys, per_mille=round(1000 * C.HELD_OUT))
    parts.write.mode("overwrite").partitionBy("split").parquet(f"{out}/chunks")
    spark.catalog.clearCache()
    made = spark.read.parquet(f"{out}/chunks")
    for split in ("train", "val"):
        ordered = made.where(F.col("split") == split).orderBy(C.seeded(C.SEED, *keys), *keys).select("text")
        ordered.write.mode("overwrite").option("lineSep", C.SEPARATOR).text(f"{out}/text/{split}")
    counts = C.manifest(made, cleaned.where(~C.long_enough(F.col("text"))))
    fields = [c for c in counts.columns if c != "source"]
    every = [F.max(F.when(F.col("source").isNull(), F.col(c))).alias(c) for c in fields]
    settings = F.struct(F.lit(C.HELD_OUT).alias("val_fraction"), F.lit(C.SEED).alias("seed"), F.lit("characters").alias("unit"))
    report = counts.agg(F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", *fields)))).alias("sources"), *every, F.first(settings).alias("split"))
    replace_report(report, f"{out}/manifest")
    row = spark.read.schema(report.schema).json(f"{out}/manifest").first()
    return {r["source"]: r["chunks"] for r in row.sources} | {"*": row.chunks}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    query = commands.add_parser("query")
    query.add_argument("name")
    for command in (query, commands.add_parser("build"), tokenizer := commands.add_parser("tokenizer")):
        command.add_argument("tables")
        command.add_argument("out")
    tokenizer.add_argument("--size", type=int, default=8192)
    given = parser.parse_args(argv)

    from .plans.registry import QUERIES

    if given.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = _session()
    if given.command == "query":
        QUERIES[given.name](spark, given.tables).write.mode("overwrite").parquet(given.out)
    elif given.command == "build":
        print(json.dumps(build(spark, given.tables, given.out)))
    else:
        from .operators.tokenizer import train_bpe

        train_bpe(spark.read.parquet(f"{given.tables}/documents.parquet"), given.size).save(given.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

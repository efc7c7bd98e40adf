"""What query modules share: tables, and inline rows that Spark and SQL both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    """A value as SQL text that both dialects read."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value)
    parts, plain = [], ""
    for c in text:
        if ord(c) < 32 or c == "\\":
            if plain:
                parts.append(plain)
            parts.append(ord(c))
            plain = ""
        else:
            plain += c
    if plain or not parts:
        parts.append(plain)
    return "(" + " || ".join(f"chr({p})" if isinstance(p, int) else "'" + p.replace("'", "''") + "'" for p in parts) + ")"


def values(rows: list[tuple], *columns: str) -> str:
    """An inline table for SQL."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(columns)})"

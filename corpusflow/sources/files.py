"""Files: archives, text with broken encodings, logs, token files, settings, search pages, sinks."""

from __future__ import annotations

import json
import os
import time
import tomllib
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch(urls: list[str], attempts: int = 3, pause: float = 0.5, read: Callable[[str], bytes] | None = None) -> bytes:
    """The first answer of mirrors in order, each tried ``attempts`` times with doubling pauses."""
    read = read or (lambda url: urllib.request.urlopen(url, timeout=120).read())
    failed: Exception | None = None
    for url in urls:
        for k in range(attempts):
            try:
                return read(url)
            except OSError as error:
                failed = error
                time.sleep(pause * 2**k)
    raise OSError(f"no mirror of {len(urls)} answered") from failed


def stage(url: str, path: str, read: Callable[[str], bytes] | None = None) -> str:
    """Fetch to ``path`` unless a file with content is there."""
    if not (os.path.exists(path) and os.path.getsize(path) > 0):
        body = fetch([url], read=read)
        with open(f"{path}.part", "wb") as out:
            out.write(body)
        os.replace(f"{path}.part", path)
    return path


def decode_fallback(content: Column) -> Column:
    """Strict UTF-8, else Latin-1, which never fails."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def decode_replace(content: Column) -> Column:
    """UTF-8; broken parts become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to a log of JSON lines; each append adds part files and leaves the others as they are."""
    entries.write.mode("append").json(path)


def replace_report(report: DataFrame, path: str) -> None:
    """Write a small report as JSON lines in one file; Spark commits it whole or not at all."""
    report.coalesce(1).write.mode("overwrite").json(path)


def parse_log(lines: DataFrame, schema: str, column: str = "value", required: str = "step") -> DataFrame:
    """The same for lines that are read already, of a stream as well."""
    return lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where(F.col(required).isNotNull())


def load_settings(defaults: dict, toml_path: str | None = None, environment: dict | None = None, prefix: str = "CORPUSFLOW_") -> dict:
    """Defaults, then a TOML file (flat or under [corpusflow]), then environment variables; values take
    the default's type and unknown keys are ignored."""
    out = dict(defaults)

    def cast(key: str, value):
        kind = type(defaults[key])
        if kind is bool and isinstance(value, str):
            return value.strip().lower() in ("1", "true", "yes", "on")
        return kind(value) if defaults[key] is not None else value

    if toml_path and os.path.exists(toml_path):
        with open(toml_path, "rb") as f:
            data = tomllib.load(f)
        for key, value in data.get("corpusflow", data).items():
            if key in defaults:
                out[key] = cast(key, value)
    for key in defaults:
        if (value := (environment if environment is not None else os.environ).get(prefix + key.upper())) is not None:
            out[key] = cast(key, value)
    return out


# Fixed value: a result's link, title and snippet in the search page's markup.
SEARCH_RESULT = r'(?s)result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>.*?result__snippet"[^>]*>(.*?)</a>'


def search_results(html: Column, most: int = 5, pattern: str = SEARCH_RESULT) -> Column:
    """Array of struct (title, url, snippet): tags off, entities decoded where they are plain, redirects
    unwrapped, untitled results left out, 1 to 10 of them."""
    from ..functions.text import strip

    def clean(c: Column) -> Column:
        text = F.regexp_replace(c, "<[^>]+>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(sign))
        return strip(text)

    def target(c: Column) -> Column:
        inner = F.regexp_extract(c, r"[?&]uddg=([^&]*)", 1)
        return F.when(inner != "", F.coalesce(F.try_url_decode(inner), inner)).otherwise(c)

    groups = [F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    zipped = F.arrays_zip(groups[0].alias("href"), groups[1].alias("title"), groups[2].alias("snippet"))
    cleaned = F.transform(zipped, lambda r: F.struct(clean(r["title"]).alias("title"), target(r["href"]).alias("url"), clean(r["snippet"]).alias("snippet")))
    return F.slice(F.filter(cleaned, lambda r: r["title"] != ""), 1, max(1, min(int(most), 10)))


def chat_frames(lines: DataFrame) -> DataFrame:
    """Frames of a newline-delimited chat stream (seq, value) as events: seq, kind, text, and on the
    last frame the tokens and seconds used. An error frame raises where it is read."""
    schema = "error string, done boolean, message struct<content:string,thinking:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>, prompt_eval_count long, eval_count long, total_duration long"
    r = lines.select("seq", F.from_json("value", schema).alias("r")).where(F.col("r").isNotNull())
    checked = r.withColumn("ok", F.when(F.col("r.error").isNotNull(), F.raise_error(F.col("r.error"))).otherwise(F.lit(True)))
    calls = F.transform(F.coalesce("r.message.tool_calls", F.array().cast("array<struct<function:struct<name:string,arguments:string>>>")), lambda c: F.struct(F.lit("tool_call").alias("kind"), F.concat(c["function"]["name"], F.lit(" "), F.coalesce(c["function"]["arguments"], F.lit("{}"))).alias("text")))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    events = F.concat(F.array(event("thinking", F.col("r.message.thinking")), event("content", F.col("r.message.content"))), calls, F.array(event("done", F.when(F.col("r.done"), F.lit("")))))
    out = checked.where("ok").select("seq", "r", F.explode(F.filter(events, lambda e: e["text"].isNotNull() & ((e["text"] != "") | (e["kind"] == "done")))).alias("e"))
    last = F.col("e.kind") == "done"
    return out.select("seq", "e.kind", "e.text", F.when(last, F.col("r.eval_count")).alias("tokens"), F.when(last, F.col("r.total_duration") / 1e9).alias("seconds"))


def write_report(report: dict, path: str) -> None:
    """JSON written beside its place and renamed, so readers never see half of it."""
    with open(f"{path}.part", "w", encoding="utf-8") as out:
        json.dump(report, out, ensure_ascii=False, indent=2)
        out.flush()
        os.fsync(out.fileno())
    os.replace(f"{path}.part", path)

"""Conversations as one row for each turn: rendering, supervision, parsing, splits.

Columns: conv_id, turn, role, content, thinking, tool_calls array<struct<id,name,arguments map>>.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

# The chat format's markers, in the order in which they join the vocabulary.
USER, ASSISTANT = "<|user|>", "<|assistant|>"
THINK_OPEN, THINK_CLOSE = "<|think|>", "<|/think|>"
CALL_OPEN, CALL_CLOSE = "<|call|>", "<|/call|>"
RESULT_OPEN, RESULT_CLOSE = "<|result|>", "<|/result|>"
END = "<|end|>"
MARKERS = (USER, ASSISTANT, THINK_OPEN, THINK_CLOSE, CALL_OPEN, CALL_CLOSE, RESULT_OPEN, RESULT_CLOSE, END)

CALLS = "array<struct<id:string,name:string,arguments:string>>"
IGNORE, VALIDATION = -100, 0.12


def _sorted_json(values: pd.Series) -> pd.Series:
    return values.map(lambda t: json.dumps(json.loads(t or "{}"), ensure_ascii=False, sort_keys=True), na_action="ignore")


def sorted_json(text: Column) -> Column:
    """JSON with sorted keys and blanks after signs; nested objects too, which no built-in sorts."""
    return F.pandas_udf(_sorted_json, "string")(text)


def flat_json(arguments: Column) -> Column:
    """The same for a map of strings, in built-in functions."""
    quote = lambda t: F.regexp_replace(F.to_json(F.array(t)), r"\A\[|\]\z", "")
    pairs = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(quote(e["key"]), F.lit(": "), quote(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def tool_call_text(name: Column, arguments: Column) -> Column:
    """A call as the model writes it; ``arguments`` is JSON with sorted keys."""
    return F.concat(F.lit(CALL_OPEN), name, F.lit(" "), arguments, F.lit(CALL_CLOSE))


def with_columns(df: DataFrame) -> DataFrame:
    """Tables without thinking, calls or content names get them."""
    out = df.withColumnRenamed("text", "content") if "content" not in df.columns and "text" in df.columns else df
    for name, kind in (("thinking", "string"), ("tool_calls", CALLS)):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def turn_segments(df: DataFrame) -> DataFrame:
    """Adds ``segments``: the turn's (text, is_target) in order. System turns have none."""
    calls = F.coalesce("tool_calls", F.array().cast(CALLS))
    part = lambda text, target: F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(target).alias("is_target"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    think = F.when(full(F.col("thinking")), F.concat(F.lit(THINK_OPEN), F.col("thinking"), F.lit(THINK_CLOSE)))
    assistant = F.concat(
        F.array(part(F.lit(ASSISTANT), False), part(think, True)),
        F.transform(calls, lambda c: part(tool_call_text(c["name"], c["arguments"]), True)),
        F.array(part(F.col("content"), True), part(F.when(F.size(calls) == 0, END), True)),
    )
    none = F.array().cast("array<struct<text:string,is_target:boolean>>")
    by_role = (
        F.when(F.col("role") == "user", F.array(part(F.concat(F.lit(USER), F.coalesce("content", F.lit(""))), False)))
        .when(F.col("role") == "assistant", assistant)
        .when(F.col("role") == "tool", F.array(part(F.concat(F.lit(RESULT_OPEN), F.coalesce("content", F.lit("")), F.lit(RESULT_CLOSE)), False)))
        .otherwise(none)
    )
    return df.withColumn("segments", F.filter(by_role, lambda s: s["text"] != ""))


def supervised_segments(df: DataFrame) -> DataFrame:
    """conv_id, pos, text, is_target: what a conversation trains on and what is given."""
    turns = turn_segments(df).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "segments"))).alias("t"))
    return turns.select("conv_id", F.posexplode(F.flatten(F.transform("t", lambda x: x["segments"]))).alias("pos", "s")).select("conv_id", "pos", "s.text", "s.is_target")


def render(df: DataFrame, generation_prompt: bool = True, thinking: bool = False) -> DataFrame:
    """conv_id and the conversation in the training format."""
    body = turn_segments(df).withColumn("piece", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    turns = body.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("t"))
    tail = (ASSISTANT + (THINK_OPEN if thinking else "")) if generation_prompt else ""
    return turns.select("conv_id", F.concat(F.array_join(F.transform("t", lambda x: x["piece"]), ""), F.lit(tail)).alias("text"))


def strip_markers(text: Column) -> Column:
    for marker in MARKERS:
        text = F.replace(text, F.lit(marker), F.lit(""))
    return strip(text)


def parse_call(payload: Column) -> Column:
    """Struct (name, arguments) of "name {json}"; null without a name, {} for what isn't an object."""
    bare = strip(payload)
    cut = F.locate(" ", bare)
    name = F.when(cut > 0, F.substring(bare, F.lit(1), cut - 1)).otherwise(bare)
    rest = F.when(cut > 0, strip(F.substring(bare, cut + 1, F.length(bare)))).otherwise("")
    good = rest.startswith("{") & F.try_parse_json(rest).isNotNull()
    return F.when(name != "", F.struct(name.alias("name"), F.when(good, rest).otherwise("{}").alias("arguments")))


def parse_response(text: Column, thinking_started: bool = False) -> Column:
    """Struct (content, thinking, tool_calls) of a generated turn; broken markup never fails."""
    q = re.escape
    think = rf"(?s)(?:{q(THINK_OPEN)})?(.*?){q(THINK_CLOSE)}"
    closed = F.contains(text, F.lit(THINK_CLOSE))
    nothing = F.lit(None).cast("string")
    thought = F.nullif(strip_markers(F.regexp_extract(text, think, 1)), F.lit(""))
    span = F.length(F.regexp_extract(text, rf"(?s){think[4:]}", 0))
    begin = F.locate(THINK_CLOSE, text) + len(THINK_CLOSE) - span
    left = F.when(closed, F.concat(F.substring(text, F.lit(1), begin - 1), F.substring(text, begin + span, F.length(text)))).otherwise(text)
    call, result = rf"(?s){q(CALL_OPEN)}(.*?){q(CALL_CLOSE)}", rf"(?s){q(RESULT_OPEN)}.*?{q(RESULT_CLOSE)}"
    calls = F.filter(F.transform(F.regexp_extract_all(left, F.lit(call), F.lit(1)), parse_call), lambda c: c.isNotNull())
    bare = strip_markers(F.regexp_replace(F.regexp_replace(left, call, ""), result, ""))
    content = strip(F.regexp_replace(bare, rf"[^.!?\n]*[{{}}\"]+[{SPACE}]*\z", ""))
    unclosed = ~closed & F.lit(thinking_started)
    return F.struct(
        F.when(unclosed, F.lit("")).otherwise(content).alias("content"),
        F.when(closed, thought).when(unclosed, F.nullif(strip_markers(text), F.lit(""))).otherwise(nothing).alias("thinking"),
        F.when(unclosed, F.array().cast("array<struct<name:string,arguments:string>>")).otherwise(calls).alias("tool_calls"),
    )


def drop_thinking(df: DataFrame) -> DataFrame:
    return df.withColumn("thinking", F.when(F.col("role") != "assistant", F.col("thinking")))


def split_conversations(df: DataFrame, share: float = VALIDATION, seed: int = 1729) -> DataFrame:
    """Adds is_val: at least one conversation, else the share rounded down, in seeded order."""
    from .corpus import seeded

    convs = df.select("conv_id").distinct().withColumn("_h", seeded(seed, "conv_id"))
    most = convs.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("n"))
    limit = most.first()[0]
    chosen = convs.orderBy("_h", "conv_id").limit(int(limit)).select("conv_id", F.lit(True).alias("_v"))
    return df.join(chosen, "conv_id", "left").withColumn("is_val", F.coalesce("_v", F.lit(False))).drop("_v")


def encode_supervised(segments: DataFrame, max_length: int = 512, ids: str = "ids") -> DataFrame:
    """input_ids and labels (IGNORE where not a target), shifted by one and cut to ``max_length``.

    ``segments``: conv_id, pos, is_target and the segment's ids."""
    rows = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", ids, "is_target"))).alias("s"))
    every = F.flatten(F.transform("s", lambda x: x[ids]))
    labels = F.flatten(F.transform("s", lambda x: F.when(x["is_target"], x[ids]).otherwise(F.array_repeat(F.lit(IGNORE), F.size(x[ids])))))
    cut = lambda c, start: F.slice(c, start, F.least(F.lit(max_length), F.greatest(F.size(every) - 1, F.lit(0))))
    return rows.select("conv_id", cut(every, 1).alias("input_ids"), cut(labels, 2).alias("labels"))


def drop_unsupervised(df: DataFrame) -> DataFrame:
    return df.where(F.exists("labels", lambda x: x != IGNORE))


def supervised_ratio(df: DataFrame) -> DataFrame:
    n = F.sum(F.size("input_ids"))
    return df.agg(F.sum(F.size(F.filter("labels", lambda x: x != IGNORE))).alias("supervised"), n.alias("tokens")).withColumn("ratio", F.coalesce(F.try_divide("supervised", "tokens"), F.lit(0.0)))


def routing_label(segments: DataFrame, ids: str = "ids") -> DataFrame:
    """The first target token of each conversation."""
    return segments.where("is_target").groupBy("conv_id").agg(F.min_by(F.element_at(F.col(ids), 1), "pos").alias("token"))


def trim(df: DataFrame, most: int) -> DataFrame:
    """A leading system turn and the last ``most`` others, without tool turns at their start."""
    by_conv = Window.partitionBy("conv_id")
    up, down = by_conv.orderBy("turn"), by_conv.orderBy(F.desc("turn"))
    first = F.row_number().over(up) == 1
    marked = df.withColumn("_system", first & (F.col("role") == "system"))
    kept = marked.withColumn("_r", F.sum(F.when(F.col("_system"), 0).otherwise(1)).over(down)).withColumn("_rest", F.sum(F.when(F.col("_system"), 0).otherwise(1)).over(by_conv))
    kept = kept.where(F.col("_system") | (F.col("_r") <= most))
    opened = F.max(F.when(~F.col("_system") & (F.col("role") != "tool"), 1).otherwise(0)).over(up)
    out = kept.withColumn("_open", opened).where(F.col("_system") | (F.col("_open") == 1) | (F.col("_rest") <= most))
    return out.drop("_system", "_r", "_rest", "_open")


def flatten_messages(df: DataFrame) -> DataFrame:
    """Non-empty contents of turns other than system, joined by blank lines."""
    rows = df.where((F.col("role") != "system") & (F.coalesce("content", F.lit("")) != ""))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["content"]), "\n\n").alias("text"))


def inject_system(df: DataFrame, prompt: str) -> DataFrame:
    """A system turn before the first, unless the first is one."""
    first = df.groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.min("turn").alias("turn")).where("role <> 'system'")
    added = first.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    return df.unionByName(added, allowMissingColumns=True)


def leaks(training: DataFrame, prompts: DataFrame, text: str = "text") -> DataFrame:
    """Prompts that equal a training text, both stripped and lower-cased.

    The texts are filtered by the prompts first, where Spark can send the smaller side: what goes on are
    keys of texts that are prompts."""
    norm = lambda c: F.lower(strip(F.col(c)))
    asked = prompts.withColumn("_k", norm(text))
    met = training.select(norm(text).alias("_k")).join(asked.select("_k"), "_k", "left_semi").distinct()
    return asked.join(met, "_k", "left_semi").drop("_k")

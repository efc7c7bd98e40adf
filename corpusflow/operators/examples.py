"""Training conversations from compact examples, with tools really run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tools import Registry, default_registry

SCHEMA = "example_id long, user string, answer string, think string, call struct<name:string,arguments:string>, result string, pinned boolean, expect_error boolean, history array<struct<user:string,assistant:string>>"
TURN = "struct<role:string,content:string,thinking:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,is_error:boolean>"


def build_examples(examples: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row for each turn: conv_id, turn, role, content, thinking, tool_calls, is_error.

    A call's result comes from running the tool, unless the example pins it.  A tool that fails, or
    that succeeds where an error is expected, raises: then the example teaches what isn't so."""
    registry = registry or default_registry()
    calls = examples.where("call IS NOT NULL AND NOT coalesce(pinned, false)").withColumn("r", registry.column(F.col("call.name"), F.col("call.arguments")))
    wrong = F.col("r.is_error") != F.coalesce("expect_error", F.lit(False))
    ran = calls.withColumn("result", F.when(wrong, F.raise_error(F.concat(F.lit("example "), F.col("example_id").cast("string"), F.lit(": "), F.col("r.content")))).otherwise(F.col("r.content"))).withColumn("failed", F.col("r.is_error")).drop("r")
    rest = examples.where("call IS NULL OR coalesce(pinned, false)").withColumn("failed", F.lit(False))
    lost = F.col("call").isNotNull() & F.col("result").isNull()
    rest = rest.withColumn("result", F.when(lost, F.raise_error(F.lit("a pinned example has no result"))).otherwise(F.col("result")))
    every = rest.unionByName(ran)

    def turn(role, content, thinking=None, tool_calls=None, is_error=None):
        none = F.lit(None).cast("string")
        no_calls = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
        return F.struct(F.lit(role).alias("role"), content.alias("content"), (none if thinking is None else thinking).alias("thinking"), (no_calls if tool_calls is None else tool_calls).alias("tool_calls"), (F.lit(False) if is_error is None else is_error).alias("is_error"))

    past = F.flatten(F.transform(F.coalesce("history", F.array().cast("array<struct<user:string,assistant:string>>")), lambda h: F.array(turn("user", h["user"]), turn("assistant", h["assistant"]))))
    call = F.array(F.struct(F.concat(F.lit("call_"), F.substring(F.md5(F.col("example_id").cast("string")), 1, 12)).alias("id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments")))
    plain = F.array(turn("assistant", F.col("answer"), F.col("think")))
    with_call = F.array(turn("assistant", F.lit(""), F.col("think"), call), turn("tool", F.col("result"), is_error=F.col("failed")), turn("assistant", F.col("answer")))
    turns = F.concat(past, F.array(turn("user", F.col("user"))), F.when(F.col("call").isNull(), plain).otherwise(with_call))
    return every.select(F.col("example_id").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.*")


def answer_faults(turns: DataFrame) -> DataFrame:
    """Conversations whose last answer mentions no number of the tool's result, exact or to 2 places."""
    from .evaluation import NUMBER, mentions_number

    tools = turns.where("role = 'tool' AND NOT is_error").select("conv_id", F.regexp_extract("content", NUMBER, 0).alias("value")).where("value <> ''")
    last = turns.groupBy("conv_id").agg(F.max_by("content", "turn").alias("answer"))
    value = F.replace("value", F.lit(","), F.lit("")).cast("double")
    agrees = mentions_number(value.cast("string"), F.col("answer")) | mentions_number(F.round(value, 2).cast("string"), F.col("answer"))
    return tools.join(last, "conv_id").where(~agrees).select("conv_id")


#: Turn numbers of a conversation whose hashes are chained in one task.
SLICE_TURNS = 256


def prompt_copies(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, history_turns, copies: how many user turns of the table say the same after the same turns.

    A history is one key without being collected: each turn's 128-bit hash is taken with its place in the
    conversation, and a prefix is the exclusive-or of those before it.  The chain runs over slices of turn numbers
    and then inside them, on rows of hashes alone, so a conversation may be of any length.  Null texts and roles
    differ from empty ones; turns that share a number are in the order of their hashes."""
    said = [F.coalesce(F.col(c), F.lit("\0null")) for c in (role, text)]
    rows = turns.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), (F.col(role) == "user").alias("asks"), F.xxhash64(*said).alias("h"), F.xxhash64(F.lit(1), *said[::-1]).alias("g"))
    rows = rows.withColumn("no", F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / SLICE_TURNS))
    inside = Window.partitionBy("conv", "no").orderBy("turn", "h", "g")
    earlier = Window.partitionBy("_conv").orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)

    def before(slices: DataFrame, *sums) -> DataFrame:
        """For each slice what all earlier ones of its conversation come to."""
        return slices.groupBy(F.col("conv").alias("_conv"), F.col("no").alias("_no")).agg(*sums)

    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("no") == F.col("_no"))
    counts = before(rows, F.count("*").alias("n")).select("_conv", "_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = rows.join(counts, same).drop("_conv", "_no").withColumn("place", F.col("base") + F.row_number().over(inside) - 1)
    placed = placed.withColumns({"hp": F.xxhash64("place", "h", "g"), "gp": F.xxhash64("g", "h", "place")})
    xors = before(placed, F.bit_xor("hp").alias("x"), F.bit_xor("gp").alias("y")).select("_conv", "_no", *(F.coalesce(F.bit_xor(k).over(earlier), F.lit(0)).alias(k) for k in "xy"))
    chained = placed.join(xors, same)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    chained = chained.withColumns({k: F.col(k).bitwiseXOR(F.coalesce(F.bit_xor(p).over(past), F.lit(0))) for k, p in (("x", "hp"), ("y", "gp"))})
    asked = chained.where("asks").select(F.col("conv").alias(conv_id), F.col("turn").alias(turn), F.col("place").cast("long").alias("history_turns"), "h", "g", "x", "y")
    key = ["history_turns", "h", "g", "x", "y"]
    return asked.join(asked.groupBy(*key).agg(F.count("*").alias("copies")), key).select(conv_id, turn, "history_turns", "copies")

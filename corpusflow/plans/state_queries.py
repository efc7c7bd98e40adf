"""Examples, the model boundary and its wire format, over inline rows and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import engine as N
from ..operators import chat as H
from ..operators import examples as X
from ..operators import state as S
from ..operators import tokenizer as K
from ..sources.files import load_settings
from ..functions.tools import default_registry
from .chat_queries import turns
from .common import table, values

QUERIES, SQL = {}, {}
_EXAMPLES = [
    (1, "2+2?", "It is 4.", None, ("calculate", '{"expression": "2+2"}'), None, False, False, None),
    (2, "Hello", "Hello.", "greet", None, None, False, False, [("Hi", "Hi.")]),
    (3, "1/0?", "I cannot.", None, ("calculate", '{"expression": "1/0"}'), None, False, True, None),
    (4, "News?", "It rains.", None, ("web_search", '{"query": "rain"}'), "Rain today", True, False, None),
]


def examples(spark, d):
    return X.build_examples(spark.createDataFrame(_EXAMPLES, X.SCHEMA))


QUERIES["build_examples"] = lambda spark, d: examples(spark, d).select("conv_id", "turn", "role", "is_error", F.size("tool_calls").alias("calls"))
SQL["build_examples"] = "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, is_error, calls FROM " + values([(1, 0, "user", False, 0), (1, 1, "assistant", False, 1), (1, 2, "tool", False, 0), (1, 3, "assistant", False, 0), (2, 0, "user", False, 0), (2, 1, "assistant", False, 0), (2, 2, "user", False, 0), (2, 3, "assistant", False, 0), (3, 0, "user", False, 0), (3, 1, "assistant", False, 1), (3, 2, "tool", True, 0), (3, 3, "assistant", False, 0), (4, 0, "user", False, 0), (4, 1, "assistant", False, 1), (4, 2, "tool", False, 0), (4, 3, "assistant", False, 0)], "conv_id", "turn", "role", "is_error", "calls")
QUERIES["dq_answer_agrees"] = lambda spark, d: X.answer_faults(examples(spark, d))
SQL["dq_answer_agrees"] = "SELECT conv_id FROM conversations WHERE FALSE"
QUERIES["wire_codecs"] = lambda spark, d: (lambda t: t.select("conv_id", "turn", N.wire_message(t).alias("message")))(turns(spark, d).where("role = 'user'"))
SQL["wire_codecs"] = "SELECT conv_id, turn, '{\"role\":\"user\",\"content\":' || to_json(text) || '}' AS message FROM conversations WHERE role = 'user' AND turn % 5 <> 3"
_THINK = [(1, None, None), (2, False, None), (3, True, "low"), (4, True, None)]
QUERIES["wire_think"] = lambda spark, d: spark.createDataFrame(_THINK, "id int, enabled boolean, effort string").select("id", N.wire_think(F.col("enabled"), F.col("effort")).alias("think"))
SQL["wire_think"] = "SELECT * FROM " + values([(1, None), (2, "false"), (3, '"low"'), (4, "true")], "id", "think")
_RAW = [(1, '[{"function": {"name": "f", "arguments": {"a": 1}}}]'), (2, '[{"id": "x", "function": {"name": "g", "arguments": "{\\"b\\": 2}"}}, {"function": {"name": ""}}]'), (3, "[]")]
QUERIES["wire_calls"] = lambda spark, d: spark.createDataFrame(_RAW, "id int, raw string").select("id", F.explode(N.read_calls(F.col("raw"))).alias("c")).select("id", "c.name", F.replace("c.arguments", F.lit(" "), F.lit("")).alias("arguments"))
SQL["wire_calls"] = "SELECT * FROM " + values([(1, "f", '{"a":1}'), (2, "g", '{"b":2}')], "id", "name", "arguments")
ECHO = N.Engine("echo", load=lambda: str.upper, chat=lambda model, prompts: [model(p) for p in prompts])
QUERIES["engine_contract"] = lambda spark, d: H.render(H.with_columns(table(spark, d, "conversations"))).select("conv_id", F.length(ECHO.column(F.col("text"))).alias("n"))


# Sessions: what the sink writes, read again.
_SESSION = "struct<messages:array<struct<role:string,content:string>>>"


def sessions(spark, d):
    from .chat_queries import QUERIES as chat

    text = F.concat(F.lit('{"messages":['), "messages", F.lit("]}"))
    return chat["sink_session"](spark, d).select("conv_id", F.posexplode(F.from_json(text, _SESSION)["messages"]).alias("place", "m")).select("conv_id", "place", "m.role", "m.content")


QUERIES["sess_load"] = sessions
SQL["sess_load"] = "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place, role, text AS content FROM conversations"
QUERIES["cfg_load"] = lambda spark, d: spark.createDataFrame([(k, str(v)) for k, v in load_settings({"port": 80, "debug": False, "name": "x"}, None, {"CORPUSFLOW_PORT": "81", "CORPUSFLOW_DEBUG": "on", "CORPUSFLOW_OTHER": "1"}).items()], "key string, value string")
SQL["cfg_load"] = "SELECT * FROM " + values([("port", "81"), ("debug", "True"), ("name", "x")], "key", "value")
QUERIES["quieter"] = lambda spark, d: table(spark, d, "documents").select("doc_id", S.shift_level((F.col("doc_id") % 7).cast("int"), -(F.col("doc_id") % 3).cast("int")).alias("level"))
SQL["quieter"] = "SELECT doc_id, CAST(greatest(0, least(6, doc_id % 7 - doc_id % 3)) AS INTEGER) AS level FROM documents"


def _asks(df):
    """A stand-in model: sums are handed to the calculator once, everything else is answered."""
    first, seen = F.col("transcript")[0]["content"], F.size("transcript")
    calls = F.contains(first, F.lit("+")) & (seen == 1)
    content = F.when(seen > 1, F.concat(F.lit("It is "), F.element_at("transcript", -1)["content"], F.lit("."))).otherwise(F.when(calls, F.lit("")).otherwise("Hello."))
    return df.select("*", content.alias("content"), F.when(calls, "calculate").alias("name"), F.to_json(F.struct(first.alias("expression"))).alias("arguments"))


def agent_loop(spark, d):
    asks = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.when(F.col("doc_id") % 2 == 0, F.format_string("%d + 1", "doc_id")).otherwise("hi").alias("prompt"))
    return S.replay_agent(asks, _asks, default_registry().column, 3).select("conv_id", "rounds", "exhausted", F.element_at("transcript", -1)["content"].alias("answer"))


QUERIES["agent_loop"] = agent_loop
SQL["agent_loop"] = "SELECT doc_id AS conv_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS rounds, FALSE AS exhausted, CASE WHEN doc_id % 2 = 0 THEN 'It is ' || (doc_id + 1) || '.' ELSE 'Hello.' END AS answer FROM documents"
QUERIES["bpe_stop"] = lambda spark, d: spark.createDataFrame([(K.train_bpe(spark.createDataFrame([("ab ab ab",)], "text string"), 400).size,)], "size int")
SQL["bpe_stop"] = "SELECT 259 AS size"

"""Conversation and data-quality queries over the test tables and small inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import Sql
from ..operators import chat as H
from ..operators.examples import prompt_copies
from .common import table, values

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Turns of the conversations table; every third assistant turn also thinks, every fourth also calls.
_TURN = [
    "conv_id",
    "turn",
    "CASE WHEN turn % 5 = 3 AND role = 'user' THEN 'tool' ELSE role END AS role",
    "text AS content",
    "CASE WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'thought ' || turn END AS thinking",
    "role = 'assistant' AND conv_id % 4 = 0 AND turn % 4 = 1 AS calls",
]
_ARGUMENTS = "'{\"a\": \"' || turn || '\", \"b\": \"é\"}'"


def turns(spark, d):
    base = table(spark, d, "conversations").selectExpr(*_TURN)
    one = F.array(F.struct(F.lit("call_1").alias("id"), F.lit("calculate").alias("name"), F.expr(_ARGUMENTS).alias("arguments")))
    return base.withColumn("tool_calls", F.when(F.col("calls"), one).otherwise(F.array().cast(H.CALLS))).drop("calls")


_T = f"t AS (SELECT {', '.join(_TURN)} FROM conversations)"
_CALL = f"'{H.CALL_OPEN}calculate ' || {_ARGUMENTS} || '{H.CALL_CLOSE}'"
_ASSISTANT = f"'{H.ASSISTANT}' || CASE WHEN thinking IS NOT NULL THEN '{H.THINK_OPEN}' || thinking || '{H.THINK_CLOSE}' ELSE '' END || CASE WHEN calls THEN {_CALL} ELSE '' END || content || CASE WHEN calls THEN '' ELSE '{H.END}' END"
_PIECE = f"CASE role WHEN 'user' THEN '{H.USER}' || content WHEN 'assistant' THEN {_ASSISTANT} WHEN 'tool' THEN '{H.RESULT_OPEN}' || content || '{H.RESULT_CLOSE}' ELSE '' END"

_CALLS_ROWS = [(1, "calculate", "2+2", "x"), (2, "web_search", "מה קורה", 'a "quoted" one'), (3, "t", "", "é")]
query("fmt_tool_call", "SELECT id, '<|call|>' || name || ' {\"expression\": ' || to_json(a) || ', \"other\": ' || to_json(b) || '}<|/call|>' AS text FROM " + values(_CALLS_ROWS, "id", "name", "a", "b"))(
    lambda spark, d: spark.createDataFrame(_CALLS_ROWS, "id int, name string, a string, b string").select("id", H.tool_call_text(F.col("name"), H.flat_json(F.create_map(F.lit("other"), "b", F.lit("expression"), "a"))).alias("text"))
)
query("fmt_conversation", f"WITH {_T}, p AS (SELECT conv_id, turn, {_PIECE} AS piece FROM t) SELECT conv_id, string_agg(piece, '' ORDER BY turn) || '{H.ASSISTANT}' AS text FROM p GROUP BY conv_id")(lambda spark, d: H.render(turns(spark, d)))
_SEGMENTS = f"""{_T}, s AS (
SELECT conv_id, turn, 0 AS k, '{H.USER}' || content AS text, FALSE AS is_target FROM t WHERE role = 'user' UNION ALL
SELECT conv_id, turn, 0, '{H.RESULT_OPEN}' || content || '{H.RESULT_CLOSE}', FALSE FROM t WHERE role = 'tool' UNION ALL
SELECT conv_id, turn, 0, '{H.ASSISTANT}', FALSE FROM t WHERE role = 'assistant' UNION ALL
SELECT conv_id, turn, 1, '{H.THINK_OPEN}' || thinking || '{H.THINK_CLOSE}', TRUE FROM t WHERE role = 'assistant' AND thinking IS NOT NULL UNION ALL
SELECT conv_id, turn, 2, {_CALL}, TRUE FROM t WHERE calls UNION ALL
SELECT conv_id, turn, 3, content, TRUE FROM t WHERE role = 'assistant' AND content <> '' UNION ALL
SELECT conv_id, turn, 4, '{H.END}', TRUE FROM t WHERE role = 'assistant' AND NOT calls),
g AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS INTEGER) AS pos, text, is_target FROM s)"""
query("sup_segments", f"WITH {_SEGMENTS} SELECT conv_id, pos, text, is_target FROM g")(lambda spark, d: H.supervised_segments(turns(spark, d)))
query("supervised_ratio", f"WITH {_SEGMENTS} SELECT CAST(sum(length(text)) FILTER (is_target) AS BIGINT) AS supervised, CAST(sum(length(text)) AS BIGINT) AS characters FROM g")(
    lambda spark, d: H.supervised_segments(turns(spark, d)).agg(F.sum(F.when(F.col("is_target"), F.length("text"))).alias("supervised"), F.sum(F.length("text")).alias("characters"))
)
query("strip_markers", "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, " + Sql.strip("text") + " AS text FROM conversations)")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", H.strip_markers(F.concat(F.lit(" " + "".join(H.MARKERS)), "text", F.lit(H.END + "\n"))).alias("text"))
)

_RESPONSES = [
    (1, "<|think|>why<|/think|>The answer is 4.<|end|>", "The answer is 4.", "why", 0, None, None),
    (2, "why not<|/think|>Yes.", "Yes.", "why not", 0, None, None),
    (3, '<|call|>calculate {"expression": "2+2"}<|/call|>', "", None, 1, "calculate", '{"expression": "2+2"}'),
    (4, "<|call|>web_search not json<|/call|>Found.", "Found.", None, 1, "web_search", "{}"),
    (5, 'Fine. 100 * 000"}<|/call|>', "Fine.", None, 0, None, None),
    (6, "<|result|>4<|/result|>It is 4.", "It is 4.", None, 0, None, None),
    (7, "<|call|>  <|/call|>plain", "plain", None, 0, None, None),
    (8, "", "", None, 0, None, None),
    (9, 'a<|think|>b<|/think|>c<|call|>t [1]<|/call|><|call|>u {"x": {"y": 1}}<|/call|>', "c", "ab", 2, "t", "{}"),
]


def parsed(spark, started=False):
    rows = spark.createDataFrame([r[:2] for r in _RESPONSES], "id int, text string").withColumn("p", H.parse_response(F.col("text"), started))
    first = F.try_element_at("p.tool_calls", F.lit(1))
    return rows.select("id", F.col("p.content").alias("content"), F.col("p.thinking").alias("thinking"), F.size("p.tool_calls").alias("n_calls"), first["name"].alias("name"), first["arguments"].alias("arguments"))


query("parse_response", "SELECT id, content, thinking, n_calls, name, arguments FROM " + values([(r[0], *r[2:]) for r in _RESPONSES], "id", "content", "thinking", "n_calls", "name", "arguments"))(lambda spark, d: parsed(spark))
_PAYLOADS = [(1, "f {}", "f", "{}"), (2, ' g {"a": 1} ', "g", '{"a": 1}'), (3, "h", "h", "{}"), (4, "", None, None), (5, "k [1, 2]", "k", "{}"), (6, "m {broken", "m", "{}")]
query("parse_call", "SELECT id, name, arguments FROM " + values([(r[0], r[2], r[3]) for r in _PAYLOADS], "id", "name", "arguments"))(
    lambda spark, d: spark.createDataFrame([r[:2] for r in _PAYLOADS], "id int, p string").withColumn("c", H.parse_call(F.col("p"))).select("id", "c.name", "c.arguments")
)
query("drop_thinking", f"WITH {_T} SELECT count(*) FILTER (role <> 'assistant' AND thinking IS NOT NULL) AS n FROM t")(lambda spark, d: H.drop_thinking(turns(spark, d)).agg(F.count("thinking").alias("n")))
query("thinking_policy", f"WITH {_T} SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 OR role <> 'assistant' THEN thinking END AS thinking FROM t")(
    lambda spark, d: turns(spark, d).select("conv_id", "turn", F.when((F.col("conv_id") % 2 == 0) | (F.col("role") != "assistant"), F.col("thinking")).alias("thinking"))
)
query("split_conversations", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('1729' || '|' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM c) SELECT conv_id, r <= greatest(1, floor(n * CAST(0.12 AS DOUBLE))) AS is_val FROM r")(
    lambda spark, d: H.split_conversations(turns(spark, d)).select("conv_id", "is_val").distinct()
)
query("session_trim", f"""WITH {_T}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role = 'system' AS pinned FROM t),
b AS (SELECT *, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, sum(CASE WHEN pinned THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id) AS rest FROM a),
c AS (SELECT *, max(CASE WHEN NOT pinned AND role <> 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS opened FROM b WHERE pinned OR r <= 4)
SELECT conv_id, turn, role FROM c WHERE pinned OR opened = 1 OR rest <= 4""")(lambda spark, d: H.trim(turns(spark, d), 4).select("conv_id", "turn", "role"))
query("flatten_messages", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY conv_id")(lambda spark, d: H.flatten_messages(H.with_columns(table(spark, d, "conversations"))))
query("system_prompt_inject", "WITH f AS (SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations GROUP BY conv_id) SELECT conv_id, turn, role, text AS content FROM conversations UNION ALL SELECT conv_id, turn - 1, 'system', 'Be brief.' FROM f WHERE role <> 'system'")(
    lambda spark, d: H.inject_system(H.with_columns(table(spark, d, "conversations")).select("conv_id", "turn", "role", "content"), "Be brief.")
)
query("sink_session", "SELECT conv_id, string_agg('{\"role\":' || to_json(role) || ',\"content\":' || to_json(text) || '}', ',' ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")(
    lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json(F.struct("role", F.col("text").alias("content")), {"ignoreNullFields": "true"}).alias("m")))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["m"]), ",").alias("messages"))
)


def encoded_segments(spark, d):
    points = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
    return H.supervised_segments(turns(spark, d)).withColumn("ids", points)


_IDS = f"{_SEGMENTS}, e AS (SELECT conv_id, string_agg(text, '' ORDER BY pos) AS body, string_agg(CASE WHEN is_target THEN regexp_replace(text, '(?s).', 't', 'g') ELSE regexp_replace(text, '(?s).', 'c', 'g') END, '' ORDER BY pos) AS marks FROM g GROUP BY conv_id), n AS (SELECT conv_id, least(512, length(body) - 1) AS n, substring(marks, 2, least(512, length(body) - 1)) AS marks FROM e)"
query("encode_supervised", f"WITH {_IDS} SELECT conv_id, CAST(n AS INTEGER) AS tokens, CAST(length(replace(marks, 'c', '')) AS INTEGER) AS supervised FROM n")(
    lambda spark, d: H.encode_supervised(encoded_segments(spark, d)).select("conv_id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != H.IGNORE)).alias("supervised"))
)
query("drop_unsupervised", f"WITH {_IDS} SELECT count(*) AS kept FROM n WHERE length(replace(marks, 'c', '')) > 0")(lambda spark, d: H.drop_unsupervised(H.encode_supervised(encoded_segments(spark, d))).agg(F.count("*").alias("kept")))
query("routing_label", f"WITH {_SEGMENTS} SELECT conv_id, unicode(arg_min(text, pos)) AS token FROM g WHERE is_target GROUP BY conv_id")(lambda spark, d: H.routing_label(encoded_segments(spark, d)))

# Data quality.
query("eval_leakage", f"SELECT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM conversations c WHERE lower({Sql.strip('c.text')}) = lower({Sql.strip('b.text')})) OR EXISTS (SELECT 1 FROM documents c WHERE lower({Sql.strip('c.text')}) = lower({Sql.strip('b.text')}))")(
    lambda spark, d: H.leaks(table(spark, d, "conversations").select("text").unionByName(table(spark, d, "documents").select("text")), table(spark, d, "benchmark")).select("item_id")
)
query("dq_duplicates", """WITH h AS (SELECT conv_id, turn, role, text, coalesce(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS history_turns FROM conversations),
u AS (SELECT * FROM h WHERE role = 'user'), k AS (SELECT text, history, count(*) AS copies FROM u GROUP BY 1, 2)
SELECT conv_id, turn, history_turns, copies FROM u JOIN k USING (text, history)""")(lambda spark, d: prompt_copies(table(spark, d, "conversations")))
query("dq_balance", "SELECT count(*) FILTER (toxic = 1) AS a, count(*) FILTER (toxic = 0) AS b, CAST(count(*) FILTER (toxic = 1) AS DOUBLE) / nullif(count(*) FILTER (toxic = 0), 0) BETWEEN 0.7 AND 1.4 AS balanced FROM labels")(
    lambda spark, d: table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")).withColumn("balanced", F.try_divide("a", "b").between(0.7, 1.4))
)
_MARKS = ["cannot", "do not know", "not able", "the"]
query("dq_refusal_coverage", "SELECT count(*) FILTER (" + " OR ".join(f"contains(lower(text), '{m}')" for m in _MARKS) + ") AS n, count(*) FILTER (" + " OR ".join(f"contains(lower(text), '{m}')" for m in _MARKS) + ") >= 20 AS enough FROM conversations WHERE role = 'assistant'")(
    lambda spark, d: table(spark, d, "conversations").where("role = 'assistant'").agg(F.count_if(F.exists(F.array(*map(F.lit, _MARKS)), lambda m: F.contains(F.lower("text"), m))).alias("n")).withColumn("enough", F.col("n") >= 20)
)
query("dq_nonempty", f"SELECT conv_id, turn FROM conversations WHERE {Sql.strip('text')} = ''")(lambda spark, d: table(spark, d, "conversations").where(H.strip(F.col("text")) == "").select("conv_id", "turn"))
query("dq_max_len", "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n FROM conversations WHERE role = 'assistant' AND length(text) >= 300")(lambda spark, d: table(spark, d, "conversations").where("role = 'assistant' AND length(text) >= 300").select("conv_id", "turn", F.length("text").alias("n")))
query("dq_no_markers", "SELECT conv_id, turn FROM conversations WHERE contains(text, '<|')")(lambda spark, d: table(spark, d, "conversations").where(F.exists(F.array(*map(F.lit, H.MARKERS)), lambda m: F.contains("text", m))).select("conv_id", "turn"))
_WORDS = [(1, "am"), (2, "i"), (3, "of"), (4, "seven"), (5, "x"), (6, "the")]
query("dq_marker_quality", "SELECT id, marker FROM " + values(_WORDS, "id", "marker") + " WHERE length(marker) < 2 OR marker IN ('the', 'of', 'and')")(
    lambda spark, d: (lambda m: m.where(F.length("marker") < 2).unionByName(m.join(spark.createDataFrame([("the",), ("of",), ("and",)], "marker string"), "marker", "left_semi").select("id", "marker").where(F.length("marker") >= 2)))(spark.createDataFrame(_WORDS, "id int, marker string"))
)

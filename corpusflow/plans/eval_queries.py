"""Evaluation, decoding, tools, settings and page queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tools as T
from ..functions.text import SPACE, Sql
from ..operators import evaluation as E
from ..operators import state as S
from ..operators.shared import bounded_batches
from ..sources import files as S_FILES
from .common import literal, table, values

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def inline(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Checks of answers: whole documents stand in for answers.
_ANSWER = "text"


def answers(spark, d):
    bounded_batches(spark)
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("answer"))


_A = f"a AS (SELECT doc_id, {_ANSWER} AS answer FROM documents)"
_MENTIONS = f"len(list_filter(regexp_extract_all(answer, '{E.NUMBER}'), lambda x: abs(coalesce(TRY_CAST(replace(x, ',', '') AS DOUBLE), 1e308) - v) < 1e-6)) > 0"
query("mentions_number", f"WITH {_A}, b AS (SELECT doc_id, answer, CAST(doc_id * 1000 + 0.5 AS DOUBLE) AS v FROM a) SELECT doc_id, {_MENTIONS} AS ok FROM b")(
    lambda spark, d: answers(spark, d).select("doc_id", E.mentions_number((F.col("doc_id") * 1000 + F.lit(0.5)).cast("string"), F.col("answer")).alias("ok"))
)
_MARK = "CASE doc_id % 3 WHEN 0 THEN 'am' WHEN 1 THEN ' Do not ' ELSE 'so' END"
_M = f"lower({Sql.strip(_MARK)})"
query("marker_match", f"WITH {_A} SELECT doc_id, CASE WHEN contains({_M}, ' ') THEN contains(lower(answer), {_M}) ELSE regexp_matches(lower(answer), '(^|[^\\p{{L}}\\p{{N}}_])' || {_M} || '($|[^\\p{{L}}\\p{{N}}_])') END AS ok FROM a")(
    lambda spark, d: answers(spark, d).select("doc_id", E.marker_match(F.expr(_MARK), F.lower("answer")).alias("ok"))
)
_SCRIPT = "CASE WHEN length(regexp_replace(answer, '[^\\x{0590}-\\x{05FF}A-Za-z]', '', 'g')) < 3 THEN NULL WHEN length(regexp_replace(answer, '[^\\x{0590}-\\x{05FF}]', '', 'g')) > length(regexp_replace(answer, '[^A-Za-z]', '', 'g')) THEN 'he' ELSE 'en' END"
query("dominant_script", f"WITH {_A} SELECT doc_id, {_SCRIPT} AS script FROM a")(lambda spark, d: answers(spark, d).select("doc_id", E.dominant_script(F.col("answer")).alias("script")))
_REFUSES = "(" + " OR ".join(f"contains(lower(answer), {literal(m)})" for m in E.REFUSALS) + ")"
query("refusal_match", f"WITH {_A} SELECT doc_id, {_REFUSES} AS ok FROM a")(lambda spark, d: answers(spark, d).select("doc_id", E.refuses(F.col("answer")).alias("ok")))
_WORDS = f"""w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(answer, '[{SPACE}]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(answer, '[{SPACE}]+'), lambda x: x <> ''), 1) AS i FROM a),
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), k AS (SELECT doc_id, lower(trim(word, '.,!?;:"''')) AS key FROM w),
m AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, key, count(*) AS c FROM k WHERE key <> '' GROUP BY doc_id, key) GROUP BY doc_id),
p AS (SELECT doc_id, i, lower(word) AS a, lower(lead(word, 1) OVER o) AS b, lower(lead(word, 2) OVER o) AS c, lower(lead(word, 3) OVER o) AS d, lower(lead(word, 4) OVER o) AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, 3 AS size, a || ' ' || b || ' ' || c AS phrase FROM p UNION ALL SELECT doc_id, 4, a || ' ' || b || ' ' || c || ' ' || d FROM p UNION ALL SELECT doc_id, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM p),
r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, size, phrase FROM g JOIN n USING (doc_id) WHERE phrase IS NOT NULL AND n >= 2 * size GROUP BY doc_id, size, phrase HAVING count(*) >= 3))"""
_DEGENERATE = f"{_A}, {_WORDS}, x AS (SELECT a.doc_id, coalesce(n.n, 0) >= 6 AND (coalesce(CAST(m.c AS DOUBLE) / n.n > 0.4, FALSE) OR r.doc_id IS NOT NULL) AS degenerate FROM a LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN r USING (doc_id))"
query("degenerate", f"WITH {_DEGENERATE} SELECT doc_id, degenerate FROM x")(lambda spark, d: answers(spark, d).select("doc_id", E.degenerate(F.col("answer")).alias("degenerate")))

# The evaluation as a whole.
_CASES = [
    "'Question ' || doc_id || '?' AS prompt",
    "CASE WHEN doc_id % 4 = 0 THEN 'calculate' END AS expects_tool",
    "CASE WHEN doc_id % 6 = 2 THEN CAST(doc_id * 1000 + 0.5 AS STRING) END AS expected_value",
    "doc_id % 6 = 1 AS expects_refusal",
    "CASE WHEN doc_id % 8 = 0 THEN 'calculate' WHEN doc_id % 12 = 6 THEN 'web_search' END AS called",
    "CASE WHEN doc_id % 8 = 0 THEN 'about ' || doc_id || '000.5' END AS tool_result",
    "FALSE AS tool_error",
    "CASE WHEN doc_id % 50 = 0 THEN 'timeout' END AS error",
]


def cases(spark, d):
    relevant = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("so"), F.lit("am"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").selectExpr("doc_id", "text AS answer", *_CASES).withColumn("relevant_if", relevant)


_MM = lambda m: f"regexp_matches(lower(answer), '(^|[^\\p{{L}}\\p{{N}}_]){m}($|[^\\p{{L}}\\p{{N}}_])')"
_JUDGED = f"""{_DEGENERATE}, c AS (SELECT doc_id, {_ANSWER} AS answer, {', '.join(_CASES).replace('STRING', 'VARCHAR')} FROM documents),
j AS (SELECT c.doc_id, error IS NULL AND (trim(answer) <> '' OR called IS NOT NULL) AND NOT contains(answer, '<|') AS format_ok, (called IS NOT NULL) = (expects_tool IS NOT NULL) AS routing_ok,
CASE WHEN expects_tool IS NOT NULL THEN coalesce(called = expects_tool, FALSE) END AS tool_name_ok,
CASE WHEN expects_tool IS NOT NULL THEN coalesce(called IS NOT NULL AND expected_value IS NOT NULL AND {_MENTIONS.replace('answer', "coalesce(tool_result, '')").replace('- v)', '- CAST(expected_value AS DOUBLE))')}, FALSE) END AS arguments_ok,
CASE WHEN expected_value IS NOT NULL THEN {_MENTIONS.replace('- v)', '- CAST(expected_value AS DOUBLE))')} END AS answer_ok,
CASE WHEN expects_refusal THEN {_REFUSES} END AS refusal_ok,
CASE WHEN trim(answer) <> '' OR called IS NOT NULL THEN CASE WHEN c.doc_id % 5 = 0 THEN {_MM('so')} OR {_MM('am')} WHEN expects_refusal THEN {_REFUSES} WHEN expected_value IS NOT NULL THEN regexp_matches(answer, '{E.NUMBER}') ELSE called IS NOT NULL END END AS relevant,
CASE WHEN {_SCRIPT} IS NOT NULL THEN {_SCRIPT} = 'en' END AS language_ok, CASE WHEN trim(answer) <> '' THEN NOT degenerate END AS coherent FROM c JOIN x USING (doc_id))"""
for _name, _column in (("format_ok", "format_ok"), ("routing_ok", "routing_ok"), ("arguments_ok", "arguments_ok"), ("relevance", "relevant"), ("language_match", "language_ok")):
    query(_name, f"WITH {_JUDGED} SELECT doc_id, {_column} AS ok FROM j")(lambda spark, d, c=_column: E.judged(cases(spark, d)).select("doc_id", F.col(c).alias("ok")))
_PCT = ", ".join(f"CAST(coalesce(round(100.0 * count(*) FILTER ({c}) / nullif(count({c}), 0), 1), 0.0) AS DOUBLE) AS {c}_pct" for c in E.CHECKS)
query("eval_summary", f"WITH {_JUDGED} SELECT count(*) AS cases, {_PCT} FROM j")(lambda spark, d: E.summary(E.judged(cases(spark, d))))

# Training log, from events: an event is a step, purchases carry validation losses.
_LOG = "SELECT event_id + 1 AS step, CASE WHEN event_id % 25 = 0 THEN value / 100 END AS val_loss, (event_id + 1) * 8192 AS tokens, (event_id + 1) * 1.5 + event_id % 7 AS elapsed_seconds FROM events"


def log(spark, d):
    return table(spark, d, "events").selectExpr("event_id + 1 AS step", "CASE WHEN event_id % 25 = 0 THEN value / 100 END AS val_loss", "(event_id + 1) * 8192 AS tokens", "CAST((event_id + 1) * 1.5 + event_id % 7 AS DOUBLE) AS elapsed_seconds")


_L = f"l AS ({_LOG})"
query("curve_points", f"WITH {_L} SELECT step, val_loss FROM l WHERE val_loss IS NOT NULL")(lambda spark, d: E.curve_points(log(spark, d)))
query("status_report", f"WITH {_L}, v AS (SELECT * FROM l WHERE val_loss IS NOT NULL), s AS (SELECT (SELECT max(step) FROM l) AS step, arg_min(val_loss, step) AS first_loss, arg_max(val_loss, step) AS last_loss, min(val_loss) AS least_loss FROM v) SELECT step, step * 8192 AS tokens, round(100.0 * step / 63232, 1) AS percent, first_loss, last_loss, least_loss, last_loss > least_loss + CAST(0.05 AS DOUBLE) AS rising FROM s")(
    lambda spark, d: E.status(log(spark, d), 63_232).withColumn("percent", F.col("percent").cast("double"))
)
query("throughput_eta", f"WITH {_L}, w AS (SELECT CAST((step - 1) // 10 AS BIGINT) AS \"window\", max(step) AS step, max(tokens) AS tokens, CAST(max(elapsed_seconds) AS DOUBLE) AS elapsed FROM l GROUP BY 1), s AS (SELECT *, (tokens - coalesce(lag(tokens) OVER (ORDER BY \"window\"), 0)) / (elapsed - coalesce(lag(elapsed) OVER (ORDER BY \"window\"), CAST(0 AS DOUBLE))) AS tokens_per_second FROM w) SELECT *, (20000000 - tokens) / tokens_per_second AS eta_seconds FROM s")(
    lambda spark, d: E.throughput(log(spark, d), 20_000_000)
)
query("best_checkpoint", f"WITH {_L}, v AS (SELECT step, val_loss, min(val_loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM l WHERE val_loss IS NOT NULL) SELECT step, val_loss FROM v WHERE b IS NULL OR val_loss < b")(lambda spark, d: E.best_checkpoints(log(spark, d)))
query("reached_step", f"WITH {_L} SELECT greatest(max(step), 1500) AS step FROM l")(lambda spark, d: log(spark, d).agg(F.greatest(F.max("step"), F.lit(1500)).alias("step")))
query("heldout_loss", "WITH b AS (SELECT event_id // 8 AS b, avg(value / 100) AS m FROM events GROUP BY 1), l AS (SELECT avg(m) AS loss FROM b) SELECT round(loss, 9) AS loss, round(exp(least(20.0, loss)), 6) AS perplexity FROM l")(
    lambda spark, d: E.held_out_loss(table(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("batch_id"), (F.col("value") / 100).alias("loss"))).select(F.round("loss", 9).alias("loss"), F.round("perplexity", 6).alias("perplexity"))
)
query("perplexity", "SELECT event_id, round(exp(least(20.0, value / 100)), 6) AS perplexity FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.round(F.exp(F.least(F.lit(20.0), F.col("value") / 100)), 6).alias("perplexity")))
query("bits_per_byte", "SELECT lang, round(3.5 / ln(2) / (CAST(sum(strlen(text)) AS DOUBLE) / sum(length(text))), 9) AS bits FROM documents GROUP BY lang")(
    lambda spark, d: table(spark, d, "documents").groupBy("lang").agg(F.round(E.bits_per_byte(F.lit(3.5), F.sum(F.octet_length("text")), F.sum(F.length("text"))), 9).alias("bits"))
)
query("stats_payload", f"WITH {_L} SELECT max(step) AS step, round(min(val_loss), 4) AS loss FROM l")(lambda spark, d: log(spark, d).agg(F.max("step").alias("step"), F.round(F.min("val_loss"), 4).alias("loss")))

# Decoding: an embedding is a row of logits.


def logits(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.round(F.col("logit").cast("double"), 3) + 0.0)


_G = "g AS (SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token, round(CAST(unnest(embedding) AS DOUBLE), 3) + CAST(0 AS DOUBLE) AS logit FROM embeddings)"
query("topk_filter", f"WITH {_G}, r AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM g) SELECT row_id, token, logit FROM r WHERE r <= 5")(lambda spark, d: E.top_k(logits(spark, d), 5))
query("topp_filter", f"WITH {_G}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS e FROM g), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS prob FROM e), b AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY row_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT row_id, token, logit FROM b WHERE b <= 0.3000001")(lambda spark, d: E.top_p(logits(spark, d), 0.3000001))
query("rep_penalty", f"WITH {_G} SELECT row_id, token, CASE WHEN token % 7 <> row_id % 7 THEN logit WHEN logit > 0 THEN logit / CAST(1.3 AS DOUBLE) ELSE logit * CAST(1.3 AS DOUBLE) END AS logit FROM g")(
    lambda spark, d: E.repetition_penalty(logits(spark, d), logits(spark, d).where("token % 7 = row_id % 7"), 1.3)
)
query("greedy", f"WITH {_G} SELECT row_id, arg_max(token, logit * 1000 - token / 1000.0) AS token FROM g GROUP BY row_id")(lambda spark, d: E.greedy(logits(spark, d)))
query("sample")(lambda spark, d: E.sample(logits(spark, d), 0.8, 1729))
query("routing_accuracy", f"WITH {_G}, b AS (SELECT row_id, arg_max(token, logit * 1000 - token / 1000.0) AS token FROM g GROUP BY row_id) SELECT avg(CASE WHEN token = row_id % 64 THEN 1.0 ELSE 0.0 END) AS accuracy FROM b")(
    lambda spark, d: E.routing_accuracy(logits(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 64).alias("token")))
)
query("truncate_prompt", "SELECT vec_id, len(embedding[-10:]) AS n, round(CAST(embedding[-10:][1] AS DOUBLE), 6) AS first FROM embeddings")(
    lambda spark, d: table(spark, d, "embeddings").select("vec_id", E.truncate_prompt(F.col("embedding"), 10).alias("e")).select("vec_id", F.size("e").cast("long").alias("n"), F.round(F.element_at("e", 1).cast("double"), 6).alias("first"))
)
query("lr_schedule", "SELECT i AS step, round(CASE WHEN i < 100 THEN 0.0003 * (i + 1) / 100 ELSE 0.0003 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (i - 100) / CAST(900 AS DOUBLE))))) END, 12) AS lr FROM range(0, 1200) t(i)")(
    lambda spark, d: spark.range(1200).select(F.col("id").alias("step"), F.round(E.learning_rate(F.col("id"), 1000, 0.0003, 100, 0.1), 12).alias("lr"))
)
_SHAPES = [(8192, 320, 8, 8, 4), (8192, 384, 10, 6, 2), (12000, 512, 12, 8, 8)]
query("ff_dim", "SELECT d, CAST(64 * round_even(d * 8 / 3.0 / 64, 0) AS BIGINT) AS ff FROM range(64, 2048, 32) t(d)")(lambda spark, d: spark.range(64, 2048, 32).select(F.col("id").alias("d"), E.ff_dim(F.col("id")).alias("ff")))
query("param_count", "SELECT CAST(v AS BIGINT) AS v, CAST(d AS BIGINT) AS d, CAST(v * d + l * (2 * d * d + 2 * d * (d // h * k) + 3 * d * CAST(64 * round_even(d * 8 / 3.0 / 64, 0) AS BIGINT) + 2 * d) + d AS BIGINT) AS params FROM " + values(_SHAPES, "v", "d", "l", "h", "k"))(
    lambda spark, d: inline(spark, _SHAPES, "v long, d long, l long, h long, k long").select("v", "d", E.param_count(*map(F.col, "vdlhk")).alias("params"))
)
query("chinchilla", "SELECT CAST(v AS BIGINT) AS v, CAST(v * 20 AS BIGINT) AS tokens FROM " + values(_SHAPES, "v", "d", "l", "h", "k"))(lambda spark, d: inline(spark, _SHAPES, "v long, d long, l long, h long, k long").select("v", E.tokens_for(F.col("v")).alias("tokens")))

# Tools.
_SUMS = [("2 + 2 * 3", "8", False), ("7 / 2", "3.5", False), ("2 ** 10", "1024", False), ("sqrt(16)", "4", False), ("1 < 2 < 3", "true", False), ("factorial(5)", "120", False), ("sum([1, 2, 3])", "6", False), ("10 // 4", "2", False), ("max(3, 7)", "7", False), ("[1, 2.0]", "1, 2", False)]
_BAD = ["__import__('os')", "9**9999", "factorial(5000)", "x + 1", "", "2 +", "1 / 0", "'a'"]
query("calculate", "SELECT e, CASE WHEN bad THEN NULL ELSE r END AS content, bad AS is_error FROM " + values([*_SUMS, *((b, None, True) for b in _BAD)], "e", "r", "bad"))(
    lambda spark, d: inline(spark, [(s[0],) for s in _SUMS] + [(b,) for b in _BAD], "e string").select("e", T.default_registry().column(F.lit("calculate"), F.to_json(F.struct(F.col("e").alias("expression")))).alias("r")).select("e", F.when(~F.col("r.is_error"), F.col("r.content")).alias("content"), F.col("r.is_error").alias("is_error"))
)
query("calculate_arithmetic", "SELECT doc_id, CAST(doc_id * 3 + n_chars - 7 AS VARCHAR) AS content FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", T.default_registry().column(F.lit("calculate"), F.to_json(F.struct(F.format_string("%d * 3 + %d - 7", "doc_id", "n_chars").alias("expression"))))["content"].alias("content"))
)
query("days_between", "SELECT event_id, abs(date_diff('day', a, b)) || ' day(s); ' || b || 'T00:00:00 is ' || CASE WHEN date_diff('day', a, b) >= 0 THEN 'after ' ELSE 'before ' END || a || 'T00:00:00' AS content FROM (SELECT event_id, CAST(ts AS DATE) AS a, DATE '2024-03-01' AS b FROM events)")(
    lambda spark, d: table(spark, d, "events").select("event_id", T.days_between_column(F.to_date("ts"), F.to_date(F.lit("2024-03-01"))).alias("content"))
)
query("current_time", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S (%A)') || ' in Asia/Kolkata [UTC+05:30]' AS content FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", T.current_time_column(F.col("ts").cast("timestamp"), "Asia/Kolkata").alias("content"))
)
_GIVEN = [(1, "expression"), (2, ""), (3, "expression,mode"), (4, "mode")]
query("tool_validate", "SELECT id, CASE id WHEN 2 THEN 'missing: expression' WHEN 4 THEN 'missing: expression' WHEN 3 THEN 'unknown: mode' END AS fault FROM " + values(_GIVEN, "id", "names"))(
    lambda spark, d: inline(spark, _GIVEN, "id int, names string").select("id", T.argument_faults(F.array(F.lit("expression")), F.array(F.lit("expression")), F.filter(F.split("names", ","), lambda x: x != "")).alias("fault"))
)
query("tool_execute", "SELECT * FROM (VALUES (1, 'tool ''calculate'' failed: division by zero', TRUE), (2, 'unknown tool ''nope''; there are ' || 'calculate, days_between', TRUE), (3, '31 day(s); 2024-02-01T00:00:00 is after 2024-01-01T00:00:00', FALSE)) AS v(id, content, is_error)")(lambda spark, d: inline(spark, [(1, "calculate", '{"expression": "1/0"}'), (2, "nope", "{}"), (3, "days_between", '{"start_date": "2024-01-01", "end_date": "2024-02-01"}')], "id int, name string, arguments string").select("id", T.default_registry().column(F.col("name"), F.col("arguments")).alias("r")).select("id", "r.content", "r.is_error"))
query("tool_schema")(lambda spark, d: inline(spark, [(n, __import__("json").dumps(T.schema_of(f))) for n, f in T.default_registry().tools.items()], "name string, schema string"))


@query("tool_register", "SELECT doc_id, CAST(doc_id + 1 AS VARCHAR) AS content FROM documents")
def tool_register(spark, d):
    T.default_registry().to_sql(spark, "calculate")
    return table(spark, d, "documents").select("doc_id", F.expr("calculate(concat(doc_id, ' + 1')).content").alias("content"))


# Settings and state.
_SPELLED = [(1, " SOL "), (2, "off"), (3, "6"), (4, "מי"), (5, "loud"), (6, "what"), (7, None), (8, "default")]
query("thinking_parse", "SELECT id, CAST(CASE id WHEN 1 THEN 4 WHEN 2 THEN 0 WHEN 3 THEN 6 WHEN 4 THEN 2 WHEN 5 THEN 5 WHEN 8 THEN 3 END AS INTEGER) AS level FROM " + values(_SPELLED, "id", "word"))(lambda spark, d: S.parse_level(inline(spark, _SPELLED, "id int, word string"), "word").select("id", "level"))
query("thinking_levels", "SELECT * FROM " + values([(r[0], r[1], r[4], r[6]) for r in S.LEVELS], "level", "name", "budget_tokens", "max_tool_iterations"))(lambda spark, d: S.levels(spark).select("level", "name", "budget_tokens", "max_tool_iterations"))
_LV = "SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS level, CAST(doc_id % 5 AS INTEGER) AS most, doc_id % 3 > 0 AS supported, CAST(doc_id % 4 - 2 AS INTEGER) AS steps FROM documents"
_lv = lambda spark, d: table(spark, d, "documents").selectExpr("doc_id", "CAST(doc_id % 7 AS INT) AS level", "CAST(doc_id % 5 AS INT) AS most", "doc_id % 3 > 0 AS supported", "CAST(doc_id % 4 - 2 AS INT) AS steps")
query("thinking_clamp", f"SELECT doc_id, CASE WHEN supported THEN least(level, most) ELSE 0 END AS level FROM ({_LV})")(lambda spark, d: _lv(spark, d).select("doc_id", S.clamp_level(F.col("level"), F.col("most"), F.col("supported")).alias("level")))
query("louder", f"SELECT doc_id, greatest(0, least(6, level + steps)) AS level FROM ({_LV})")(lambda spark, d: _lv(spark, d).select("doc_id", S.shift_level(F.col("level"), F.col("steps")).alias("level")))
query("iteration_ceiling", f"SELECT doc_id, coalesce(CASE WHEN supported THEN NULL ELSE most END, CASE WHEN steps > 0 THEN steps END, 4) AS most FROM ({_LV})")(
    lambda spark, d: _lv(spark, d).select("doc_id", S.iteration_ceiling(F.when(~F.col("supported"), F.col("most")), F.when(F.col("steps") > 0, F.col("steps")), F.lit(4)).alias("most"))
)
query("params_merge", f"SELECT doc_id, CASE WHEN supported THEN level ELSE 100 END AS temperature, coalesce(CASE WHEN steps > 0 THEN steps END, most) AS top_k FROM ({_LV})")(
    lambda spark, d: S.merge_parameters(_lv(spark, d).select("doc_id", F.lit(100).alias("temperature"), F.col("most").alias("top_k")), _lv(spark, d).select("doc_id", F.when(F.col("supported"), F.col("level")).alias("temperature"), F.when(F.col("steps") > 0, F.col("steps")).alias("top_k")), "doc_id")
)
_CANDIDATES, _INSTALLED = [("small", 1, "alpha:1b"), ("small", 2, "beta"), ("large", 1, "gamma:70b"), ("large", 2, "beta:latest"), ("none", 1, "delta")], [("beta:latest",), ("gamma:7b",)]
query("model_resolve", "SELECT * FROM (VALUES ('small', 'beta'), ('large', 'beta:latest')) AS v(spec, name)")(lambda spark, d: S.resolve_models(inline(spark, _CANDIDATES, "spec string, rank int, name string"), inline(spark, _INSTALLED, "name string")))
query("model_registry", "SELECT spec, count(*) AS candidates FROM " + values(_CANDIDATES, "spec", "rank", "name") + " GROUP BY spec")(lambda spark, d: inline(spark, _CANDIDATES, "spec string, rank int, name string").groupBy("spec").agg(F.count("*").alias("candidates")))
_MODELS = [("b", "large"), ("a", "large"), ("c", "small"), ("z", "other")]
query("catalogue_order", "SELECT name, row_number() OVER (ORDER BY CASE tier WHEN 'small' THEN 1 WHEN 'large' THEN 2 ELSE 3 END, name) AS place FROM " + values(_MODELS, "name", "tier"))(
    lambda spark, d: S.catalogue_order(inline(spark, _MODELS, "name string, tier string"), ["small", "large"]).select("name").withColumn("m", F.lit(0)).groupBy("m").agg(F.collect_list("name").alias("n")).select(F.posexplode("n").alias("p", "name")).select("name", (F.col("p") + 1).cast("long").alias("place"))
)
_MINUTE = "(hour(ts) * 60 + minute(ts))"
query("time_window", f"SELECT event_id, {_MINUTE} >= 1320 OR {_MINUTE} < 360 AS inside FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", S.in_window(F.hour("ts") * 60 + F.minute("ts"), 1320, 360).alias("inside")))
_FLIPS = "SELECT user_id, ts, event_id, CASE WHEN value >= 60 THEN TRUE WHEN value < 40 THEN FALSE END AS flip FROM events"
query("hysteresis", f"WITH f AS ({_FLIPS}) SELECT user_id, event_id, coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FALSE) AS running FROM f")(
    lambda spark, d: table(spark, d, "events").select("user_id", "event_id", S.hysteresis(F.col("value"), 60.0, 40.0, Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("running"))
)
_PULLS = [(1, "pulling", 50, 200), (2, "verifying", None, None), (3, "pulling", 5, 0)]
query("pull_progress", "SELECT id, CASE WHEN total > 0 THEN status || ' ' || (100 * done // total) || '%' ELSE status END AS line FROM " + values(_PULLS, "id", "status", "done", "total"))(lambda spark, d: inline(spark, _PULLS, "id int, status string, done long, total long").select("id", S.progress_line(F.col("status"), F.col("done"), F.col("total")).alias("line")))
query("src_lockfile", "SELECT unnest([5, 7, 9]) AS book_id")(lambda spark, d: inline(spark, [('{"ids": [5, 7, 9]}',)], "value string").select(F.explode(F.from_json("value", "ids array<int>")["ids"]).alias("book_id")))
_LINES = [(1, '{"step": 1, "train_loss": 2.5}'), (2, ""), (3, '{"step": 2, "val_loss": 2.0'), (4, '{"step": 3, "val_loss": 1.5}')]
query("log_scan", "SELECT CAST(step AS BIGINT) AS step, CAST(train_loss AS DOUBLE) AS train_loss, CAST(val_loss AS DOUBLE) AS val_loss FROM (VALUES (1, 2.5, NULL), (3, NULL, 1.5)) AS v(step, train_loss, val_loss)")(lambda spark, d: S_FILES.parse_log(inline(spark, _LINES, "id int, value string"), E.LOG_SCHEMA).select("step", "train_loss", "val_loss"))


@query("sink_log", "SELECT event_id + 1 AS step, value / 100 AS train_loss, CASE WHEN event_id % 25 = 0 THEN value / 50 END AS val_loss FROM events")
def sink_log(spark, d):
    """Every event appended to a log of JSON lines in two goes, and the log read again."""
    path = f"{S.shared_folder(spark)}/log-{uuid.uuid4().hex}"
    entries = table(spark, d, "events").selectExpr("event_id + 1 AS step", "value / 100 AS train_loss", "CASE WHEN event_id % 25 = 0 THEN value / 50 END AS val_loss")
    for part in ("step % 2 = 0", "step % 2 = 1"):
        S_FILES.append_log(entries.where(part), path)
    return S_FILES.read_log(spark, path, E.LOG_SCHEMA).select("step", "train_loss", "val_loss")


@query("sink_reports", "SELECT event_type, count(*) AS events, max(event_id) AS last FROM events GROUP BY event_type")
def sink_reports(spark, d):
    """A report, one JSON object a line, replaced as a whole and read again."""
    path = f"{S.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("last"))
    for _ in range(2):
        S_FILES.replace_report(report, path)
    return spark.read.schema(report.schema).json(path)


_FRAMES = [(1, '{"message": {"thinking": "hm"}, "done": false}'), (2, '{"message": {"content": "4"}, "done": false}'), (3, '{"done": true, "eval_count": 12, "total_duration": 2000000000}')]
query("ndjson_frames", "SELECT seq, kind, text, CAST(tokens AS BIGINT) AS tokens, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES (1, 'thinking', 'hm', NULL, NULL), (2, 'content', '4', NULL, NULL), (3, 'done', '', 12, 2.0)) AS v(seq, kind, text, tokens, seconds)")(lambda spark, d: S_FILES.chat_frames(inline(spark, _FRAMES, "seq int, value string")))

# Search pages: pages wrapped in a result's markup; links of the pages' own markup are another pattern.
_PAGE = "'<a class=\"result__a\" href=\"//x.example/l/?uddg=https%3A%2F%2Fa.b%2F' || page_id || '&r=1\">Title <b>' || page_id || '</b> &amp; more</a> <a class=\"result__snippet\" href=\"u\">Text ' || page_id || '</a>'"
query("serp_extract", "SELECT page_id, 'Title ' || page_id || ' & more' AS title, 'https://a.b/' || page_id AS url, 'Text ' || page_id AS snippet FROM pages")(
    lambda spark, d: table(spark, d, "pages").select("page_id", F.inline(S_FILES.search_results(F.expr(_PAGE))))
)
query("page_links", "SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS links FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).cast("long").alias("links")))
_BYTES = [(1, "48C3A9"), (2, "48E9"), (3, "")]
query("src_decode_fallback", "SELECT * FROM (VALUES (1, 'Hé'), (2, 'Hé'), (3, '')) AS v(id, text)")(lambda spark, d: inline(spark, _BYTES, "id int, h string").select("id", S_FILES.decode_fallback(F.unhex("h")).alias("text")))
query("src_decode_replace", "SELECT * FROM (VALUES (1, 'Hé'), (2, 'H' || chr(65533)), (3, '')) AS v(id, text)")(lambda spark, d: inline(spark, _BYTES, "id int, h string").select("id", S_FILES.decode_replace(F.unhex("h")).alias("text")))

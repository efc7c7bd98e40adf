"""Model evaluation: answer checks as Columns, the summary, training-log analytics, decoding filters."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from .shared import bounded_batches

# Phrases that count as declining to answer.
REFUSALS = ("do not know", "don't know", "cannot", "can not", "not able", "no access", "not confident", "would rather not", "do not remember", "לא יודע", "אין לי", "לא יכול", "לא בטוח", "מעדיף לא")
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
_WORD = r"[\p{L}\p{N}_]"


def mentions_number(value: Column, text: Column) -> Column:
    """Whether a number in the text equals the value, separators aside."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.coalesce(F.exists(found, lambda x: F.coalesce(F.abs(F.replace(x, F.lit(","), F.lit("")).try_cast("double") - value.try_cast("double")) < 1e-6, F.lit(False))), F.lit(False))


def marker_match(marker: Column, text: Column) -> Column:
    """A phrase is contained; a single word stands between word boundaries. ``text`` is lower case."""
    m = F.lower(strip(marker))
    bounded = F.concat(F.lit(rf"(?<!{_WORD})\Q"), m, F.lit(rf"\E(?!{_WORD})"))
    return F.when(m == "", F.lit(False)).when(F.contains(m, F.lit(" ")), F.contains(text, m)).otherwise(F.regexp_like(text, bounded))


def dominant_script(text: Column) -> Column:
    """he or en by letters; null under three of them; he only where it leads."""
    hebrew, latin = F.regexp_count(text, F.lit(r"[\x{0590}-\x{05FF}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    either = F.when(hebrew + latin < 3, F.lit(None)).when(hebrew > latin, "he").otherwise("en")
    # Without Hebrew three letters tell, so only texts that have some are counted.
    return F.when(text.rlike(r"[\x{0590}-\x{05FF}]"), either).when(~text.rlike("[A-Za-z](?:[^A-Za-z]*+[A-Za-z]){2}"), F.lit(None)).otherwise("en")


def _repeats(texts: pa.Array) -> pa.Array:
    """``degenerate`` of lower-case texts, a batch at once: words, keys and phrases are numbered, so equal
    ones are found among integers.  Arrow's white space is ``SPACE``; a blank text counts as one word."""

    def numbered(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1]

    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    row, coded = np.repeat(np.arange(len(lists)), size), lists.flatten().dictionary_encode()
    word, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    keys = pc.utf8_trim(coded.dictionary, characters=".,!?;:\"'").dictionary_encode()
    key, named = keys.indices.to_numpy()[word], pc.not_equal(keys.dictionary, "").to_numpy(zero_copy_only=False)[keys.indices.to_numpy()][word]
    most = np.zeros(len(lists), np.int64)
    of, count = np.unique((row * distinct + key)[named], return_counts=True)
    np.maximum.at(most, of // max(distinct, 1), count)
    # A row's words, pairs and phrases in turn; a number is below the batch's words, so products fit.
    pair = numbered(numbered(row * distinct + word)[:-1] * distinct + word[1:])
    inside = row[2:] == row[:-2]
    _, first, count = np.unique((pair[:-1] * distinct + word[2:])[inside], return_index=True, return_counts=True)
    thrice = np.zeros(len(lists), bool)
    thrice[row[:-2][inside][first[count >= 3]]] = True
    return pa.array((size >= 6) & ((most / np.maximum(size, 1) > 0.4) | thrice), mask=lists.is_null().to_numpy(zero_copy_only=False))


def degenerate(text: Column) -> Column:
    """Six words or more of which one makes over 40 %, or a 3- to 5-word phrase that comes three times.

    The first three words of a longer phrase come as often as it does, so phrases of three tell."""
    return F.arrow_udf(_repeats, "boolean")(F.lower(text))


def refuses(text: Column) -> Column:
    # The one-element array binds the lower-case text, so it is made once.
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, (F.contains(low, F.lit(m)) for m in REFUSALS)))


def judged(df: DataFrame, execute=None) -> DataFrame:
    """Cases with predictions: prompt, expects_tool, expected_value, expects_refusal, relevant_if,
    answer, called, tool_result, tool_error, error.  Adds every check; null where it can't be scored."""
    bounded_batches(df.sparkSession)
    answer = F.coalesce("answer", F.lit(""))
    has_call, blank = F.col("called").isNotNull(), ~answer.rlike(rf"[^{SPACE}]")
    low = F.lower(answer)
    wants, value = F.col("expects_tool").isNotNull(), F.col("expected_value")
    engaged = (
        F.when(F.size("relevant_if") > 0, F.exists("relevant_if", lambda m: marker_match(m, low)))
        .when(F.col("expects_refusal"), refuses(answer))
        .when(value.isNotNull(), F.regexp_like(answer, F.lit(NUMBER)))
        .otherwise(has_call)
    )
    return df.select(
        "*",
        (F.col("error").isNull() & (~blank | has_call) & ~F.contains(answer, F.lit("<|"))).alias("format_ok"),
        (has_call == wants).alias("routing_ok"),
        F.when(wants, F.coalesce(F.col("called") == F.col("expects_tool"), F.lit(False))).alias("tool_name_ok"),
        F.when(wants, F.coalesce(has_call & value.isNotNull() & ~F.col("tool_error") & mentions_number(value, F.col("tool_result")), F.lit(False))).alias("arguments_ok"),
        F.when(value.isNotNull(), mentions_number(value, answer)).alias("answer_ok"),
        F.when(F.col("expects_refusal"), refuses(answer)).alias("refusal_ok"),
        F.when(~blank | has_call, engaged).alias("relevant"),
        (dominant_script(F.col("prompt")) == dominant_script(answer)).alias("language_ok"),
        F.when(~blank, ~degenerate(answer)).alias("coherent"),
    )


CHECKS = ("format_ok", "routing_ok", "tool_name_ok", "arguments_ok", "answer_ok", "refusal_ok", "relevant", "language_ok", "coherent")


def summary(checked: DataFrame) -> DataFrame:
    """One row of percentages over the rows that can be scored, 0.0 where none can. All rows in error
    are no measurement, so that raises."""
    if checked.agg((F.count("*") > 0) & (F.count("error") == F.count("*"))).first()[0]:
        raise RuntimeError("every case failed, so nothing was measured")
    percent = lambda c: F.round(F.coalesce(F.try_divide(100.0 * F.sum(F.col(c).cast("int")), F.count(c)), F.lit(0.0)), 1).alias(f"{c}_pct")
    return checked.agg(F.count("*").alias("cases"), *map(percent, CHECKS))


# Training logs: rows of two kinds, told apart by their nulls.
LOG_SCHEMA = "step long, train_loss double, lr double, grad_norm double, tokens long, tokens_per_second double, elapsed_seconds double, val_loss double, val_perplexity double"


def curve_points(log: DataFrame) -> DataFrame:
    return log.where(F.col("val_loss").isNotNull()).select("step", "val_loss")


def held_out_loss(batches: DataFrame, batch: str = "batch_id", loss: str = "loss") -> DataFrame:
    """Mean of batch means and its perplexity, the loss held at 20 for it."""
    means = batches.groupBy(batch).agg(F.avg(loss).alias("m"))
    return means.agg(F.avg("m").alias("loss")).withColumn("perplexity", F.exp(F.least(F.lit(20.0), F.col("loss"))))


def bits_per_byte(loss: Column, n_bytes: Column, n_tokens: Column) -> Column:
    return loss / math.log(2) / (n_bytes / n_tokens)


def status(log: DataFrame, goal_steps: int, tokens_per_step: int = 8192) -> DataFrame:
    """Progress, first, last and least validation loss, and whether the last is 0.05 above the least."""
    at = F.when(F.col("val_loss").isNotNull(), F.col("step"))
    out = log.agg(F.max("step").alias("step"), F.min_by("val_loss", at).alias("first_loss"), F.max_by("val_loss", at).alias("last_loss"), F.min("val_loss").alias("least_loss"))
    return out.select("step", (F.col("step") * tokens_per_step).alias("tokens"), F.round(100.0 * F.col("step") / goal_steps, 1).alias("percent"), "first_loss", "last_loss", "least_loss", (F.col("last_loss") > F.col("least_loss") + 0.05).alias("rising"))


def throughput(log: DataFrame, goal_tokens: int, window: int = 10, block: int = 10_000) -> DataFrame:
    """Tokens a second of each window of steps, and the seconds left at that speed.

    Windows are looked up side by side in blocks; a block's first one follows the last of the block before.
    The blocks' rows go out as a broadcast only where Spark finds them small."""
    rows = log.groupBy(F.floor((F.col("step") - 1) / window).alias("window")).agg(F.max("step").alias("step"), F.max("tokens").alias("tokens"), F.max("elapsed_seconds").alias("elapsed"))
    rows = rows.withColumn("_b", F.floor(F.col("window") / block)).withColumn("_now", F.struct("tokens", "elapsed"))
    lasts = rows.groupBy("_b").agg(F.max_by("_now", "window").alias("_last")).select("_b", F.lag("_last").over(Window.orderBy("_b")).alias("_last"))
    rows = rows.join(lasts, "_b").withColumn("_last", F.coalesce(F.lag("_now").over(Window.partitionBy("_b").orderBy("window")), "_last"))
    speed = F.try_divide(F.col("tokens") - F.coalesce("_last.tokens", F.lit(0)), F.col("elapsed") - F.coalesce("_last.elapsed", F.lit(0.0)))
    return rows.withColumn("tokens_per_second", speed).withColumn("eta_seconds", F.try_divide(F.lit(goal_tokens) - F.col("tokens"), "tokens_per_second")).drop("_b", "_now", "_last")


def best_checkpoints(log: DataFrame, block: int = 100_000) -> DataFrame:
    """Steps at which the validation loss fell below all before.

    Blocks of steps are looked at side by side, each with the least loss of all blocks before it.
    The blocks' rows go out as a broadcast only where Spark finds them small."""
    points = curve_points(log).withColumn("_k", F.floor(F.col("step") / block))
    past = Window.rowsBetween(Window.unboundedPreceding, -1)
    least = points.groupBy("_k").agg(F.min("val_loss").alias("_m")).select("_k", F.min("_m").over(past.orderBy("_k")).alias("_m"))
    before = F.least("_m", F.min("val_loss").over(past.partitionBy("_k").orderBy("step")))
    return points.join(least, "_k").withColumn("_b", before).where(F.col("_b").isNull() | (F.col("val_loss") < F.col("_b"))).select("step", "val_loss")


def best_finetune(rows: DataFrame) -> DataFrame:
    """The epoch with the best routing; of equals the one with the least loss."""
    return rows.agg(F.max_by("epoch", F.struct("routing", -F.col("loss"))).alias("epoch"))


# Decoding filters over rows (row_id, token, logit).
def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Logits at least as large as the k-th; ties stay."""
    return logits.withColumn("_r", F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("logit")))).where(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    by_row = Window.partitionBy("row_id")
    e = F.exp((F.col("logit") - F.max("logit").over(by_row)) / temperature)
    return logits.withColumn("_e", e).withColumn("prob", F.col("_e") / F.sum("_e").over(by_row)).drop("_e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Tokens whose probability mass before them is at most p; the best always stays."""
    before = F.coalesce(F.sum("prob").over(Window.partitionBy("row_id").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return softmax(logits).withColumn("_b", before).where(F.col("_b") <= p).drop("_b", "prob")


def repetition_penalty(logits: DataFrame, seen: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens already seen: positive ones divided, others multiplied."""
    joined = logits.join(seen.select("row_id", "token").distinct().withColumn("_s", F.lit(True)), ["row_id", "token"], "left")
    x = F.col("logit")
    return joined.withColumn("logit", F.when(F.col("_s").isNull(), x).when(x > 0, x / penalty).otherwise(x * penalty)).drop("_s")


def greedy(logits: DataFrame) -> DataFrame:
    """The best token of each row; the smallest of equals."""
    return logits.groupBy("row_id").agg(F.max_by("token", F.struct("logit", -F.col("token"))).alias("token"))


def sample(logits: DataFrame, temperature: float, seed: int) -> DataFrame:
    """One token of each row, drawn by Gumbel noise from a hash, so reruns agree; greedy at 0."""
    if temperature <= 0:
        return greedy(logits)
    u = (F.pmod(F.xxhash64(F.lit(seed), "row_id", "token"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return greedy(logits.withColumn("logit", F.col("logit") / temperature - F.log(-F.log(u))))


def routing_accuracy(logits: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of rows whose best token is the label."""
    return greedy(logits).withColumnRenamed("token", "best").join(labels, "row_id").agg(F.avg((F.col("best") == F.col("token")).cast("double")).alias("accuracy"))


def truncate_prompt(ids: Column, most: int) -> Column:
    """The last ``most`` ids."""
    return F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)


def learning_rate(step: Column, steps: int, peak: float, warmup: int, least_ratio: float) -> Column:
    """Linear warm-up, then half a cosine down to the least ratio."""
    progress = F.least(F.lit(1.0), (step - warmup) / max(1, steps - warmup))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(peak * (least_ratio + (1 - least_ratio) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress))))


def ff_dim(d_model: Column) -> Column:
    """Feed-forward width: 8/3 of the model's, to the nearest multiple of 64 (halves to even)."""
    return (64 * F.bround(8 * d_model / 3 / 64, 0)).cast("long")


def param_count(vocab: Column, d_model: Column, layers: Column, heads: Column, kv_heads: Column) -> Column:
    """Weights of a decoder with tied embeddings, grouped-query attention and gated feed-forward."""
    kv = (d_model / heads * kv_heads).cast("long")
    attention = 2 * d_model * d_model + 2 * d_model * kv
    return (vocab * d_model + layers * (attention + 3 * d_model * ff_dim(d_model) + 2 * d_model) + d_model).cast("long")


def tokens_for(params: Column, per_param: int = 20) -> Column:
    return params * per_param

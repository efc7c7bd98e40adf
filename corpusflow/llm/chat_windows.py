r"""Chat formatting in budgeted windows, in DataFrame functions only.

Every turn becomes ``<turn>role<say>text</turn>``; control strings and the escape character inside roles and
texts are escaped, so a formatted window can be read back exactly.  A turn's tokens are its words or a quarter
of its bytes, whichever is more, and two for the marks.

Spans: prefix sums of the turns' tokens are cut at multiples of a stride, the budget less the system turn and
the history.  The turns that start in one cell form a span if they fit the stride; if not, the one that runs
over the cell's end is a span of its own.  So a span either fits or is a single longer turn; turns are never cut.
Windows: the system turn (the conversation's first turn, if its role is system), then the turns before the span
that fit the history in tokens and lie within ``history_turns`` turn numbers, then the span.  The loss mask
holds the span's target texts only, so a repeated target is masked and each target counts once.

Long conversations: turns are dealt by (conversation, slice of SLICE_TURNS turn numbers), spans end with their
slice, and a slice's last turns go to the next one as well, as history; the system turn goes to every slice.
So no task holds a whole conversation, and texts are shuffled once.  A slice with more than CROWD rows (turn
numbers that repeat, as those of null conversations may) is dealt in blocks of cells: its rows are counted by turn
number and hash, each gets its place in the slice from these sums, and a block's last turns go to the next one as
history.  So CROWD decides who computes a window and not what is in it.  Rows that are equal in all four columns
are counted in one task.

Defined results: a null text or role is empty; null conversation ids form one conversation; a null turn comes
before all others; rows that share a turn are turns of their own, the system's first, then by hash, role and
text; an empty text has an empty place in the mask; a conversation of a system turn alone is one window; a
window that can't meet the budget (a long turn, a long system turn) says so in ``over_budget``; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored

#: Turn numbers of a conversation that are dealt together, and rows from which such a slice is a crowd.
SLICE_TURNS, CROWD = 256, 8192
#: Bits of the hash by which a crowd's turn number is counted, and cells in a block of a crowd.
CROWD_BITS, CROWD_CELLS = 12, 64
SYSTEM = "system"
_NO_TURN = -(1 << 62)
_CONTEXT, _CARRIED, _OWN = 0, 1, 2


@dataclass(frozen=True)
class Template:
    """Control strings around turns.  The first character of one stands in none but at its start, so that
    text before a control string can't complete another."""

    open: str = "<turn>"
    say: str = "<say>"
    close: str = "</turn>"
    escape: str = "\\"

    def __post_init__(self) -> None:
        names = (self.open, self.say, self.close)
        if len(set(names)) < 3 or any(len(n) < 2 or self.escape in n or n[0] in other[1:] for n in names for other in names) or len(self.escape) != 1:
            raise ValueError("control strings must differ, hold no escape character, and start with a character that they hold once")

    def escaped(self, text: Column) -> Column:
        text = F.replace(text, F.lit(self.escape), F.lit(2 * self.escape))
        for name in (self.open, self.say, self.close):
            text = F.replace(text, F.lit(name), F.lit(name[0] + self.escape + name[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        """The character behind every escape, from left to right."""
        return F.when(F.contains(text, F.lit(self.escape)), F.regexp_replace(text, rf"(?s){re.escape(self.escape)}(.)", "$1")).otherwise(text)

    def head(self, role: Column) -> Column:
        return F.concat(F.lit(self.open), self.escaped(role), F.lit(self.say))

    def turns(self, formatted: Column, repeated: Column) -> Column:
        """role and text of the turns behind the repeated ones, read back."""
        parts = F.split(formatted, re.escape(self.close), -1)
        own = F.slice(parts, repeated + 1, F.greatest(F.size(parts) - 1 - repeated, F.lit(0)))
        role = lambda p: F.replace(F.substring_index(p, self.say, 1), F.lit(self.open), F.lit(""))
        return F.transform(own, lambda p: F.struct(self.unescaped(role(p)).alias("role"), self.unescaped(F.substring_index(p, self.say, -1)).alias("text")))


def turn_tokens(text: Column) -> Column:
    """Words or a quarter of the bytes, and the marks: at least 2, and never far below what the text takes."""
    return F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.ceil(F.octet_length(text) / 4)).cast("long") + 2


def _stride(budget: int, history: int, system_tokens: Column) -> Column:
    return F.greatest(F.lit(budget - history) - system_tokens, F.lit(max(1, budget // 4)))


def _chars(template: Template) -> Column:
    return F.length("head") + F.length("body") + len(template.close)


def _crowds(rows: DataFrame) -> DataFrame | None:
    """_conv, _no of the slices with more than CROWD rows."""
    crowds = stored(rows.groupBy("conv", "no").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(F.col("conv").alias("_conv"), F.col("no").alias("_no")), "crowds")
    return None if crowds.isEmpty() else crowds


def _contexts(rows: DataFrame, crowds: DataFrame | None) -> DataFrame:
    """conv, no, first, several, tokens, head, body for every slice of the conversations that have several, or a
    crowd: whether it is the first, whether there are more, and the system turn, null if there is none."""
    slices = rows.groupBy("conv", "no").agg(F.min("turn").alias("least"))
    every = slices.groupBy(F.col("conv").alias("_conv")).agg((F.count("*") > 1).alias("several"), F.min(F.struct("no", "least")).alias("start"))
    if crowds is None:
        every = every.where("several")
    else:
        crowded = sized(crowds.select(F.col("_conv").alias("_with")).distinct())
        every = every.where("several").unionAll(every.where("NOT several").join(crowded, F.col("_conv").eqNullSafe(F.col("_with")), "left_semi"))
    same = F.col("conv").eqNullSafe(F.col("_conv"))
    at_start = same & (F.col("no") == F.col("start.no")) & (F.col("turn") == F.col("start.least"))
    systems = rows.where(F.col("role") == SYSTEM).join(every, at_start).groupBy("_conv").agg(F.min(F.struct("turn", "hash", "head", "body", "tokens")).alias("system"))
    systems = systems.withColumnRenamed("_conv", "_of")
    found = slices.join(every, same).join(systems, F.col("conv").eqNullSafe(F.col("_of")), "left")
    return found.select("conv", "no", (F.col("no") == F.col("start.no")).alias("first"), "several", "system.tokens", "system.head", "system.body")


def _placed(rows: DataFrame, template: Template) -> DataFrame:
    """Adds start, chars_start and place, sums over the rows before it in its slice (place counts the row
    itself), and total, the slice's tokens: counted by turn number and hash first, then inside these bins."""
    rows = rows.withColumns({"chars": _chars(template), "late": F.col("role") != SYSTEM, "bin": F.shiftright("hash", 64 - CROWD_BITS)})
    key = ["conv", "no", "turn", "late", "bin"]
    slice_ = Window.partitionBy("conv", "no")
    before = slice_.orderBy("turn", "late", "bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key).orderBy("hash", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    past = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in key), *(past(c, before).alias(f"_before_{c}") for c in ("tokens", "chars", "n")), F.sum("tokens").over(slice_).alias("total"))
    rows = rows.withColumns({"start": past("tokens", inside), "chars_start": past("chars", inside), "place": past(F.lit(1), inside) + 1})
    joined = rows.join(sums, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    joined = joined.withColumns({"start": F.col("start") + F.col("_before_tokens"), "chars_start": F.col("chars_start") + F.col("_before_chars"), "place": F.col("place") + F.col("_before_n")})
    return joined.drop("chars", "late", "bin", *(f"_{k}" for k in key), "_before_tokens", "_before_chars", "_before_n")


def _dealt(no: Column, part: Column, kind: int, start: Column) -> Column:
    """One place that a row goes to: a slice, or a crowd's block of one."""
    return F.struct(F.struct(no.cast("long").alias("no"), part.cast("long").alias("part")).alias("slice"), F.lit(kind).alias("kind"), start.cast("long").alias("start"))


def _deal(rows: DataFrame, budget: int, history: int, history_turns: int, template: Template) -> tuple[DataFrame, DataFrame]:
    """(rows where they are needed: their own slice or block, and the next one, for whose history they may
    count; contexts of slices and blocks).  A crowd's rows know their places, all others' are null."""
    crowds, unknown = _crowds(rows), F.lit(None).cast("long")
    contexts = _contexts(rows, crowds)
    edge = F.pmod("turn", F.lit(SLICE_TURNS)) >= SLICE_TURNS - history_turns
    following = F.lit(None)
    if crowds is not None:
        crowds = sized(crowds)
        behind = crowds.select(F.col("_conv").alias("_conv2"), (F.col("_no") - 1).alias("_no2"))
        rows = rows.join(crowds, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("no") == F.col("_no")), "left")
        rows = rows.join(behind, F.col("conv").eqNullSafe(F.col("_conv2")) & (F.col("no") == F.col("_no2")), "left")
        rows = rows.withColumns({"crowded": F.col("_no").isNotNull(), "following": F.when(F.col("_no2").isNotNull(), F.lit(0))}).drop("_conv", "_no", "_conv2", "_no2")
        following = F.col("following")
    own = _dealt(F.col("no"), F.lit(None), _OWN, unknown)
    places = F.when(edge, F.array(own, _dealt(F.col("no") + 1, following, _CARRIED, unknown))).otherwise(F.array(own))
    plain = rows if crowds is None else rows.where("NOT crowded").drop("crowded")
    plain = plain.withColumns({"chars_start": unknown, "place": unknown}).select("*", F.inline(places))
    here = contexts.withColumn("slice", _dealt(F.col("no"), F.lit(None), _CONTEXT, unknown)["slice"])
    if crowds is None:
        return plain, here
    own_stride = contexts.select(F.col("conv").alias("_conv"), F.col("no").alias("_no"), _stride(budget, history, F.coalesce("tokens", F.lit(0))).alias("stride"))
    of = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("no") == F.col("_no"))
    crowd = _placed(rows.where("crowded").drop("crowded"), template).join(own_stride, of).drop("_conv", "_no")
    crowd = stored(crowd.withColumn("part", F.floor(F.floor(F.col("start") / F.col("stride")) / CROWD_CELLS)), "crowd-places")
    ends = (F.col("part") + 1) * CROWD_CELLS * F.col("stride")
    to_next = F.when(F.col("start") >= ends - history, _dealt(F.col("no"), F.col("part") + 1, _CARRIED, F.col("start")))
    left = F.col("start") - F.col("total")
    beyond = F.when(edge & (left >= -history), _dealt(F.col("no") + 1, following, _CARRIED, left))
    crowd = crowd.withColumn("places", F.array_compact(F.array(_dealt(F.col("no"), F.col("part"), _OWN, F.col("start")), to_next, beyond)))
    blocks = crowd.select(F.col("conv").alias("_conv"), F.col("no").alias("_no"), "part").distinct()
    parted = contexts.join(blocks, of).withColumn("slice", _dealt(F.col("no"), F.col("part"), _CONTEXT, unknown)["slice"])
    crowd = crowd.select(*(c for c in plain.columns if c not in ("slice", "kind", "start")), F.inline("places"))
    return plain.unionByName(crowd), here.unionByName(parted.select(*here.columns))


def formatted_windows(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 256, history_turns: int = 4, targets: tuple[str, ...] = ("assistant",), template: Template = Template()) -> DataFrame:
    """One row for each window: conv_id, slice (of turn numbers) and start (their order), several (the conversation has more
    slices), first_turn, last_turn, n_turns, repeated (turns in front that were there before), tokens,
    over_budget, formatted, and loss: start and length of every target, in code points of ``formatted``."""
    if not 0 <= history < budget or not 0 <= history_turns < SLICE_TURNS:
        raise ValueError("the history must leave room in the budget and in a slice")
    said = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(conv_id).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(_NO_TURN)).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), said.alias("said"))
    rows = rows.select("conv", "turn", "role", F.floor(F.col("turn") / SLICE_TURNS).alias("no"), F.xxhash64("role", "said").alias("hash"), turn_tokens(F.col("said")).alias("tokens"), template.head(F.col("role")).alias("head"), template.escaped(F.col("said")).alias("body"))
    rows, contexts = _deal(rows, budget, history, history_turns, template)
    named = [F.col("role").isin(*targets).alias("target"), (F.col("role") == SYSTEM).alias("system")]
    unknown = F.lit(None).cast("long")
    rows = rows.select("conv", "slice", "kind", "turn", "hash", "tokens", "head", "body", *named, "start", "chars_start", "place").withColumns({"first": F.lit(None).cast("boolean"), "several": F.lit(None).cast("boolean")})
    contexts = contexts.select("conv", "slice", "first", "several", "tokens", "head", "body").withColumns({"kind": F.lit(_CONTEXT), "turn": unknown, "hash": F.lit(0).cast("long"), "target": F.lit(False), "system": F.lit(False), "start": unknown, "chars_start": unknown, "place": unknown})
    return _windows(rows.unionByName(contexts), budget, history, history_turns, template).withColumnRenamed("conv", conv_id)


def _windows(dealt: DataFrame, budget: int, history: int, history_turns: int, template: Template) -> DataFrame:
    """Everything here is by (conv, slice or block): one shuffle, however many windows and sums."""
    group = Window.partitionBy("conv", "slice")
    ordered = group.orderBy("kind", "turn", F.col("system").desc(), "hash", "head", "body")
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own, turns = F.col("kind") == _OWN, F.col("kind") >= _CARRIED
    chars = _chars(template)
    t = dealt.withColumns({"run": F.sum(F.when(turns, F.col("tokens"))).over(running), "chars_run": F.sum(F.when(own, chars)).over(running), "place": F.coalesce("place", F.sum(F.when(own, 1)).over(running))})
    t = t.withColumns({"carried": F.coalesce(F.sum(F.when(F.col("kind") == _CARRIED, F.col("tokens"))).over(group), F.lit(0)), "several": F.coalesce(F.max("several").over(group), F.lit(False)), "first": F.coalesce(F.max("first").over(group), F.lit(True))})
    # Places count from the slice's first own turn; what is carried lies before it.
    t = t.withColumns({"start": F.coalesce("start", F.col("run") - F.col("tokens") - F.col("carried")), "chars_start": F.coalesce("chars_start", F.col("chars_run") - chars)})
    t = t.withColumn("end", F.col("start") + F.col("tokens"))
    t = t.withColumn("is_system", own & F.col("system") & (F.col("place") == 1) & F.col("first"))
    t = t.withColumn("system_tokens", F.coalesce(F.max(F.when(F.col("is_system") | (F.col("kind") == _CONTEXT), F.col("tokens"))).over(group), F.lit(0)))
    t = t.withColumn("stride", _stride(budget, history, F.col("system_tokens")))
    t = t.withColumn("cell", F.when(own, F.floor(F.col("start") / F.col("stride"))))
    cell = Window.partitionBy("conv", "slice", "cell")
    t = t.withColumns({"cell_start": F.min("start").over(cell), "cell_end": F.max("end").over(cell)})
    alone = (F.col("cell_end") - F.col("cell_start") > F.col("stride")) & (F.col("end") == F.col("cell_end"))
    t = t.withColumn("span", F.when(own, F.when(alone, F.col("start")).otherwise(F.col("cell_start"))))

    leads = own & (F.col("span") == F.col("start"))
    before = group.orderBy("start").rangeBetween(-history, -1)
    past = F.collect_list(F.when(turns & ~F.col("is_system"), F.struct("start", "turn", "tokens", "head", "body"))).over(before)
    system = F.max(F.when(F.col("is_system") | (F.col("kind") == _CONTEXT) & F.col("head").isNotNull(), F.struct("tokens", "head", "body"))).over(group)
    t = t.withColumns({"past": past, "retained": system}).where(own)
    t = t.withColumns({"past": F.when(leads, F.col("past")), "retained": F.when(leads & ~F.col("is_system"), F.col("retained"))})
    pieces = F.sort_array(F.collect_list(F.struct("start", "chars_start", "head", "body", "target")))
    spans = t.groupBy("conv", "slice", "span").agg(pieces.alias("own"), F.first("past", ignorenulls=True).alias("past"), F.first("retained", ignorenulls=True).alias("retained"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum("tokens").alias("own_tokens"), F.first("several").alias("several"))

    near = F.filter("past", lambda x: x["turn"] >= F.col("first_turn") - history_turns)
    kept = F.when(F.col("retained").isNotNull(), F.array("retained")).otherwise(F.array().cast("array<struct<tokens:bigint,head:string,body:string>>"))
    spans = spans.withColumn("context", F.concat(kept, F.transform(near, lambda x: F.struct(x["tokens"], x["head"], x["body"]))))
    whole = lambda pieces: F.array_join(F.transform(pieces, lambda x: F.concat(x["head"], x["body"], F.lit(template.close))), "")
    spans = spans.withColumn("front", whole(F.col("context")))
    shift = F.length("front") - F.col("own")[0]["chars_start"]
    loss = F.transform(F.filter("own", lambda x: x["target"]), lambda x: F.struct((shift + x["chars_start"] + F.length(x["head"])).cast("long").alias("start"), F.length(x["body"]).cast("long").alias("length")))
    tokens = F.col("own_tokens") + F.aggregate("context", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    known = lambda c: F.when(F.col(c) != _NO_TURN, F.col(c)).alias(c)
    return spans.select("conv", F.col("slice.no").alias("slice"), F.col("span").alias("start"), "several", known("first_turn"), known("last_turn"), F.size("own").alias("n_turns"), F.size("context").alias("repeated"), tokens.alias("tokens"), (tokens > budget).alias("over_budget"), F.concat("front", whole(F.col("own"))).alias("formatted"), loss.alias("loss"))


def conversations_read_back(windows: DataFrame, conv_id: str = "conv_id", template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted windows and
    their masks alone.  A conversation of one slice is digested where it lies; only the others' texts meet again."""
    target = lambda x: template.unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))
    read = windows.select(conv_id, "slice", "start", "several", F.length("formatted").alias("chars"), template.turns(F.col("formatted"), F.col("repeated")).alias("turns"), F.array_join(F.transform("loss", target), "").alias("lost"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumns({"lines": lines, "n": F.size("turns").cast("long")})

    def joined(parts: Column, name: str) -> Column:
        return F.array_join(F.transform(F.sort_array(parts), lambda x: x[name]), "")

    def sha256(column: Column) -> Column:
        return F.sha2(column.cast("binary"), 256)

    each = read.groupBy(conv_id, "slice").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.first("several").alias("several"), F.collect_list(F.struct("start", "lines", "lost")).alias("parts"))
    each = each.withColumns({"lines": joined(F.col("parts"), "lines"), "lost": joined(F.col("parts"), "lost")}).drop("parts")
    alone = ~F.col("several")
    each = each.withColumns({"own_turns": F.when(alone, sha256(F.col("lines"))), "own_loss": F.when(alone, sha256(F.col("lost"))), "loss_chars": F.length("lost"), "part": F.when(F.col("several"), F.struct("slice", "lines", "lost"))})
    all_of = each.groupBy(conv_id).agg(F.sum("n").alias("n_turns"), F.first("own_turns", ignorenulls=True).alias("own_turns"), F.sum("loss_chars").alias("loss_chars"), F.first("own_loss", ignorenulls=True).alias("own_loss"), F.sum("chars").alias("formatted_chars"), F.collect_list("part").alias("parts"))
    digest = lambda own, name: F.coalesce(own, sha256(joined(F.col("parts"), name)))
    return all_of.select(conv_id, "n_turns", digest("own_turns", "lines").alias("turns_sha256"), "loss_chars", digest("own_loss", "lost").alias("loss_sha256"), "formatted_chars")


def op12_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings."""
    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(probe)
    return conversations_read_back(formatted_windows(rows))


#: The same windows over rows whose turn numbers don't repeat: positions are summed over a whole conversation here.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, turn // 256 AS slice, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), CAST(ceil(strlen(text) / 4) AS BIGINT)) + 2 AS tokens,
  length(replace(replace(replace(replace(role || chr(0) || text, '\', '\\'), '<turn>', '<\turn>'), '<say>', '<\say>'), '</turn>', '<\/turn>')) - 1 + length('<turn><say></turn>') AS chars,
  role = 'system' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS retained FROM c),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) - tokens AS place, sum(tokens) OVER (PARTITION BY conv_id, slice ORDER BY turn) - tokens AS start,
  coalesce(max(CASE WHEN retained THEN tokens END) OVER (PARTITION BY conv_id), 0) AS system_tokens, coalesce(max(CASE WHEN retained THEN chars END) OVER (PARTITION BY conv_id), 0) AS system_chars FROM e),
d AS (SELECT *, greatest(1024 - 256 - system_tokens, 256) AS stride FROM s),
l AS (SELECT *, min(start) OVER w AS cell_start, max(start + tokens) OVER w AS cell_end FROM (SELECT *, start // stride AS cell FROM d) WINDOW w AS (PARTITION BY conv_id, slice, cell)),
p AS (SELECT *, CASE WHEN cell_end - cell_start > stride AND start + tokens = cell_end THEN start ELSE cell_start END AS span FROM l),
o AS (SELECT conv_id, slice, span, min(turn) AS first_turn, min(place) AS place, sum(chars) + CASE WHEN bool_or(retained) THEN 0 ELSE max(system_chars) END AS chars FROM p GROUP BY 1, 2, 3),
h AS (SELECT o.conv_id, sum(p.chars) AS chars FROM o JOIN p ON o.conv_id = p.conv_id AND p.turn < o.first_turn AND p.turn >= o.first_turn - 4 AND o.place - p.place <= 256 AND NOT p.retained GROUP BY 1),
f AS (SELECT conv_id, sum(chars) AS chars FROM (SELECT conv_id, chars FROM o UNION ALL SELECT conv_id, chars FROM h) GROUP BY 1),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM c GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(f.chars AS BIGINT) AS formatted_chars FROM g JOIN f USING (conv_id)
"""

r"""Fill-in-the-middle by escaped marker injection, in column functions: no shuffle, no Python worker.

A delimiter is escaped in the text, regexp_replace appends it after every unit (by default a line), the
delimiters are counted, substring_index takes the units up to a rank, after one, or between two, and the
parts are unescaped and assembled around the markers.  Every step is linear in the text, and no array of
units is built.

A document's draws are the first four 8-digit groups of the hex SHA-256 of ``seed:doc_id``.  Two of them cut
the text at unit ranks 0 to n, the third decides whether it stays plain, the fourth the order of the parts.

Defined results: a null text is empty, and an empty text or one that holds a marker stays plain (markers found
later are then always ours); a null id draws as ``seed:``; rows that repeat get the same result each; what
lies between units belongs to the unit that follows; a text of any length is handled in its row, up to the
2 GB of a Spark string; an empty table gives an empty result.  Columns to keep travel under their own names,
and a name that the result uses itself is refused; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
#: The delimiter that ends a unit, and the character that escapes it and itself in texts.
CUT, ESCAPE = "\x1f", "\x1b"
PLAIN, PSM, SPM = "plain", "psm", "spm"
OWN = ("doc_id", "text", "n_units", "form", "prefix", "middle", "suffix", "output")


@dataclass(frozen=True)
class Markers:
    """What stands before each part.  No marker may start inside another, so that one can't arise where a
    part meets a marker."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        all_three = (self.prefix, self.suffix, self.middle)
        if not all(all_three) or len(set(all_three)) < 3 or any(m[0] in other[1:] for m in all_three for other in all_three):
            raise ValueError("markers must differ, and the first character of one may stand in none but at its start")

    def held_by(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(CUT), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``, after the delimiters between units have been taken out."""
    joined = F.replace(text, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(joined, F.lit(ESCAPE + "1"), F.lit(CUT)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _ranked(marked: Column, rank: Column) -> Column:
    """Up to the delimiter of that rank; after it for a negative one, counted from the end."""
    return F.call_function("substring_index", marked, F.lit(CUT), rank.cast("int"))


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = LINES, seed: str = "7", markers: Markers = Markers(), fim_percent: int = 100, spm_percent: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, doc_id, text, n_units, form, prefix, middle, suffix and output.

    The three parts are null in a plain row, whose output is its text."""
    if clash := sorted(set(keep) & set(OWN)):
        raise ValueError(f"columns {clash} can't be kept: the result has its own")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)

    def draw(k: int) -> Column:
        return F.conv(F.substring("_name", 8 * k + 1, 8), 16, 10).cast("long")

    rows = df.select(F.struct(*keep, F.lit(0).alias("")).alias("_kept"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), name.alias("_name"))
    rows = rows.withColumn("_marked", F.regexp_replace(escaped(F.col("text")), unit, "$0" + CUT))
    rows = rows.withColumn("n_units", (F.octet_length("_marked") - F.octet_length(F.replace("_marked", F.lit(CUT), F.lit("")))).cast("long"))
    places = F.col("n_units") + 1
    rows = rows.withColumn("_a", F.least(draw(0) % places, draw(1) % places)).withColumn("_b", F.greatest(draw(0) % places, draw(1) % places))
    plain = (F.col("text") == "") | markers.held_by(F.col("text")) | (draw(2) % 100 >= fim_percent)
    rows = rows.withColumn("form", F.when(plain, PLAIN).when(draw(3) % 100 < spm_percent, SPM).otherwise(PSM))
    up_to_b = _ranked(F.col("_marked"), F.col("_b"))
    parts = {
        "prefix": _ranked(F.col("_marked"), F.col("_a")),
        # Of b units, joined by b - 1 delimiters, the last b - a.
        "middle": _ranked(up_to_b, F.col("_a") - F.col("_b")),
        "suffix": _ranked(F.col("_marked"), F.col("_b") - F.col("n_units") - 1),
    }
    rows = rows.withColumns({k: F.when(F.col("form") != PLAIN, unescaped(v)) for k, v in parts.items()})
    p, s, m = (F.concat(F.lit(getattr(markers, k)), F.col(k)) for k in ("prefix", "suffix", "middle"))
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, F.concat(p, s, m)).otherwise(F.concat(s, p, m))
    return rows.withColumn("output", output).select(*(F.col("_kept")[k].alias(k) for k in keep), *OWN)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text, from an output and its form alone."""

    def between(before: str, after: str) -> Column:
        return F.substring_index(F.substring_index(output, before, -1), after, 1)

    middle = F.substring_index(output, markers.middle, -1)
    psm = F.concat(between(markers.prefix, markers.suffix), middle, between(markers.suffix, markers.middle))
    spm = F.concat(between(markers.prefix, markers.middle), middle, between(markers.suffix, markers.prefix))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def digest(column: Column) -> Column:
        return F.sha2(column.cast("binary"), 256)

    chars = [F.length(k).cast("long").alias(f"{k}_chars") for k in ("prefix", "middle")]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", *chars, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS name FROM documents),
h AS (SELECT *, len(lines) AS n, CAST('0x' || substring(name, 1, 8) AS BIGINT) AS h1, CAST('0x' || substring(name, 9, 8) AS BIGINT) AS h2, CAST('0x' || substring(name, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(lines[1:a], '') AS pre, array_to_string(lines[a + 1:b], '') AS mid, array_to_string(lines[b + 1:n], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

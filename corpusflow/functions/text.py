"""Text cleaning as Column expressions, so that it stays in generated code.

``space`` is the class of white space that Python's ``str.strip`` and ``\\s`` use.  Line anchors take
``(?md)``: only a line feed ends a line.  Two steps have no built-in form and use Arrow UDFs, each
behind a plain test that most rows pass: Unicode NFC and HTML entities.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The marker lines, credit lead-ins and footer sentence of the sources' files.
BOOK_START = r"\*\*\* ?START OF TH[EIS]+ PROJECT GUTENBERG EBOOK.*?\*\*\*"
BOOK_END = r"\*\*\* ?END OF TH[EIS]+ PROJECT GUTENBERG EBOOK.*?\*\*\*"
CREDIT_LEADS = r"(?:Produced by|E-?text prepared by|Transcribed from|Executive Director's Notes)"
HEBREW_FOOTER = "את הטקסט[ים] לעיל הפיקו מתנדבי פרויקט בן־יהודה"
FOOTNOTE_ARROW = "[↩⏎]︎?️?"


def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC. Only texts with a character from U+0300 on can change, so only they go to Python."""
    changing = F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), text)
    return F.coalesce(F.pandas_udf(_nfc, "string")(changing), text)


def html_unescape(text: Column) -> Column:
    """HTML5 entities become characters; texts without an ampersand stay in the JVM."""
    return F.coalesce(F.pandas_udf(_unescape, "string")(F.when(F.contains(text, F.lit("&")), text)), text)


def newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trailing_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)[ \t]+$", "")


def blank_runs(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def generic(text: Column) -> Column:
    """What every cleaner ends in: NFC, line ends, trailing blanks, blank lines, strip."""
    return strip(blank_runs(trailing_space(newlines(nfc(text)))))


def bracket_titles(text: Column) -> Column:
    """Lines that are one short bracketed title go."""
    return F.regexp_replace(text, rf"(?md)^\[[^\]\n]{{0,120}}\][{SPACE}]*$", "")


def book_markers(text: Column) -> Column:
    """Only what lies between the first start marker and the first end marker after it stays."""
    body = F.regexp_replace(text, rf"(?s)\A.*?{BOOK_START}", "")
    return F.regexp_replace(body, rf"(?s){BOOK_END}.*\z", "")


def credit_paragraphs(text: Column) -> Column:
    """Production credits go, each up to the blank line that ends it."""
    return F.regexp_replace(text, rf"(?msd)^[ \t]*{CREDIT_LEADS}\b.*?(?:\n[ \t]*\n|\z)", "")


def tag_lines(text: Column) -> Column:
    """Lines that are one SGML tag go."""
    return F.regexp_replace(text, rf"(?md)^<[^>\n]*>[{SPACE}]*$", "")


def untag_words(text: Column) -> Column:
    """Part-of-speech-tagged text as plain text: tags off, quotes paired, spaces set as in print."""

    # Over the whole text, as a function for each word of each line would run outside generated code.
    blank = rf"[{SPACE}&&[^\n]]"
    bare = F.regexp_replace(text, rf"/[^/{SPACE}]++(?![^{SPACE}])", "")
    bare = F.regexp_replace(bare, rf"``(?<![^{SPACE}]``)(?![^{SPACE}])", "\x01")
    bare = F.regexp_replace(bare, rf"''(?<![^{SPACE}]'')(?![^{SPACE}])", "\x02")
    lines = F.regexp_replace(F.regexp_replace(bare, rf"{blank}+", " "), " ?\n ?", "\n")
    joined = F.btrim(lines, F.lit(" "))
    # No other blanks are left.
    joined = F.regexp_replace(joined, "[ \\n]*\x01[ \\n]*", ' "')
    joined = F.regexp_replace(joined, "[ \\n]*\x02[ \\n]*", '" ')
    joined = F.regexp_replace(joined, r"[ \n]+([.,;:!?%)\]}])", "$1")
    return F.regexp_replace(joined, r"([(\[{])[ \n]+", "$1")


def credit_footer(text: Column) -> Column:
    """The volunteers' footer and all behind it go."""
    return F.regexp_replace(text, rf"(?s)\Q{HEBREW_FOOTER}\E.*", "")


def footnote_arrows(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, FOOTNOTE_ARROW, ""), F.lit("\xa0"), F.lit(" "))


#: What each cleaner does before what all of them end in; a second part follows decoded entities.
CLEANERS = {
    "generic": (lambda t: t, None),
    "gutenberg": (lambda t: book_markers(bracket_titles(t)), None),
    "gutenberg_extended": (lambda t: credit_paragraphs(book_markers(t)), None),
    "brown": (lambda t: untag_words(t), None),
    "europarl": (lambda t: tag_lines(t), None),
    "benyehuda": (lambda t: credit_footer(t), footnote_arrows),
}


def clean_by(df: DataFrame, cleaner: str, text: str) -> DataFrame:
    """Clean ``text`` by the cleaner that column ``cleaner`` names; unknown or null names take generic.

    One scan: a row takes its cleaner's branch in the JVM, and each Python step stands outside the branches
    and gets null for the rows that don't need it."""
    name, begun = F.col(cleaner), F.col(text)
    for known, (first, _) in CLEANERS.items():
        begun = F.when(name == known, first(F.col(text))).otherwise(begun)
    df = df.withColumn(text, begun)
    for known, (_, second) in CLEANERS.items():
        if second is not None:
            df = df.withColumn("_decoded", html_unescape(F.when(name == known, F.col(text))))
            df = df.withColumn(text, F.when(name == known, second(F.col("_decoded"))).otherwise(F.col(text))).drop("_decoded")
    return df.withColumn(text, generic(F.col(text)))


class Sql:
    """The same steps as SQL text; ``x`` is an expression."""

    @staticmethod
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    @classmethod
    def sub(cls, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {cls.quoted(pattern)}, {cls.quoted(by)}, 'g')"

    @classmethod
    def newlines(cls, x: str) -> str:
        return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

    @classmethod
    def trailing_space(cls, x: str) -> str:
        return cls.sub(x, r"(?m)[ \t]+$")

    @classmethod
    def blank_runs(cls, x: str) -> str:
        return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"

    @classmethod
    def strip(cls, x: str) -> str:
        return cls.sub(x, rf"\A[{SPACE}]+|[{SPACE}]+\z")

    @classmethod
    def generic(cls, x: str) -> str:
        return cls.strip(cls.blank_runs(cls.trailing_space(cls.newlines(f"nfc_normalize({x})"))))

    @classmethod
    def bracket_titles(cls, x: str) -> str:
        return cls.sub(x, rf"(?m)^\[[^\]\n]{{0,120}}\][{SPACE}]*$")

    @classmethod
    def book_markers(cls, x: str) -> str:
        return cls.sub(cls.sub(x, rf"(?s)\A.*?{BOOK_START}"), rf"(?s){BOOK_END}.*\z")

    @classmethod
    def credit_paragraphs(cls, x: str) -> str:
        return cls.sub(x, rf"(?ms)^[ \t]*{CREDIT_LEADS}\b.*?(?:\n[ \t]*\n|\z)")

    @classmethod
    def tag_lines(cls, x: str) -> str:
        return cls.sub(x, rf"(?m)^<[^>\n]*>[{SPACE}]*$")

    @classmethod
    def credit_footer(cls, x: str) -> str:
        import re

        return cls.sub(x, rf"(?s){re.escape(HEBREW_FOOTER)}.*")

    @classmethod
    def footnote_arrows(cls, x: str) -> str:
        return f"replace({cls.sub(x, FOOTNOTE_ARROW)}, chr(160), ' ')"

    @classmethod
    def untag_words(cls, x: str) -> str:
        word = f"regexp_replace(w, {cls.quoted(rf'/[^/{SPACE}]+$')}, '')"
        mark = f"CASE {word} WHEN '``' THEN chr(1) WHEN '''''' THEN chr(2) ELSE {word} END"
        line = f"array_to_string(list_filter(list_transform(regexp_split_to_array(l, {cls.quoted(rf'[{SPACE}]+')}), lambda w: {mark}), lambda w: w <> ''), ' ')"
        joined = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {line}), chr(10))"
        joined = cls.sub(joined, rf"[{SPACE}]*\x01[{SPACE}]*", ' "')
        joined = cls.sub(joined, rf"[{SPACE}]*\x02[{SPACE}]*", '" ')
        joined = cls.sub(joined, rf"[{SPACE}]+([.,;:!?%)\]}}])", r"\1")
        return cls.sub(joined, rf"([(\[{{])[{SPACE}]+", r"\1")

"""The text kernel: lines, pattern matches with columns, and the regex dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a line ends, as Python's splitlines has it.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def dialect(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for Java's engine with Unicode classes and, if asked, Unicode case folding."""
    return f"(?{'i' if ignore_case else ''}U){pattern}"


#: What RE2 reads under (?i) where Java's engine reads something else: ASCII words and blanks, and two letters that fold to ASCII ones.
_ASCII = {r"\w": r"[\w\x{17F}\x{212A}]", r"\s": r"[\t\n\f\r ]", "s": r"[s\x{17F}]", "k": r"[k\x{212A}]"}


def ascii_dialect(pattern: str) -> str:
    """``pattern`` between word boundaries for Java's engine, with the matches that RE2 (DuckDB's engine) finds without case.

    Meant for lower-case letters, groups, \\w and \\s; a match must begin and end with an ASCII letter.
    """
    return r"(?i)(?<!\w)" + re.sub(r"\\.|[sk]", lambda m: _ASCII.get(m[0], m[0]), pattern) + r"(?!\w)"


def line_array(content: Column) -> Column:
    """Lines without their ends; a last line end opens no further line. Null content has no lines."""
    parts = F.split(content, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(content: Column) -> Column:
    """array<struct<i, line>> with i from 0."""
    return F.transform(line_array(content), lambda line, i: F.struct(i.alias("i"), line.alias("line")))


def matches(line: Column, pattern: Column) -> Column:
    """array<struct<text, column>>: non-overlapping matches and their 1-based columns in code points.

    ``pattern`` is in Java's dialect and matches at least one character, so the pieces between matches tell where
    they are, in one walk along the line. Meant for lines that are known to match.
    """
    found = F.regexp_extract_all(line, pattern, F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,column:int>>").alias("out"))

    def placed(seen, piece):
        column = seen["at"] + F.length(piece["between"])
        return F.struct((column + F.length(piece["text"])).alias("at"), F.array_append(seen["out"], F.struct(piece["text"].alias("text"), column.alias("column"))).alias("out"))

    pieces = F.zip_with(found, F.slice(F.split(line, pattern, -1), F.lit(1), F.size(found)), lambda text, gap: F.struct(text.alias("text"), gap.alias("between")))
    return F.aggregate(pieces, start, placed, lambda seen: seen["out"])


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode blanks."""
    return F.regexp_replace(text, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def trim(text: Column) -> Column:
    """Without leading and trailing separators of words, as SQL's trim in DuckDB; tabs stay."""
    return F.regexp_replace(text, "^\\p{Zs}+|\\p{Zs}+\\z", "")


def luhn(text: Column) -> Column:
    """Whether the 13 to 19 ASCII digits of ``text`` pass the Luhn test."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)

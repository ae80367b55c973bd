"""Inline suppression: directives become intervals of lines, and an anti join drops the findings inside them.

A directive is a comment ``<!-- NAME-disable RULE -->`` or ``<!-- NAME-enable RULE -->`` with any tool name in lower case; without a
rule it means all of them. Rules named in directives have no dot, so findings whose rule_id has one can only be
suppressed by a bare directive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dialect

DIRECTIVE = r"<!--\s*[a-z]+-{0}\s*([\w-]*)\s*-->"
LAST_LINE = 2147483647


def directives(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, key) of the lines that carry a directive; an enable wins over a disable on its line."""
    enable, disable = (dialect(DIRECTIVE.format(k)) for k in ("enable", "disable"))
    rows = lines.where(F.col("line").contains("<!--")).withColumn("kind", F.when(F.col("line").rlike(enable), "enable").when(F.col("line").rlike(disable), "disable"))
    key = F.when(F.col("kind") == "enable", F.regexp_extract("line", enable, 1)).otherwise(F.regexp_extract("line", disable, 1))
    return rows.where("kind IS NOT NULL").select("file", "line_no", "kind", key.alias("key"))


def suppressed_intervals(lines: DataFrame) -> DataFrame:
    """(file, key, first_line, last_line): where findings of rule ``key``, or of all rules for '', are dropped.

    A disable lasts to the line before the next enable of its key or of all. On lines with a directive only the key that the
    line itself disables counts, so intervals are cut at every directive line.
    """
    marks = directives(lines)
    keys = marks.where("kind = 'disable'").select("file", "key").distinct()
    # Each key sees the directives that touch it, and a cut at every other directive line of its file.
    seen = keys.join(marks.withColumnRenamed("key", "own"), "file")
    ends = (F.col("kind") == "enable") & ((F.col("own") == "") | (F.col("own") == F.col("key")))
    starts = (F.col("kind") == "disable") & (F.col("own") == F.col("key"))
    seen = seen.withColumn("state", F.when(starts, 1).when(ends, 0))
    order = Window.partitionBy("file", "key").orderBy("line_no")
    seen = seen.withColumn("active", F.last("state", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_line", F.lead("line_no").over(order))
    last = F.coalesce(F.col("next_line") - 1, F.lit(LAST_LINE))
    first = F.when(starts, F.col("line_no")).otherwise(F.col("line_no") + 1)
    return seen.where("active = 1").select("file", "key", first.alias("first_line"), last.alias("last_line")).where("first_line <= last_line")


def drop_suppressed(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """``findings`` (file, line_no, rule_id, ...) that no interval of their file covers; a null line is never covered."""
    spans = suppressed_intervals(lines).withColumnRenamed("file", "_file")
    covered = (F.col("file") == F.col("_file")) & ((F.col("key") == "") | (F.col("key") == F.col("rule_id"))) & F.col("line_no").between(F.col("first_line"), F.col("last_line"))
    # An anti join would be pushed below the union of the findings, and the spans worked out for each of its branches.
    kept = findings.join(spans.withColumn("_covered", F.lit(True)), covered, "left").where("_covered IS NULL")
    return kept.select(*findings.columns)

"""Reports of a lint run: JSON as a column, and text for a console."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ICONS = {"error": "E", "warning": "W", "info": "I"}


def results(violations: DataFrame, files: DataFrame, skipped_checks: list[str]) -> DataFrame:
    """(file, violations, skipped_checks) of each file, clean ones too, the violations in order of line and rule.

    A file's violations are gathered in one row, as its report needs them.
    """
    place = F.struct(
        F.coalesce("line", F.lit(0)).alias("at"), "rule_id", "check_no", "emit_no",
        F.struct("rule_id", "severity", "message", "line", "column", "context", "suggestion").alias("v"),
    )
    grouped = violations.groupBy("file").agg(F.array_sort(F.collect_list(place)).alias("p")).select("file", F.col("p.v").alias("violations"))
    out = files.select("file").distinct().join(grouped, "file", "left")
    empty = F.array().cast(grouped.schema["violations"].dataType)
    checks = F.array(*[F.lit(c) for c in skipped_checks]).cast("array<string>")
    return out.select("file", F.coalesce("violations", empty).alias("violations"), checks.alias("skipped_checks"))


def json_rows(results_: DataFrame) -> DataFrame:
    """(file, json): one JSON object for each file, with its null fields."""
    return results_.select("file", F.to_json(F.struct("file", "violations", "skipped_checks"), {"ignoreNullFields": "false"}).alias("json"))


def report_json(results_: DataFrame, summary: DataFrame) -> str:
    """The whole report; it is printed, so it is put together on the driver, file after file."""
    total = summary.first()
    rows = [json.loads(r["json"]) for r in json_rows(results_).orderBy("file").toLocalIterator()]
    head = {"files_scanned": total["files_scanned"], "total_violations": total["total_violations"], "errors": total["errors"], "warnings": total["warnings"]}
    return json.dumps({"version": "1.0", "summary": head, "results": rows}, indent=2, ensure_ascii=False)


def report_text(results_: DataFrame, summary: DataFrame, verbose: bool = False) -> str:
    """Findings by file, suggestions and clean files if ``verbose``, and the totals that aren't zero."""
    out = []
    for row in results_.orderBy("file").toLocalIterator():
        if row["violations"] or verbose:
            out.append(f"\n{row['file']}")
        for v in row["violations"]:
            line = f"L{v['line']}" if v["line"] else "---"
            out.append(f"  {ICONS[v['severity']]} {line:>6}  {v['rule_id']}  {v['message']}")
            if v["suggestion"] and verbose:
                out.append(f"           Suggestion: {v['suggestion']}")
    total = summary.first()
    parts = [f"{total[k]} {name}" for k, name in (("errors", "error(s)"), ("warnings", "warning(s)"), ("infos", "info")) if total[k]]
    return "\n".join([*out, "", "Found: " + ", ".join(parts) if parts else "No issues found."])

"""The optional assistant pass on terminology: what is sent, and what comes back."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from . import rules

CHARACTERS_PER_TOKEN, TERMS_SHOWN = 4, 30
REPLY = "struct<issues:array<struct<message:string,context:string,suggestion:string,line:int>>>"
DEFAULT_MESSAGE = "Terminology issue found by LLM."


def within_budget(chunks: DataFrame, key: str, order: list, text: str, budget: int) -> DataFrame:
    """The first chunks of each ``key`` whose running length stays within ``budget`` characters; later ones go even if they'd fit."""
    so_far = F.sum(F.length(text)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("_so_far", so_far).where(F.col("_so_far") <= budget).drop("_so_far")


def issues(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """``replies`` (file, reply): one finding for each issue of the JSON; replies that aren't JSON give none."""
    rows = replies.select("file", F.posexplode(F.from_json(reply, REPLY)["issues"]).alias("emit_no", "issue"))
    found = rules.finding("terminology.llm", F.coalesce("issue.message", F.lit(DEFAULT_MESSAGE)), "info", "terminology", None, F.col("issue.suggestion"), F.col("issue.context"))
    return rows.select("file", F.col("issue.line").alias("line_no"), found.alias("f"), "emit_no").select("file", "line_no", "f.*", "emit_no")


def reviewed(segments: DataFrame, settings: Settings, client: Callable[[str, str], str]) -> DataFrame:
    """Findings of ``client(text, glossary)``, called once for each file with the segments within the budget.

    ``segments``: (file, ord, text). A client that fails gives no finding for its file.
    """
    terms = rules.glossary_terms(settings, "terminology")[:TERMS_SHOWN]
    summary = "\n".join(f"- Use '{preferred}' instead of: {pattern}" for pattern, preferred, _, _ in terms)
    budget = settings.llm.max_tokens_per_request * CHARACTERS_PER_TOKEN
    chunks = within_budget(segments.where(F.trim("text") != ""), "file", ["ord"], "text", budget)
    sent = chunks.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("c"))
    sent = sent.select("file", F.concat(F.lit("```text\n"), F.array_join("c.text", "\n\n---\n\n"), F.lit("\n```")).alias("text"))

    def ask(parts):
        for part in parts:
            out = []
            for text in part["text"]:
                try:
                    out.append(client(text, summary))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"file": part["file"], "reply": out})

    return issues(sent.mapInPandas(ask, "file string, reply string"))

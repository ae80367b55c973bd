"""Parsing as a column: format by file name, then one Arrow function over the contents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markdown, wiki

PARSED = (
    "struct<segments:array<struct<text:string,line_start:int,line_end:int,segment_type:string>>,"
    "headings:array<struct<text:string,level:int,line_no:int>>,"
    "code_blocks:array<struct<language:string,content:string,line_no:int,line_end:int>>,error:string>"
)

#: Formats in the order in which they claim a file: name, endings, parser.
PARSERS: dict[str, tuple[tuple[str, ...], Callable[[str], dict]]] = {
    "markdown": ((".md", ".markdown", ".mdx"), markdown.parse),
    "mediawiki": ((".wiki", ".mediawiki"), wiki.parse),
}


def format_of(file: Column) -> Column:
    """The format that claims a file name, whatever its case; null for none."""
    name, out = F.lower(file), F.lit(None).cast("string")
    for kind, (endings, _) in reversed(PARSERS.items()):
        claimed = F.lit(False)
        for ending in endings:
            claimed = claimed | name.endswith(ending)
        out = F.when(claimed, kind).otherwise(out)
    return out


def parsed(documents: DataFrame) -> DataFrame:
    """``documents`` (file, content) with format and doc: its segments, headings, code blocks and error.

    Files of unknown format and null contents have a null doc; a parser that fails on one document says so in ``error``.
    """
    parsers = {kind: parser for kind, (_, parser) in PARSERS.items()}

    @F.pandas_udf(PARSED)
    def parse(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        out = []
        for kind, content in zip(kinds, contents):
            row = {"segments": None, "headings": None, "code_blocks": None, "error": None}
            if kind is not None and content is not None:
                try:
                    row |= parsers[kind](content)
                except Exception as error:  # one bad document must not end the job
                    row["error"] = f"{type(error).__name__}: {error}"
            out.append(row)
        return pd.DataFrame(out, columns=["segments", "headings", "code_blocks", "error"])

    marked = documents.withColumn("format", format_of(F.col("file")))
    return marked.withColumn("doc", parse.asNondeterministic()("format", "content"))

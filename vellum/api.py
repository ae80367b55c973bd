"""Tools for callers that want JSON: lint a page or a framework, its metadata, a keyword search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .operators import reference_pages
from .plans import engine


def _engine(corpus: DataFrame, settings: Settings | None) -> engine.ReferenceEngine:
    return engine.ReferenceEngine(corpus, settings or Settings())


def _key(pages: DataFrame, framework: str, symbol: str) -> DataFrame:
    """(node): the page with the asked path as its key, whatever the case of either."""
    wanted = reference_pages.framework_key(framework, symbol).lower()
    return pages.where(F.lower("key") == wanted).select(F.col("key").alias("node"))


def lint_symbol(corpus: DataFrame, framework: str, symbol: str = "", settings: Settings | None = None) -> str:
    own = _engine(corpus, settings)
    keys = _key(own.pages, framework, symbol)
    found = engine.ordered(own.lint(keys)).select("file", "rule_id", "severity", "message", "line", "suggestion").collect()
    if not keys.take(1):
        raise LookupError(f"no page {framework}/{symbol}")
    count = lambda s: sum(v["severity"] == s for v in found)
    name = own.pages.join(keys, F.col("key") == F.col("node"), "left_semi").select("page.identifier").first()[0] or "unknown"
    rows = [{k: v[k] for k in ("rule_id", "severity", "message", "line", "suggestion")} for v in found]
    return json.dumps({"symbol": name, "violations": rows, "summary": {"errors": count("error"), "warnings": count("warning"), "info": count("info")}}, indent=2)


def lint_framework(corpus: DataFrame, framework: str, max_depth: int = 2, settings: Settings | None = None) -> str:
    own = _engine(corpus, settings)
    root = _key(own.pages, framework, "").first()
    if root is None:
        raise LookupError(f"no page {framework}")
    nodes = own.crawl(root["node"], max_depth)
    files = own.pages.join(nodes.select(F.col("node").alias("key")), "key", "left_semi").select(F.col("page.identifier").alias("file"))
    each = engine.file_summary(own.lint(nodes), files).orderBy("file").collect()
    total = lambda k: sum(r[k] for r in each)
    return json.dumps({
        "framework": framework, "symbols_scanned": len(each), "total_violations": total("errors") + total("warnings") + total("infos"),
        "results": [{"symbol": r["file"], "errors": r["errors"], "warnings": r["warnings"], "info": r["infos"]} for r in each],
        "summary": {"errors": total("errors"), "warnings": total("warnings"), "info": total("infos")},
    }, indent=2)


def page_metadata(corpus: DataFrame, framework: str, symbol: str = "") -> str:
    own = _engine(corpus, None)
    key = _key(own.pages, framework, symbol).first()
    if key is None:
        raise LookupError(f"no page {framework}/{symbol}")
    return own.metadata(key["node"]).select(F.to_json(F.struct("*"))).first()[0]


def search_symbols(corpus: DataFrame, keyword: str) -> str:
    rows = _engine(corpus, None).search(keyword).orderBy("identifier").toLocalIterator()
    return json.dumps({"query": keyword, "matches": [r.asDict() for r in rows]}, indent=2)

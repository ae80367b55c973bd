"""The engine: documents or reference pages in, one typed relation of violations out."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import fixed
from ..functions.text import LINE_END, dialect
from ..functions.text import lines as line_structs
from ..operators import assistant, graph, parse, reference_pages, rules
from ..operators.suppress import drop_suppressed
from ..sources.scratch import written

_log = logging.getLogger(__name__)
COLUMNS = ["rule_id", "message", "severity", "file", "line", "column", "suggestion", "context"]


def severity_rank(severity: str) -> int | None:
    return fixed.SEVERITIES.index(severity) if severity in fixed.SEVERITIES else None


def _rank(severity) -> Column:
    """0 for the worst; an unknown severity ranks last."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(fixed.SEVERITIES) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranks, F.col(severity)), F.lit(len(fixed.SEVERITIES) - 1))


class Registry:
    """Ordered rules by id; registering an id again replaces it in place, that of a built-in rule included.

    A rule maps views and settings to findings (file, line_no and the fields of ``rules.FINDING``, emit_no).
    """

    def __init__(self):
        self.rules: dict[str, Callable[[dict[str, DataFrame], Settings], DataFrame]] = {}

    def register(self, name: str, rule: Callable) -> None:
        self.rules[name] = rule


def _raw_lines(docs: DataFrame) -> DataFrame:
    """(file, line_no, line) of the documents' contents, front matter and code included."""
    return docs.select("file", F.explode(line_structs(F.col("content"))).alias("l")).select("file", (F.col("l.i") + 1).alias("line_no"), "l.line")


def _shaped(findings: DataFrame) -> DataFrame:
    return findings.select("rule_id", "message", "severity", "file", F.col("line_no").cast("int").alias("line"), "column", "suggestion", "context", "check_no", "emit_no")


def ordered(violations: DataFrame) -> DataFrame:
    """By file, line (none first) and rule, findings of one place in the order of checks."""
    return violations.orderBy("file", F.coalesce("line", F.lit(0)), "rule_id", "check_no", "emit_no")


class GovernanceEngine:
    """Lints markup documents."""

    def __init__(self, settings: Settings | None = None, registry: Registry | None = None, assistant_client: Callable[[str, str], str] | None = None):
        self.settings, self.registry, self._client = settings or Settings(), registry or Registry(), assistant_client
        self.failed: list[str] = []

    def documents(self, documents: DataFrame) -> DataFrame:
        """(file, content, format, doc): the documents that can be linted, parsed."""
        return parse.parsed(documents.select("file", "content")).where("format IS NOT NULL AND content IS NOT NULL AND doc.error IS NULL")

    def views(self, documents: DataFrame) -> dict[str, DataFrame]:
        """The relations that registered rules work on; each parses the documents for itself."""
        docs = self.documents(documents)
        segments = docs.select("file", F.posexplode("doc.segments").alias("ord", "s")).select("file", "ord", "s.*")
        in_segments = segments.select("file", "ord", "line_start", F.explode(line_structs(F.col("text"))).alias("l")).select("file", "ord", (F.col("line_start") + F.col("l.i")).alias("line_no"), "l.line")
        headings = docs.select("file", F.posexplode("doc.headings").alias("ord", "h")).select("file", "ord", "h.*")
        blocks = docs.select("file", F.posexplode("doc.code_blocks").alias("ord", "b")).select("file", "ord", "b.language", "b.line_no")
        return {"documents": docs, "lines": _raw_lines(docs), "segments": segments, "segment_lines": in_segments, "headings": headings, "code_blocks": blocks}

    def lint(self, documents: DataFrame) -> DataFrame:
        """The violations of ``documents`` (file, content), without the suppressed ones, in no order; see ``ordered``.

        Documents are parsed once, and one projection holds all rules that see one place. What most documents lack (list
        markers, directives) is looked for in whole contents before their lines are taken apart. Files of unknown
        format or that can't be parsed have no violations; ``skipped`` lists them.
        """
        settings, own = self.settings, self.registry.rules
        on = lambda name: settings.enabled(name) and name not in own
        docs = self.documents(documents)
        found = [rules.scan_places(docs.select("file", F.explode(rules.places(F.col("content"), F.col("doc"), settings)).alias("p")), settings, set(own))]
        known = documents.where(parse.format_of(F.col("file")).isNotNull() & F.col("content").isNotNull())
        if on("list-consistency"):
            listed = known.where(F.col("content").rlike(dialect("(?:^|" + LINE_END + ")" + fixed.LIST_MARKER[1:])))
            found.append(rules.list_consistency(_raw_lines(listed), settings))
        views = self.views(documents) if own or self._client else {}
        if self._client and settings.llm.enabled and on("terminology") and settings.option("terminology", "llm_enabled", False):
            found.append(assistant.reviewed(views["segments"], settings, self._client))
        for name, rule in own.items():
            if settings.enabled(name):
                try:
                    found.append(rule(views, settings))
                except Exception:  # one rule that can't be planned leaves the others
                    _log.exception("rule %s failed", name)
                    self.failed.append(name)
        every = reduce(DataFrame.unionByName, found)
        return _shaped(drop_suppressed(every, _raw_lines(known.where(F.col("content").contains("<!--")))))

    def skipped_checks(self) -> list[str]:
        names = [name for name, *_ in rules.CHECKS] + list(self.registry.rules)
        return [name for name in dict.fromkeys(names) if not self.settings.enabled(name) or name in self.failed]

    def skipped(self, documents: DataFrame) -> DataFrame:
        """(file, reason) of documents that weren't linted."""
        docs = parse.parsed(documents.select("file", "content"))
        reason = F.when(F.col("format").isNull(), "no parser").when(F.col("content").isNull(), "unreadable").otherwise(F.col("doc.error"))
        return docs.select("file", reason.alias("reason")).where("reason IS NOT NULL")

    def ruleset(self) -> str:
        """A digest of the settings and glossaries, so that cached results end with the rules that made them."""
        told = [asdict(self.settings), [rules.glossary_terms(self.settings, c) for c in ("terminology", "docc-terminology")], sorted(self.registry.rules)]
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


class ReferenceEngine:
    """Lints API reference pages of a corpus (key, json)."""

    def __init__(self, corpus: DataFrame, settings: Settings | None = None, compat: bool = True):
        """``compat``: broken references weigh as warnings where no severity is configured, as users are used to."""
        self.settings = settings or Settings()
        if compat and "docc-broken-crossref" not in self.settings.checks:
            from ..config import CheckSettings

            self.settings.checks["docc-broken-crossref"] = CheckSettings()
        self.pages = written(reference_pages.parsed_pages(corpus), "pages")

    def crawl(self, root: str, max_depth: int = 2) -> DataFrame:
        """(node, depth) of the pages reached through topic sections from the page with key ``root``."""
        edges = self.pages.select(F.col("key").alias("src"), F.explode("page.children").alias("dst")).where(~reference_pages.is_external(F.col("dst")))
        roots = self.pages.where(F.col("key") == root).select(F.col("key").alias("node"))
        return graph.crawl(self.pages.sparkSession, edges, roots, self.pages.select(F.col("key").alias("node")), max_depth)

    def lint(self, keys: DataFrame | None = None) -> DataFrame:
        """The violations of all pages, or of those in ``keys`` (node). Pages know no suppression."""
        settings, pages = self.settings, self.pages.where("page.error IS NULL")
        if keys is not None:
            pages = pages.join(keys.select(F.col("node").alias("key")), "key", "left_semi")
        shown = pages.select(F.when(F.col("page.identifier") != "", F.col("page.identifier")).otherwise("unknown").alias("file"), "page.*")
        segments = shown.select("file", F.posexplode("segments").alias("ord", "s"))
        rows = segments.select("file", "ord", "s.line_start", F.explode(line_structs(F.col("s.text"))).alias("l")).select("file", (F.col("line_start") + F.col("l.i")).alias("line_no"), "l.line")
        found = [rules.scan(rows, rules.DOCC_SEGMENT_RULES, settings)]
        if settings.enabled("docc-missing-description"):
            found.append(reference_pages.missing_description(shown, settings))
        if settings.enabled("docc-stale-platform"):
            found.append(reference_pages.stale_platforms(shown, settings))
        if settings.enabled("docc-broken-crossref"):
            found.append(reference_pages.broken_references(shown, self.pages.select("key"), settings))
        return _shaped(reduce(DataFrame.unionByName, found))

    def metadata(self, key: str | None = None) -> DataFrame:
        return reference_pages.metadata(self.pages if key is None else self.pages.where(F.col("key") == key))

    def search(self, keyword: str) -> DataFrame:
        return reference_pages.keyword_search(self.pages, keyword)


# ---- summaries and gate ----------------------------------------------------------------------------


def at_least(violations: DataFrame, severity: str) -> DataFrame:
    """Those at least as severe as ``severity``; an unknown one keeps all."""
    rank = severity_rank(severity)
    return violations.where(_rank("severity") <= (2 if rank is None else rank))


def file_summary(violations: DataFrame, files: DataFrame) -> DataFrame:
    """(file, errors, warnings, infos, has_errors) for each of ``files`` (file), clean ones too."""
    counted = violations.groupBy("file").agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in zip(fixed.SEVERITIES, ("errors", "warnings", "infos"))])
    joined = files.select("file").distinct().join(counted, "file", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("file", zero("errors"), zero("warnings"), zero("infos"), (F.coalesce("errors", F.lit(0)) > 0).alias("has_errors"))


def corpus_summary(violations: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files_scanned, total_violations, errors, warnings, infos."""
    each = file_summary(violations, files)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(F.count("*").alias("files_scanned"), total(F.col("errors") + F.col("warnings") + F.col("infos")).alias("total_violations"), *[total(c).alias(c) for c in ("errors", "warnings", "infos")])


def gates(violations: DataFrame, thresholds: list[str]) -> DataFrame:
    """(fail_on, failed) for each threshold, in one pass: whether a violation is at least as severe; an unknown threshold means error."""
    worst = violations.agg(F.min(_rank("severity")).alias("worst"))
    ranks = F.array(*[F.struct(F.lit(t).alias("fail_on"), F.lit(severity_rank(t) or 0).alias("rank")) for t in thresholds])
    each = worst.select("worst", F.explode(ranks).alias("t"))
    return each.select("t.fail_on", F.coalesce(F.col("worst") <= F.col("t.rank"), F.lit(False)).alias("failed"))


def gate(violations: DataFrame, fail_on: str = "error") -> DataFrame:
    """One row, failed: see ``gates``."""
    return gates(violations, [fail_on]).select("failed")

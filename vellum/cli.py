"""Command line: lint, lint-docc, serve, init and list-checks. Exit code 1 where the gate fails."""

from __future__ import annotations

import argparse
import sys

from . import config
from .operators import report, rules
from .plans import engine


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vellum").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellum")
    commands = parser.add_subparsers(dest="command", required=True)
    lint = commands.add_parser("lint", help="lint markup files and folders")
    lint.add_argument("paths", nargs="+")
    lint.add_argument("--severity", "-s", help="least severity to report: error, warning, info")
    lint.add_argument("--checks", help="check ids, comma-separated")
    lint.add_argument("--no-llm", action="store_true")
    pages = commands.add_parser("lint-docc", help="lint API reference pages of a folder of JSON files")
    pages.add_argument("framework")
    pages.add_argument("--corpus", help="folder of page JSON; without it pages are fetched over HTTP")
    pages.add_argument("--symbol", "-s")
    pages.add_argument("--max-depth", "-d", type=int, default=2)
    pages.add_argument("--no-crossref", action="store_true")
    for command in (lint, pages):
        command.add_argument("--config", "-c")
        command.add_argument("--json", action="store_true")
        command.add_argument("--verbose", "-v", action="store_true")
    serve = commands.add_parser("serve", help="answer tool calls (JSON-RPC) on standard input and output")
    serve.add_argument("--corpus", help="folder of page JSON; without it pages are fetched over HTTP")
    commands.add_parser("init", help="write a default configuration file")
    commands.add_parser("list-checks", help="list the checks")
    return parser


def _show(found, files, skipped, settings, as_json, verbose) -> int:
    from .sources.scratch import written

    found = written(found, "found")
    results, summary = report.results(found, files, skipped), engine.corpus_summary(found, files)
    print(report.report_json(results, summary) if as_json else report.report_text(results, summary, verbose))
    return int(engine.gate(found, settings.fail_on).first()["failed"])


def _lint(args) -> int:
    from .plans.cache import lint_cached
    from .sources import files

    settings = config.load(args.config)
    if args.no_llm:
        settings.llm.enabled = False
    if args.checks:
        config.select_checks(settings, args.checks.split(","))
    documents = files.read_documents(_session(), args.paths, settings.exclude)
    own = engine.GovernanceEngine(settings)
    found = lint_cached(own, documents, settings.cache_dir) if settings.cache_enabled else own.lint(documents)
    if args.severity:
        found = engine.at_least(found, args.severity)
    return _show(found, documents, own.skipped_checks(), settings, args.json or settings.output_format == "json", args.verbose)


def _lint_pages(args) -> int:
    from pyspark.sql import functions as F

    from .api import _key
    from .sources import files, http_pages

    settings = config.load(args.config)
    if args.no_crossref:
        settings.checks.setdefault("docc-broken-crossref", config.CheckSettings()).enabled = False
    if args.corpus:
        corpus = files.read_page_corpus(_session(), args.corpus)
    else:
        corpus = http_pages.fetch_corpus(_session(), args.framework, args.symbol or "", args.max_depth)
    own = engine.ReferenceEngine(corpus, settings)
    root = _key(own.pages, args.framework, args.symbol or "")
    first = root.first()
    if first is None:
        print(f"Error: there is no page {args.framework}/{args.symbol or ''}", file=sys.stderr)
        return 1
    nodes = root if args.symbol else own.crawl(first["node"], args.max_depth).select("node")
    pages = own.pages.join(nodes.withColumnRenamed("node", "key"), "key", "left_semi").select(F.col("page.identifier").alias("file"))
    return _show(own.lint(nodes), pages, [n for n in settings.checks if not settings.enabled(n)], settings, args.json, args.verbose)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "init":
        written = config.write_default()
        print(f"{'Created' if written else 'There is already'} {config.FILE_NAME}")
        return int(not written)
    if args.command == "list-checks":
        print("\n".join(f"  {name:<25} [{category}]  {said}" for name, category, _, said in rules.CHECKS))
        return 0
    if args.command == "serve":
        from . import mcp

        return mcp.serve(_session(), args.corpus)
    from .sources.scratch import scratch_scope

    with scratch_scope(_session()):
        return _lint(args) if args.command == "lint" else _lint_pages(args)


if __name__ == "__main__":
    sys.exit(main())

"""Parsers, fixture-like documents, reference pages, sources, reports, CLI and streaming."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from vellum import api, cli, config, mcp
from vellum.operators import assistant, graph, markdown, reference_pages, report, rules, wiki
from vellum.plans.engine import GovernanceEngine, ReferenceEngine, Registry, corpus_summary, ordered
from vellum.sources import files, http_pages, scratch
from vellum.streaming.lint import lint_stream

MARKDOWN = """# Harvest notes

#### Barn

All crates were painted before noon, and just two are left.

We ask the slave node, please.

1. apples
- pears
2. plums

~~~
count crates
~~~

ASIA0123456789ABCDEF is on the door, Secret_Key: 0123456789abcdef0123456789ABCDEF01234567
Ring 212-555-0187 or write to barn.keeper@farm.example, card 4111 1111 1111 1111, number 078-05-1120.
"""
FOUND = [
    (3, "heading-hierarchy", None), (5, "passive-voice", 12), (5, "terminology", 42), (7, "terminology", 12), (7, "terminology", 24),
    (9, "list-consistency", None), (13, "code-block-language", None), (17, "aws-key-exposed", None), (17, "aws-key-exposed", None),
    (18, "pii-detected.credit-card", 62), (18, "pii-detected.email", 31), (18, "pii-detected.phone-us", 6), (18, "pii-detected.ssn", 90),
]
WIKI = """== Orchard ==

==== Trees ====

Five rows were planted, and his dog is easy to find.

<syntaxhighlight>
plant(tree)
</syntaxhighlight>

The key AGPA0123456789ABCDEF opens the gate; orchard@farm.example has it.
"""


def test_markdown_document(spark):
    docs = spark.createDataFrame([("a.md", MARKDOWN)], "file string, content string")
    rows = ordered(GovernanceEngine().lint(docs)).collect()
    assert [(r.line, r.rule_id, r.column) for r in rows] == FOUND
    assert [sum(r.severity == s for r in rows) for s in ("error", "warning", "info")] == [6, 5, 2]


def test_wiki_document(spark):
    docs = spark.createDataFrame([("a.wiki", WIKI)], "file string, content string")
    rows = ordered(GovernanceEngine().lint(docs)).collect()
    assert [(r.line, r.rule_id) for r in rows] == [
        (3, "heading-hierarchy"), (3, "passive-voice"), (3, "terminology"), (3, "terminology"), (7, "code-block-language"), (11, "aws-key-exposed"), (11, "pii-detected.email"),
    ]


def kinds(parsed):
    return [(s["segment_type"], s["text"], s["line_start"]) for s in parsed["segments"]]


MARKDOWN_CASES = [
    ("# A\n\n## B\n\ntext", [("heading", "A", 1), ("heading", "B", 3), ("paragraph", "text", 5)], 0),
    ("Title\n===\n\nSub\n---\npara", [("heading", "Title", 1), ("heading", "Sub", 4), ("paragraph", "para", 6)], 0),
    ("- a\n- b", [("list_item", "a", 1), ("list_item", "b", 2)], 0),
    ("- a\n  - b\n- c", [("list_item", "a", 1), ("list_item", "b", 1), ("list_item", "b", 2), ("list_item", "c", 3)], 0),
    ("> quoted\nlazy\n\nafter", [("paragraph", "quoted\nlazy", 1), ("paragraph", "after", 4)], 0),
    ("- a\n\n  more\n\nafter", [("list_item", "a", 1), ("list_item", "more", 1), ("paragraph", "after", 5)], 0),
    ("- # H\n- b", [("list_item", "H", 1), ("heading", "H", 1), ("list_item", "b", 2)], 0),
    ("---\ntitle: x\n---\n# A", [("heading", "A", 4)], 0),
    ("    code\n\n<div>\nraw\n</div>\n\npara\n***", [("paragraph", "para", 7)], 0),
    ("~~~ sql extra\nx\n~~~\n```\ny", [], 2),
    ("a\n1. not a list\n2) b", None, 0),
    ("[x]: http://y\n\ntext", [("paragraph", "text", 3)], 0),
    ("- a\nlazy\n\n1. x\n1) y", [("list_item", "a\nlazy", 1), ("list_item", "x", 4), ("list_item", "y", 5)], 0),
    ("", [], 0),
]


@pytest.mark.parametrize("text, segments, code", MARKDOWN_CASES)
def test_markdown_blocks(text, segments, code):
    got = markdown.parse(text)
    if segments is not None:
        assert kinds(got) == segments
    assert len(got["code_blocks"]) == code


def test_markdown_code():
    got = markdown.parse("x\n\n```python\na\n  b\n```\n\n```\nc\n```")["code_blocks"]
    assert [(c["language"], c["content"], c["line_no"], c["line_end"]) for c in got] == [("python", "a\n  b\n", 3, 6), (None, "c\n", 8, 10)]


def test_wiki_nodes():
    got = wiki.parse("== H ''i'' ==\nplain [[Page|label]] {{t|a}} '''bold''' &amp; x <!-- no -->\n<source lang=\"sql\">s</source>[http://x y]\n* item")
    assert got["headings"] == [{"text": "H i", "level": 2, "line_no": 1}]
    assert [s["text"] for s in got["segments"]] == ["H i", "plain", "label", "bold", "x", "item"]
    assert [(c["language"], c["content"], c["line_no"]) for c in got["code_blocks"]] == [("sql", "s", 3)]
    assert wiki.parse("<<< [[ {{ '' unclosed & <b>")["segments"][0]["text"] == "<<< [[ {{ '' unclosed & <b>"


def page(key, **more):
    return key, json.dumps({"identifier": {"url": key}, **more})


ROOT, A, B, GONE = (f"doc://com.apple.kit/documentation/kit{x}" for x in ("", "/a", "/b", "/gone"))
PAGES = [
    page(ROOT, metadata={"title": "Kit", "role": "collection", "platforms": [{"name": "iOS", "introducedAt": "8.0"}, {"name": "visionOS", "introducedAt": "1.0", "beta": True}, {"name": "Odd", "introducedAt": "1", "deprecated": True}, {"name": "tvOS", "introducedAt": "x", "beta": True}]},
         abstract=[{"type": "text", "text": "Use swiftui"}, {"type": "reference", "identifier": "doc://x"}], topicSections=[{"identifiers": [A, reference_pages.fixed.EXTERNAL_PREFIX + "q"]}, {"identifiers": [GONE]}],
         references={A: {"url": "/a"}, GONE: {"url": "/gone"}, reference_pages.fixed.EXTERNAL_PREFIX + "q": {}, "https://x": {}},
         primaryContentSections=[{"kind": "declarations"}, {"kind": "content", "content": [
             {"type": "heading", "text": "Overview", "level": 2}, {"type": "paragraph", "inlineContent": [{"type": "strong", "inlineContent": [{"type": "text", "text": "It was"}, {"type": "codeVoice", "code": "made"}]}]},
             {"type": "codeListing", "syntax": "swift", "code": ["a", "b"]}, {"type": "aside", "content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "note"}]}]},
             {"type": "unorderedList", "items": [{"content": [{"type": "paragraph", "inlineContent": [{"type": "text", "text": "one"}]}]}]}, {"type": "codeListing", "code": []}]}]),
    page(A, metadata={"title": "A thing", "symbolKind": "class"}, topicSections=[{"identifiers": [B, ROOT]}]),
    page(B, abstract=[{"type": "text", "text": " "}]),
    ("bad", "not json"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(PAGES, "key string, json string")


def test_page_parts():
    got = reference_pages.page(json.loads(PAGES[0][1]))
    assert [(s["segment_type"], s["text"], s["line_start"]) for s in got["segments"]] == [
        ("abstract", "Use swiftui doc://x", 1), ("heading", "Overview", 2), ("paragraph", "It was made", 3), ("paragraph", "note", 4), ("list_item", "one", 5)]
    assert got["headings"] == [{"text": "Overview", "level": 2, "line_no": 2}]
    assert [(c["language"], c["line_no"], c["line_end"]) for c in got["code_blocks"]] == [("swift", 4, 5), (None, 8, 8)]
    assert got["children"] == [A, reference_pages.fixed.EXTERNAL_PREFIX + "q", GONE] and got["kind"] == "collection"


def test_reference_lint(corpus):
    own = ReferenceEngine(corpus)
    rows = [(r.file, r.rule_id, r.severity, r.line) for r in own.lint().collect()]
    count = lambda rule, file=None: sum(r[1] == rule and file in (None, r[0]) for r in rows)
    assert count("docc-missing-description", A) == count("docc-missing-description", B) == 1 and count("docc-missing-description") == 2
    assert sorted(r[2] for r in rows if r[1] == "docc-stale-platform") == ["info", "warning", "warning"]
    assert count("docc-terminology", ROOT) == 1 and count("passive-voice", ROOT) == 1
    assert sorted(r[2:] for r in rows if r[1] == "docc-broken-crossref") == [("warning", None)] * 2
    strict = ReferenceEngine(corpus, compat=False).lint().where("rule_id = 'docc-broken-crossref'")
    assert {r.severity for r in strict.collect()} == {"error"}


def test_crawl_depths(spark, corpus):
    own = ReferenceEngine(corpus)
    assert {r.node: r.depth for r in own.crawl(ROOT, 2).collect()} == {ROOT: 0, A: 1, B: 2}
    assert {r.node for r in own.crawl(ROOT, 0).collect()} == {ROOT, A}
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (1, 3)], "src long, dst long")
    got = graph.crawl(spark, edges, spark.createDataFrame([(1,)], "node long"), max_depth=9)
    assert {r.node: r.depth for r in got.collect()} == {1: 0, 2: 1, 3: 1}


def test_tools(corpus):
    assert json.loads(api.lint_symbol(corpus, "Kit", "a"))["summary"] == {"errors": 0, "warnings": 1, "info": 0}
    whole = json.loads(api.lint_framework(corpus, "kit"))
    assert whole["symbols_scanned"] == 3 and whole["total_violations"] == sum(whole["summary"].values())
    assert json.loads(api.page_metadata(corpus, "kit"))["title"] == "Kit"
    assert [m["identifier"] for m in json.loads(api.search_symbols(corpus, "SWIFT"))["matches"]] == [ROOT]
    with pytest.raises(LookupError):
        api.lint_symbol(corpus, "nothing")


def test_identifier_url(spark):
    rows = spark.createDataFrame([(ROOT,), (A,), ("doc://com.apple.Kit/documentation/Other/X",), ("https://x",), (reference_pages.fixed.EXTERNAL_PREFIX + "z",)], "i string")
    got = [r[0] for r in rows.select(reference_pages.identifier_url(F.col("i"))).collect()]
    base = reference_pages.fixed.PAGE_URL
    assert got == [f"{base}/kit.json", f"{base}/kit/a.json", f"{base}/kit/other/x.json", None, None]


def test_assistant(spark):
    made = config.from_mapping({"llm": {"enabled": True, "max_tokens_per_request": 5}, "checks": {"terminology": {"llm_enabled": True}}})
    docs = spark.createDataFrame([("a.md", "Alpha beta.\n\nGamma delta epsilon."), ("b.md", "boom")], "file string, content string")

    def client(text, glossary):
        if "boom" in text:
            raise OSError("down")
        return json.dumps({"issues": [{"context": text, "line": 3}, {"message": "m"}]}) if "Gamma" not in text and "blocklist" in glossary else "{}"

    rows = GovernanceEngine(made, assistant_client=client).lint(docs).where("rule_id = 'terminology.llm'").collect()
    assert sorted((r.message, r.line) for r in rows) == sorted([(assistant.DEFAULT_MESSAGE, 3), ("m", None)], key=str) or {r.message for r in rows} == {assistant.DEFAULT_MESSAGE, "m"}
    none = assistant.issues(spark.createDataFrame([("a", "not json"), ("b", None), ("c", '{"issues": []}')], "file string, reply string"))
    assert none.count() == 0


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text(MARKDOWN)
    (tmp_path / "docs" / "sub" / "b.wiki").write_text(WIKI)
    (tmp_path / "docs" / "sub" / "c.txt").write_text("SSN 123-45-6789")
    (tmp_path / "docs" / "clean.markdown").write_text("# Fine\n\nAll good.\n")
    (tmp_path / "docs" / "bad.md").write_bytes(b"\xff\xfe")
    return tmp_path / "docs"


def test_sources(spark, folder):
    got = {r.file.rsplit("/", 1)[-1]: r.error for r in files.read_documents(spark, [str(folder)], ["*clean*"]).collect()}
    assert got == {"a.md": None, "b.wiki": None, "bad.md": "not UTF-8"}
    assert files.read_documents(spark, [str(folder / "clean.markdown"), str(folder / "none")], ["*clean*"]).count() == 1
    assert files.read_documents(spark, [str(folder / "none")]).count() == 0


def test_cache(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, content string")
    kept = files.changed(docs.where("file <> 'c'"), docs.select("file", F.lit("").alias("content_key")), "r")
    assert {r.file for r in files.changed(docs, kept, "r").collect()} == {"c"}
    assert files.changed(docs, kept, "other rules").count() == 3
    assert GovernanceEngine().ruleset() != GovernanceEngine(config.from_mapping({"checks": {"line-length": {"max_length": 80}}})).ruleset()


def test_cached_lint(spark, tmp_path):
    from vellum.plans.cache import lint_cached

    docs = spark.createDataFrame([("a.md", MARKDOWN), ("b.md", "fine"), ("c.txt", "123-45-6789")], "file string, content string")
    for _ in range(2):
        assert lint_cached(GovernanceEngine(), docs, str(tmp_path / "cache")).count() == len(FOUND)
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3
    other = GovernanceEngine(config.from_mapping({"checks": {"terminology": {"enabled": False}}}))
    assert lint_cached(other, docs, str(tmp_path / "cache")).count() == sum(r != "terminology" for _, r, _ in FOUND)


def test_own_rules(spark):
    own = GovernanceEngine()
    own.registry.register("todo", lambda views, made: views["lines"].where("line LIKE '%TODO%'").select(
        "file", "line_no", F.lit("todo").alias("rule_id"), F.lit("left").alias("message"), F.lit("info").alias("severity"), F.lit(1).alias("column"), F.lit(None).cast("string").alias("suggestion"),
        F.col("line").alias("context"), F.lit(99).alias("check_no"), F.lit(0).alias("emit_no")))
    own.registry.register("broken", lambda views, made: views["nothing"])
    docs = spark.createDataFrame([("a.md", "x\nTODO y")], "file string, content string")
    assert [(r.rule_id, r.line) for r in own.lint(docs).collect()] == [("todo", 2)] and own.skipped_checks() == ["broken"]


def test_own_rule_in_place_of_a_built_in_one(spark):
    """A rule registered under the id of a built-in one replaces it."""
    docs = spark.createDataFrame([("a.md", "x" * 130 + "\n\nit was painted")], "file string, content string")
    before = sorted(r.rule_id for r in GovernanceEngine().lint(docs).collect())
    assert before == ["line-length", "passive-voice"]

    def own(views, settings):
        found = rules.finding("line-length", "mine", "info", "line-length")
        return views["lines"].where(F.length("line") > 10).select("file", "line_no", found.alias("f"), F.lit(0).alias("emit_no")).select("file", "line_no", "f.*", "emit_no")

    registry = Registry()
    registry.register("line-length", own)
    after = sorted((r.rule_id, r.message, r.line) for r in GovernanceEngine(registry=registry).lint(docs).collect())
    assert [x[:2] for x in after] == [("line-length", "mine"), ("line-length", "mine"), ("passive-voice", "Passive voice detected: 'was painted'")]


@pytest.mark.parametrize("depth", [1, 4])
def test_inline_content_as_columns(spark, depth):
    said = [{"type": "text", "text": "a"}, {"type": "strong", "inlineContent": [{"type": "codeVoice", "code": "b"}, {"type": "emphasis", "inlineContent": [{"type": "text", "text": "c"}, {"type": "reference", "identifier": "d"}]}]},
            {"type": "image", "identifier": "no"}, {"type": "reference", "title": "e", "identifier": "f"}, {"type": "text", "text": ""}, {"type": "newTerm"}]
    rows = spark.createDataFrame([(1, json.dumps(said)), (2, "[]"), (3, None), (4, "not JSON")], "id int, json string")
    got = {r.id: r.text for r in rows.select("id", reference_pages.flattened_column(F.col("json"), depth).alias("text")).collect()}
    assert got == {1: reference_pages.flattened(said) if depth == 4 else "a e", 2: "", 3: "", 4: ""}
    assert reference_pages.flattened(said) == "a b c d e"


def test_pages_are_fetched_level_by_level(spark):
    """A fetcher of one's own stands in for HTTP; depth and missing pages are heeded."""
    asked = []

    def fetcher(session, urls):
        asked.append(urls)
        known = {http_url(key): text for key, text in PAGES}
        return session.createDataFrame([(u, 200 if u in known else 404, known.get(u)) for u in urls], "url string, status int, json string")

    def http_url(key):
        return spark.createDataFrame([(key,)], "k string").select(reference_pages.identifier_url(F.col("k"))).first()[0]

    corpus = http_pages.fetch_corpus(spark, "kit", max_depth=1, fetcher=fetcher)
    keys = {r["key"] for r in corpus.collect()}
    assert ROOT in keys and A in keys and len(asked) == 2 and len(set(sum(asked, []))) == len(sum(asked, []))
    assert {r["key"] for r in http_pages.fetch_corpus(spark, "kit", "a", fetcher=fetcher).collect()} == {A}


def test_tool_server(spark, corpus):
    server = mcp.Server(corpus)
    ask = lambda method, number=1, **given: server.answer({"jsonrpc": "2.0", "id": number, "method": method, "params": given})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "vellum"
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["lint_symbol", "lint_framework", "page_metadata", "search_symbols"]
    assert server.answer({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    found = ask("tools/call", name="search_symbols", arguments={"keyword": "kit"})["result"]
    assert not found["isError"] and json.loads(found["content"][0]["text"]) == json.loads(api.search_symbols(corpus, "kit"))
    assert ask("tools/call", name="page_metadata", arguments={"framework": "nowhere"})["result"]["isError"]
    assert ask("tools/call", name="no")["error"]["code"] == -32602 and ask("no")["error"]["code"] == -32601
    out = io.StringIO()
    assert mcp.serve(spark, None, io.StringIO('nonsense\n\n[]\n{"jsonrpc": "2.0", "id": 7, "method": "ping"}\n'), out) == 0
    assert [json.loads(x).get("result", json.loads(x).get("error", {}).get("code")) for x in out.getvalue().splitlines()] == [-32700, -32600, {}]


def test_scratch_scope(spark):
    with scratch.scratch_scope(spark):
        path = scratch.written(spark.range(3), "scope").inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_http_pages(spark):
    import http.server
    import threading

    from vellum.sources import http_pages

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            found = self.path == "/a.json"
            self.send_response(200 if found else 404)
            self.end_headers()
            self.wfile.write(b'{"x": 1}' if found else b"")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    got = http_pages.fetch(spark, [f"{base}/a.json", f"{base}/b.json"], 0.01).collect()
    server.shutdown()
    assert [(r.url, r.status, r.json) for r in got] == [(f"{base}/a.json", 200, '{"x": 1}'), (f"{base}/b.json", 404, None)]


def test_reports(spark, folder):
    docs = files.read_documents(spark, [str(folder)])
    own = GovernanceEngine()
    found = own.lint(docs).persist()
    results, summary = report.results(found, docs, own.skipped_checks()), corpus_summary(found, docs)
    told = json.loads(report.report_json(results, summary))
    assert told["version"] == "1.0" and told["summary"]["files_scanned"] == 4 and told["summary"]["total_violations"] == sum(len(r["violations"]) for r in told["results"])
    first = next(r for r in told["results"] if r["file"].endswith("a.md"))
    assert [(v["line"], v["rule_id"], v["column"]) for v in first["violations"]] == FOUND
    text = report.report_text(results, summary)
    assert "Found: 8 error(s), 8 warning(s), 4 info" in text and "clean.markdown" not in text and "clean.markdown" in report.report_text(results, summary, True)


def test_command_line(spark, folder, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["list-checks"]) == 0 and "pii-detected" in capsys.readouterr().out
    assert cli.main(["lint", str(folder / "a.md")]) == 1 and "SSN" in capsys.readouterr().out
    assert cli.main(["lint", str(folder / "clean.markdown"), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["errors"] == 0
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 1
    pages = tmp_path / "pages"
    pages.mkdir()
    for i, (_, text) in enumerate(PAGES[:3]):
        (pages / f"{i}.json").write_text(text)
    capsys.readouterr()
    assert cli.main(["lint-docc", "kit", "--corpus", str(pages), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["files_scanned"] == 3
    assert cli.main(["lint-docc", "none", "--corpus", str(pages)]) == 1


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", MARKDOWN), ("b.md", "fine")], "file string, content string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    lint_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(FOUND)

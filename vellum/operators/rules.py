"""Governance rules as column expressions, windows and joins.

Most rules of lines and segments are patterns: one projection tells which of them match a line, and those that do are placed
by one expression that takes the pattern as a value, so a plan hardly grows with the rules. Structure
rules work on headings, code blocks and lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import fixed
from ..functions.text import ascii_dialect, dialect, lines, luhn, matches, strip, trim

FINDING = "struct<rule_id:string,message:string,severity:string,column:int,suggestion:string,context:string,check_no:int>"
VIOLATION = "rule_id string, message string, severity string, file string, line int, column int, suggestion string, context string"

#: Checks in the order in which they run: id, category, default severity, what it does.
CHECKS = [
    ("passive-voice", "style", "warning", "Sentences whose subject suffers the action."),
    ("heading-hierarchy", "formatting", "warning", "Headings more than one level below the one before."),
    ("heading-casing", "formatting", "info", "Headings written in another casing than the chosen style."),
    ("line-length", "formatting", "info", "Lines with more characters than allowed."),
    ("list-consistency", "formatting", "warning", "Lists whose items start with different markers."),
    ("code-block-language", "formatting", "warning", "Fenced code that names no language."),
    ("terminology", "terminology", "warning", "Words that the glossary replaces; an assistant may look for more."),
    ("aws-key-exposed", "security", "error", "Cloud access keys and secrets in plain text."),
    ("pii-detected", "security", "error", "Personal data: social security and card numbers, e-mail addresses, telephone numbers."),
    ("docc-missing-description", "docc", "warning", "Reference pages without an abstract."),
    ("docc-stale-platform", "docc", "warning", "Platforms that are deprecated, still in beta after release, or far behind."),
    ("docc-broken-crossref", "docc", "error", "References that lead to no page of the corpus."),
    ("docc-terminology", "docc", "info", "Product names in another spelling than the glossary's."),
]
ORDER = {name: i for i, (name, *_) in enumerate(CHECKS)}
DEFAULT_SEVERITY = {name: severity for name, _, severity, _ in CHECKS}


def severity_of(settings: Settings, check: str) -> str:
    return settings.severity(check, DEFAULT_SEVERITY[check])


def finding(rule_id, message, severity, check: str, column=None, suggestion=None, context=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        text(rule_id).alias("rule_id"), text(message).alias("message"), text(severity).alias("severity"),
        (column if column is not None else F.lit(None)).cast("int").alias("column"),
        text(suggestion).alias("suggestion"), text(context).alias("context"), F.lit(ORDER[check]).alias("check_no"),
    )


def _nothing() -> Column:
    return F.array().cast(f"array<{FINDING}>")


# ---- rules of one raw line that aren't patterns -------------------------------------------------------


def line_length(line: Column, settings: Settings) -> Column:
    most = settings.option("line-length", "max_length", 120)
    size = F.length(line)
    message = F.format_string(f"Line exceeds {most} characters (%d).", size)
    found = finding("line-length", message, severity_of(settings, "line-length"), "line-length", F.lit(most + 1))
    return F.when(size > most, F.array(found)).otherwise(_nothing())


def aws_keys(line: Column, settings: Settings) -> Column:
    """Key ids, then secret assignments; both show the line with ids masked first and secrets after."""
    ids, secret = dialect(fixed.AWS_KEY_ID), dialect(fixed.AWS_SECRET, True)
    shown = strip(F.regexp_replace(F.regexp_replace(line, ids, "[REDACTED_KEY_ID]"), secret, "[REDACTED_SECRET]"))
    severity = severity_of(settings, "aws-key-exposed")
    make = lambda message: finding("aws-key-exposed", message, severity, "aws-key-exposed", context=shown)
    found_ids = F.transform(F.regexp_extract_all(line, F.lit(ids), F.lit(0)), lambda m: make(F.concat(F.lit("Possible AWS access key ID detected: "), F.substring(m, 1, 8), F.lit("..."))))
    found_secrets = F.transform(F.regexp_extract_all(line, F.lit(secret), F.lit(0)), lambda m: make(F.lit("Possible AWS secret access key detected.")))
    return F.when(line.rlike(ids) | line.rlike(secret), F.concat(found_ids, found_secrets)).otherwise(_nothing())


# ---- rules that are patterns ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A rule that reports every match of a pattern, with the columns that its findings are made of.

    ``hint``: what a line must have for a search to be worth it, as a pattern that is searched faster or a plain string.
    ``redact``: the context masks the matches. ``keep``: the test that a match must pass, luhn or stative.
    ``plain``: the context is trimmed as in SQL.
    """

    check: str
    rule_id: str
    pattern: str
    severity: str
    before: str
    after: str | None = None
    suggestion: str | None = None
    hint: str | None = None
    redact: bool = False
    keep: str = ""
    plain: bool = False


def _pii(settings: Settings) -> list[Pattern]:
    """Each subtype not disabled; the context masks that subtype's own matches only."""
    off = settings.option("pii-detected", "disabled_subtypes", [])
    return [
        Pattern("pii-detected", f"pii-detected.{name}", dialect(pattern), severity_of(settings, "pii-detected"), message,
                hint="@" if name == "email" else "(?U)\\d{3}", redact=True, keep="luhn" if name == "credit-card" else "")
        for name, (pattern, message) in fixed.PII.items() if name not in off
    ]


def _passive_voice(settings: Settings) -> list[Pattern]:
    """Words and blanks are those of Unicode, or with the option ``ascii`` those of SQL's regular expressions."""
    keep = "stative" if settings.option("passive-voice", "allow_stative", True) else ""
    plain = settings.option("passive-voice", "ascii", False)
    pattern = ascii_dialect(fixed.PASSIVE.removeprefix(r"\b").removesuffix(r"\b")) if plain else dialect(fixed.PASSIVE, True)
    return [Pattern("passive-voice", "passive-voice", pattern, severity_of(settings, "passive-voice"), "Passive voice detected: '", "'", "Consider rewriting in active voice.", keep=keep, plain=plain)]


def _glossary(check: str):
    """Terms are (pattern, preferred, severity, whether case counts); lines without a match of any are passed over at once."""

    def of(settings: Settings) -> list[Pattern]:
        terms = glossary_terms(settings, check)
        some = dialect("|".join(f"(?{'' if case else 'i'}:{pattern})" for pattern, _, _, case in terms))
        return [Pattern(check, check, dialect(pattern, not case), severity, "Terminology: '", f"' -> use '{preferred}' instead.", f"Replace with '{preferred}'.", some)
                for pattern, preferred, severity, case in terms]

    return of


def glossary_terms(settings: Settings, check: str) -> list[tuple]:
    """The built-in glossary of a check, or the one in the YAML file that ``glossary_path`` names.

    Missing files give no terms, entries without a pattern or a preferred form or with an invalid pattern are passed
    over.
    """
    path = settings.option(check, "glossary_path")
    if path is None:
        if check == "terminology":
            return [(*term, False) for term in fixed.GENERAL_TERMS]
        return [(pattern, preferred, "info", True) for pattern, preferred in fixed.PRODUCT_TERMS]
    import re
    from pathlib import Path

    import yaml

    if not Path(path).exists():
        return []
    out = []
    for entry in (yaml.safe_load(Path(path).read_text()) or {}).get("terms") or []:
        try:
            re.compile(entry["pattern"])
            out.append((entry["pattern"], entry["preferred"], entry.get("severity", "warning"), entry.get("case_sensitive", False)))
        except (re.error, KeyError, TypeError):
            continue
    return out


PATTERNS = {"pii-detected": _pii, "passive-voice": _passive_voice, "terminology": _glossary("terminology"), "docc-terminology": _glossary("docc-terminology")}
SIMPLE = {"line-length": line_length, "aws-key-exposed": aws_keys}
LINE_RULES = ("line-length", "aws-key-exposed", "pii-detected")
SEGMENT_RULES = ("passive-voice", "terminology")
DOCC_SEGMENT_RULES = ("docc-terminology", "passive-voice")


def _tasks(line: Column, simple: list[Column], patterns: list[tuple[int, Pattern]]) -> Column:
    """array<struct<no, f>>: the patterns that match a line, by number, and what the other rules found, under -1."""
    kind = f"array<struct<no:int,f:{FINDING}>>"
    done = [F.transform(found, lambda f: F.struct(F.lit(-1).alias("no"), f.alias("f"))) for found in simple]
    for hint, some in groupby(patterns, key=lambda x: x[1].hint):
        hits = F.array_compact(F.array(*[F.when(line.rlike(p.pattern), F.struct(F.lit(no).alias("no"), F.lit(None).cast(FINDING).alias("f"))) for no, p in some]))
        worth = None if hint is None else line.contains(hint) if hint.isascii() and len(hint) == 1 else line.rlike(hint)
        done.append(hits if worth is None else F.when(worth, hits).otherwise(F.array().cast(kind)))
    return F.concat(*[x.cast(kind) for x in done]) if done else F.array().cast(kind)


def _found(rows: DataFrame, keys: list[str], patterns: list[Pattern]) -> DataFrame:
    """(keys, the fields of findings, k, emit_no) of rows (keys, line, tasks): every pattern that matches is placed by one and the same expression."""
    each = rows.select(*keys, "line", F.posexplode("tasks").alias("k", "t")).select(*keys, "line", "k", "t.no", "t.f")
    if patterns:
        told = lambda name: F.get(F.array(*[F.lit(getattr(p, name)).cast("string") for p in patterns]), F.col("no"))
        each = each.select("*", *[told(name).alias(f"_{name}") for name in ("rule_id", "pattern", "severity", "before", "after", "suggestion", "check", "redact", "keep")])
        each = each.select("*", F.posexplode_outer(F.when(F.col("no") >= 0, matches(F.col("line"), F.col("_pattern")))).alias("m", "match"))
        text = F.col("match.text")
        good = F.when(F.col("_keep") == "luhn", luhn(text)).when(F.col("_keep") == "stative", ~F.lower(text).isin(fixed.STATIVE)).otherwise(True)
        message = F.when(F.col("_after").isNotNull(), F.concat("_before", text, "_after")).otherwise(F.col("_before"))
        masked = F.when(F.col("_redact") == "true", F.regexp_replace("line", F.col("_pattern"), F.lit("[REDACTED]"))).otherwise(F.col("line"))
        shown = F.when(told("plain") == "true", trim(masked)).otherwise(strip(masked)) if any(p.plain for p in patterns) else strip(masked)
        check_no = F.try_element_at(F.create_map(*[F.lit(x) for item in ORDER.items() for x in item]), F.col("_check"))
        made = F.struct(F.col("_rule_id").alias("rule_id"), message.alias("message"), F.col("_severity").alias("severity"), F.col("match.column").alias("column"),
                        F.col("_suggestion").alias("suggestion"), shown.alias("context"), check_no.alias("check_no"))
        each = each.where(good).withColumn("f", F.when(F.col("no") >= 0, made.cast(FINDING)).otherwise(F.col("f"))).withColumn("emit_no", F.col("k") * 100_000 + F.coalesce("m", F.lit(0)))
    else:
        each = each.withColumn("emit_no", F.col("k"))
    return each.select(*keys, "f.*", "emit_no")


def _numbered(names, settings: Settings) -> list[Pattern]:
    return [p for name in names if name in PATTERNS and settings.enabled(name) for p in PATTERNS[name](settings)]


def scan(rows: DataFrame, names, settings: Settings, keys: tuple[str, ...] = ("file", "line_no"), text: str = "line") -> DataFrame:
    """Findings of those of the rules ``names`` that are enabled, over one line in each row."""
    patterns = _numbered(names, settings)
    simple = [SIMPLE[name](F.col(text), settings) for name in names if name in SIMPLE and settings.enabled(name)]
    return _found(rows.select(*keys, F.col(text).alias("line"), _tasks(F.col(text), simple, list(enumerate(patterns))).alias("tasks")), list(keys), patterns)


# ---- rules of headings, code blocks and lists ------------------------------------------------------------


def hierarchy_finding(level: Column, before: Column, text: Column, settings: Settings) -> Column:
    """Null unless the level is more than one below ``before``, that of the heading before it in the file."""
    found = finding("heading-hierarchy", F.format_string("Heading level skipped: h%d -> h%d", before, level), severity_of(settings, "heading-hierarchy"),
                    "heading-hierarchy", None, F.format_string("Use h%d instead.", before + 1), text)
    return F.when((level > before + 1) & (before > 0), found)


def _rows(view: DataFrame, found: Column) -> DataFrame:
    each = view.select("file", "line_no", found.alias("f"), F.col("ord").alias("emit_no")).where("f IS NOT NULL")
    return each.select("file", "line_no", "f.*", "emit_no")


def heading_hierarchy(headings: DataFrame, settings: Settings) -> DataFrame:
    """``headings``: (file, ord, text, level, line_no)."""
    seen = headings.withColumn("before", F.lag("level").over(Window.partitionBy("file").orderBy("ord")))
    return _rows(seen, hierarchy_finding(F.col("level"), F.col("before"), F.col("text"), settings))


_LETTERS = "(?U)^\\p{L}+$"


def casing_finding(text: Column, settings: Settings) -> Column:
    """Style ``sentence`` looks at the first word only, ``title`` at every one; another style finds nothing. Null for a good heading."""
    style = settings.option("heading-casing", "style", "sentence")
    shown = strip(text)
    words = F.split(shown, "(?U)[\\s\\x1c-\\x1f]+")
    if style == "title":
        odd = lambda w: w.contains("/") | w.contains("_") | w.contains(".")
        wrong = lambda w, i: ~odd(w) & ((i == 0) | ~F.lower(w).isin(fixed.SMALL_WORDS)) & w.rlike(_LETTERS) & ~w.rlike("(?U)^\\p{Lu}")
        bad = F.exists(F.transform(words, wrong), lambda x: x)
        message, hint = "Heading not in title case: '", "Capitalize major words."
    elif style == "sentence":
        bad = words[0].rlike(_LETTERS) & words[0].rlike("(?U)^\\p{IsLowercase}")
        message, hint = "Heading not in sentence case: '", "Only capitalize the first word and proper nouns."
    else:
        bad, message, hint = F.lit(False), "", ""
    found = finding("heading-casing", F.concat(F.lit(message), shown, F.lit("'")), severity_of(settings, "heading-casing"), "heading-casing", None, hint, shown)
    return F.when((shown != "") & bad, found)


def heading_casing(headings: DataFrame, settings: Settings) -> DataFrame:
    return _rows(headings, casing_finding(F.col("text"), settings))


def language_finding(language: Column, settings: Settings) -> Column:
    """Null for a block that names its language."""
    found = finding("code-block-language", "Code block missing language tag.", severity_of(settings, "code-block-language"), "code-block-language", None,
                    "Add a language identifier after the opening fence (e.g., ```python).")
    return F.when(language.isNull(), found)


def code_block_language(blocks: DataFrame, settings: Settings) -> DataFrame:
    """``blocks``: (file, ord, language, line_no)."""
    return _rows(blocks, language_finding(F.col("language"), settings))


# ---- all rules that see one place of a document ----------------------------------------------------------

#: What a document is taken apart into: its lines, the lines of its segments, its headings and its code blocks.
LINE, SEGMENT_LINE, HEADING, BLOCK = range(4)


def may_hit_lines(content: Column, settings: Settings) -> Column:
    """False only where no line rule can find anything, by cheap tests of the whole document."""
    hit = F.lit(False)
    if settings.enabled("line-length"):
        hit = hit | content.rlike(f"(?m)^.{{{settings.option('line-length', 'max_length', 120) + 1}}}")
    if settings.enabled("aws-key-exposed"):
        hit = hit | content.rlike(dialect(fixed.AWS_KEY_ID)) | content.rlike(dialect("secret", True))
    if settings.enabled("pii-detected"):
        hit = hit | content.contains("@") | content.rlike("(?U)\\d{3}")
    return hit


def places(content: Column, doc: Column, settings: Settings) -> Column:
    """array<struct<kind, line_no, ord, text, level, before, language>> of a parsed document, only what enabled rules look at."""
    nothing = F.lit(None)

    def place(kind, line_no, ord_, text=nothing, level=nothing, before=nothing, language=nothing):
        return F.struct(F.lit(kind).alias("kind"), line_no.cast("int").alias("line_no"), ord_.cast("int").alias("ord"), text.cast("string").alias("text"),
                        level.cast("int").alias("level"), before.cast("int").alias("before"), language.cast("string").alias("language"))

    none = F.array().cast("array<struct<kind:int,line_no:int,ord:int,text:string,level:int,before:int,language:string>>")
    said = lambda s, o: F.transform(lines(s["text"]), lambda x: place(SEGMENT_LINE, s["line_start"] + x["i"], o, x["line"]))
    heads, blocks = doc["headings"], doc["code_blocks"]
    before = lambda o: F.when(o > 0, F.get(heads, o - 1)["level"])
    parts = [
        F.when(may_hit_lines(content, settings), F.transform(lines(content), lambda x: place(LINE, x["i"] + 1, x["i"], x["line"]))),
        F.flatten(F.transform(doc["segments"], said)) if any(map(settings.enabled, SEGMENT_RULES)) else none,
        F.transform(heads, lambda h, o: place(HEADING, h["line_no"], o, h["text"], h["level"], before(o))),
        F.transform(blocks, lambda b, o: place(BLOCK, b["line_no"], o, language=b["language"])) if settings.enabled("code-block-language") else none,
    ]
    return F.concat(*[F.coalesce(p, none) for p in parts])


def scan_places(rows: DataFrame, settings: Settings, without: set[str] = frozenset()) -> DataFrame:
    """Findings of all enabled rules that see one place, over exploded ``places`` (file, p).

    ``without``: rules that others stand in for.
    """
    on = lambda name: settings.enabled(name) and name not in without
    row = rows.select("file", "p.*")
    line, kind = F.col("text"), F.col("kind")
    numbers, patterns = {}, []
    for own, names in ((LINE, LINE_RULES), (SEGMENT_LINE, SEGMENT_RULES)):
        some = _numbered(filter(on, names), settings)
        numbers[own] = list(enumerate(some, len(patterns)))
        patterns += some
    headings = [f for name, f in (("heading-hierarchy", hierarchy_finding(F.col("level"), F.col("before"), line, settings)), ("heading-casing", casing_finding(line, settings))) if on(name)]
    blocks = [language_finding(F.col("language"), settings)] if on("code-block-language") else []
    of = lambda found: [F.array_compact(F.array(*found))] if found else []
    tasks = F.when(kind == LINE, _tasks(line, [SIMPLE[n](line, settings) for n in LINE_RULES if n in SIMPLE and on(n)], numbers[LINE]))
    tasks = tasks.when(kind == SEGMENT_LINE, _tasks(line, [], numbers[SEGMENT_LINE])).when(kind == HEADING, _tasks(line, of(headings), [])).otherwise(_tasks(line, of(blocks), []))
    found = _found(row.select("file", "line_no", "kind", "ord", line.alias("line"), tasks.alias("tasks")), ["file", "line_no", "kind", "ord"], patterns)
    return found.withColumn("emit_no", F.when(F.col("kind") >= HEADING, F.col("ord")).otherwise(F.col("emit_no"))).drop("kind", "ord")


def list_islands(lines: DataFrame) -> DataFrame:
    """(file, island, items, markers, line_no): runs of list lines of one indent, not parted by a blank line.

    Gaps and islands over one sort by file and line; other prose between items doesn't end a list.
    """
    pattern = dialect(fixed.LIST_MARKER)
    marker = F.regexp_extract("line", pattern, 2)
    rows = lines.where(F.col("line").rlike(pattern) | (strip(F.col("line")) == "")).select(
        "file", "line_no", F.col("line").rlike(pattern).alias("listed"), F.length(F.regexp_extract("line", pattern, 1)).alias("indent"),
        F.when(marker.rlike("(?U)^\\d"), "ordered").otherwise(F.substring(marker, 1, 1)).alias("marker"),
    )
    in_file = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("blanks", F.sum((~F.col("listed")).cast("int")).over(in_file)).where("listed")
    changed = (F.lag("indent").over(in_file) != F.col("indent")) | (F.lag("blanks").over(in_file) != F.col("blanks"))
    rows = rows.withColumn("starts", F.coalesce(changed, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("starts").over(in_file))
    return rows.groupBy("file", "island").agg(F.count("*").alias("items"), F.array_sort(F.collect_set("marker")).alias("markers"), F.min("line_no").alias("line_no"))


def list_consistency(lines: DataFrame, settings: Settings) -> DataFrame:
    mixed = list_islands(lines).where((F.col("items") >= 2) & (F.size("markers") > 1))
    found = finding("list-consistency", F.concat(F.lit("Mixed list markers in list: "), F.array_join("markers", ", ")), severity_of(settings, "list-consistency"),
                    "list-consistency", None, "Use the same marker type throughout the list.")
    return mixed.select("file", "line_no", found.alias("f"), F.col("island").cast("int").alias("emit_no")).select("file", "line_no", "f.*", "emit_no")

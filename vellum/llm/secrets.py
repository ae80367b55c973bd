"""Secret scans judged by corpus-wide ownership.

Each document is scanned for base candidates and for some weaker ones that only corpus statistics can judge. The hashes of
all candidates are aggregated over the corpus by distinct repositories and owners: a value that
several owners or many repositories carry is a copied example, one that stays with a single owner in a few
repositories and looks random is treated as live. Weak candidates that are live become spans beside the base ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, marked, skew_join, slices, written

#: Base kinds in the order that breaks ties: pattern, group that must be long enough, its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Equal to the base pattern with its length test, and quicker: a shorter run holds no longer one.
_QUICK = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}
_RUN = "[A-Za-z0-9+/_-]"
#: Kinds that count only where the corpus says that they are live. Each is matched in time linear in the text.
WEAK = {
    "bearer": re.compile(r"[Bb]earer\x20++([A-Za-z0-9._~+/-]{16,}+=*+)"),
    "urlauth": re.compile(r"://[^\s/:@]++:([^\s/:@]{4,}+)@"),
    "random": re.compile(rf"(?<!{_RUN})({_RUN}{{20,}}+={{0,2}})"),
}
KINDS = [*BASE, *WEAK]
#: A value is live while so many owners and repositories have it at most, and its characters carry so many bits.
LIVE_OWNERS, LIVE_REPOS, LIVE_BITS = 1, 3, 3.0
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")


def entropy(value: str) -> float:
    """Bits for each character by the value's own frequencies."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, secret value) by start, then kind."""
    found = []
    pattern, group, least = BASE["assign"]
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    for order, kind in ((1, "access"), (2, "hex")):
        found += [(m.start(), order, m.end(), m[0]) for m in _QUICK[kind].finditer(text)]
    return sorted(found)


def _weak_matches(kind: str, text: str):
    """(start, end, secret value) of the matches of one weak kind, whatever else is there."""
    if kind == "urlauth":
        for m in WEAK[kind].finditer(text) if "://" in text and "@" in text else ():
            first = start = m.start()
            while first and text[first - 1] in _SCHEME:
                first -= 1
                start = first if text[first].isalpha() else start
            if m.start() - start >= 2:
                yield start, m.end(), m[1]
    elif kind == "bearer":
        for m in WEAK[kind].finditer(text) if "earer" in text else ():
            yield m.start(), m.end(), m[1]
    else:
        for m in WEAK[kind].finditer(text):
            if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                yield m.start(), m.end(), m[1]


def weak_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Matches of the weak kinds that look random and overlap neither a base span nor a kind listed earlier."""
    found, taken = [], sorted((s, e) for s, _, e, _ in base)
    for kind in WEAK:
        own, at, reach = [], 0, 0
        for start, end, value in _weak_matches(kind, text):
            while at < len(taken) and taken[at][0] < end:  # matches come in order, so one walk along the taken spans does
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= start and entropy(value) >= LIVE_BITS:
                own.append((start, KINDS.index(kind), end, value))
        found += own
        taken = sorted(taken + [(s, e) for s, _, e, _ in own])
    return sorted(found)


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def candidates(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row for each document: base counts and digest, and its candidates as an array of structs.

    ``row`` is the digest of a text that has candidates, ``place`` a shorter hash of it. What the corpus says of candidates
    depends on their values alone, so equal texts share it.
    """
    missing = F.lit("")
    name = lambda c: F.coalesce(F.col(c).cast("string"), missing) if c in docs.columns else missing
    text = F.coalesce(F.col("text").cast("string"), missing)
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("place"), name(repo_col).alias("repo"), name(owner_col).alias("owner"))
    fields = {"doc_id": pa.int64(), "row": pa.string(), "place": pa.int64(), "n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "repo": pa.string(),
              "owner": pa.string(), "found": pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary()), ("bits", pa.float64())]))}

    def run(parts):
        for part in parts:
            for some in slices(part, most_rows=1024):
                out = []
                for doc_id, text, place, repo, owner in zip(some["doc_id"], some["text"], some["place"], some["repo"], some["owner"]):
                    base = base_spans(text)
                    every = base + weak_spans(text, base)
                    count = Counter(k for _, k, _, _ in base)
                    row = hashlib.sha256(text.encode()).hexdigest() if every else None
                    digest = hashlib.sha256(listed(x[:3] for x in base).encode()).hexdigest()
                    found = [{"start": s, "kind": k, "end": e, "value": hashlib.blake2b(v.encode(), digest_size=16).digest(), "bits": entropy(v)} for s, k, e, v in every]
                    out.append((doc_id, row, place, count[0], count[1], count[2], digest, repo, owner, found or None))
                yield dict(zip(fields, zip(*out)))

    return map_columns(rows, run, fields)


def ownership(found: DataFrame) -> DataFrame:
    """(value, repos, owners, uses) of each candidate hash, over the whole corpus.

    Distinct pairs are counted in two steps that both combine before they shuffle, so a value that a third of all
    documents carry is counted in many tasks.
    """
    each = found.select("repo", "owner", F.explode("found").alias("c")).select("repo", "owner", F.col("c.value").alias("value"))
    pairs = each.groupBy("value", "repo", "owner").agg(F.count("*").alias("uses"))
    by_owner = pairs.groupBy("value", "owner").agg(F.sum("uses").alias("uses"))
    repos = pairs.groupBy("value", "repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("uses").alias("uses")).join(repos, "value")


def _scanned(docs: DataFrame, repo_col: str, owner_col: str, live_owners: int, live_repos: int) -> tuple[DataFrame, DataFrame]:
    """Each row's scan, and for each text with candidates its spans and their counts."""
    found = written(candidates(docs, repo_col, owner_col), "secrets")
    some = found.where("found IS NOT NULL")
    stats = written(ownership(some), "ownership")
    each = some.select("row", "place", "found").dropDuplicates(["row"]).select("row", "place", F.explode("found").alias("c")).select("row", "place", "c.*")
    judged = skew_join(each, stats.select("value", "owners", "repos"), ["value"])
    few = (F.col("owners") <= live_owners) & (F.col("repos") <= live_repos)
    live = few & (F.col("bits") >= LIVE_BITS)
    shown = (F.col("kind") < len(BASE)) | live
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    label = F.concat(names, F.lit(":"), F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"))
    per_row = judged.groupBy("row", "place").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("start", "kind", "end", label.alias("label"))))).alias("s"),
        F.count_if(live).alias("n_live"), F.count_if(~few).alias("n_copied"),
    )
    return found, per_row.select("row", "place", F.array_join("s.label", ",").alias("spans"), "n_live", "n_copied")


def secret_scan(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied).

    ``spans`` lists the base spans and the weak ones whose value at most ``live_owners`` owners carry in at most ``live_repos``
    repositories; n_live and n_copied count the spans by that test, so an example that many repositories of one owner copy is
    told from a credential of one place. Where no column names a repository, a document stands for one. Null texts are empty and
    give no span. Rows with equal texts get equal results each; all unnamed owners count as one, and so do
    unnamed repositories. An empty table gives an empty result.
    """
    found, per_row = _scanned(docs, repo_col, owner_col, live_owners, live_repos)
    base = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    # Most documents have no candidate: they bypass the join, where their null key would gather them.
    joined = skew_join(found.where("row IS NOT NULL").select(*base, "row"), per_row.drop("place"), ["row"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    judged = joined.select(*base, F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"))
    clean = found.where("row IS NULL").select(*base, F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"))
    return judged.unionByName(clean)


def _mask(text: str, spans: str) -> str:
    out, at = [], 0
    for start, end in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans.split(","))):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, live_owners: int = LIVE_OWNERS, live_repos: int = LIVE_REPOS) -> DataFrame:
    """``docs`` with every span of ``secret_scan`` replaced by [secret], and n_chars, if there, counted anew.

    Overlapping spans are masked as one. Null texts stay null; all rows and columns stay. Only texts that may have a span
    shuffle, the others stay where they were read.
    """
    _, per_row = _scanned(docs, "doc_id", "source", live_owners, live_repos)
    spans = written(per_row.where("spans <> ''").select("row", "place", "spans"), "spans")

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not s else _mask(t, s) for t, s in zip(text, spans)])

    every = marked(docs.withColumn("_place", F.xxhash64(F.col("text").cast("string"))), spans.select(F.col("place").alias("_place")), "_place")
    keyed = every.where("_maybe").withColumn("_row", F.sha2(F.col("text").cast("string"), 256))
    joined = skew_join(keyed, spans.select(F.col("row").alias("_row"), F.col("spans").alias("_spans")), ["_row"], "left")
    out = joined.withColumn("text", masked(F.col("text").cast("string"), F.col("_spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans") != "", F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return every.where("NOT _maybe").select(*docs.columns).unionByName(out.select(*docs.columns))

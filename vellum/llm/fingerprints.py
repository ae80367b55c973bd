"""Document fingerprints: MinHash by universal hash permutations over word shingles."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of_docs, map_columns, shingle_hashes, slices
from .neardup import link_components

SIZE, WORDS, ROWS = 96, 5, 4
_LEAST = -(1 << 63)


def _multipliers(size: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240607)
    draw = lambda: random.integers(0, 1 << 64, size, np.uint64)
    return draw() | np.uint64(1), draw()


def universal_signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """uint32[len(sets), size]: for each permutation x -> high half of (a x + b) the least value over the set.

    All ones for an empty set.
    """
    out = np.full((len(sets), size), 0xFFFFFFFF, np.uint32)
    factors, offsets = _multipliers(size)
    for first, last in batches_of_docs(sets, 1 << 15):
        rows = np.array([i for i in range(first, last) if len(sets[i])], np.int64)
        if not len(rows):
            continue
        members = np.concatenate([sets[i] for i in rows])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows])[:-1]))
        hashed = np.empty_like(members)
        for k in range(size):
            np.multiply(members, factors[k], out=hashed)
            hashed += offsets[k]
            out[rows, k] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return out


def fingerprint_text(signature: np.ndarray) -> str:
    """Four hex digits for each coordinate."""
    return (signature & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of equal coordinates, which estimates the Jaccard index of the shingle sets."""
    return float(np.mean((one & np.uint32(0xFFFF)) == (other & np.uint32(0xFFFF))))


def signatures_of(texts: list[str], size: int = SIZE) -> np.ndarray:
    return universal_signatures([shingle_hashes(t, WORDS) for t in texts], size)


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row. Null texts are empty; all empty texts share one fingerprint."""

    def run(parts):
        for part in parts:
            for some in slices(part):
                yield {"doc_id": some["doc_id"], "n_chars": [len(t) for t in some["text"]], "fingerprint": [fingerprint_text(s) for s in signatures_of(some["text"], size)]}

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_columns(columns, run, {"doc_id": pa.int64(), "n_chars": pa.int64(), "fingerprint": pa.string()})


def shared_bands(one: np.ndarray, other: np.ndarray, rows: int = ROWS) -> int:
    """How many bands of ``rows`` coordinates are equal in both signatures."""
    return int((one == other)[: len(one) // rows * rows].reshape(-1, rows).all(axis=1).sum())


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """The Jaccard index of two sorted arrays of distinct values; two empty ones have nothing in common."""
    union = len(np.union1d(one, other))
    return (len(one) + len(other) - union) / union if union else 0.0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents with a shingle Jaccard of 0.8 or more.

    The signature's bands are joined in Spark and the pairs verified on full shingle sets; see ``link_components``.
    """
    return link_components(docs, universal_signatures, bands=32, rows=ROWS, width=WORDS, numerator=80, denominator=100)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(bounds: list[tuple[int, int]]):
    """The number of bounds (key, hash) at or before a row's key and hash."""
    keys, hashes = np.array([k for k, _ in bounds], np.int64), np.array([h for _, h in bounds], np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(key: pd.Series, h: pd.Series) -> pd.Series:
        key, h = key.to_numpy(np.int64), h.to_numpy(np.int64)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for at in np.unique(low[high > low]):  # the few keys that are bounds
            rows = np.flatnonzero((low == at) & (high > low))
            low[rows] = at + np.searchsorted(hashes[at : high[rows[0]]], h[rows], "right")
        return pd.Series(low.astype(np.int32))

    return place


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, doc_id, text, last): rows to read in order, so that each row's next one in its bucket is the next document.

    Documents are dealt by ranges of doc_id, at bounds taken from its quantiles; an id that several quantiles fall on, null
    among them, is dealt to as many buckets by a hash of the text. Each bucket is closed by a copy of the next
    bucket's first document, marked ``last``. What reaches the driver is two places for each bucket.
    Null ids come first; rows that repeat an id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = [(key, _LEAST + i * ((1 << 64) // times)) for key, times in sorted(Counter(cuts).items()) for i in range(times)]
    place = _bucket(bounds)
    # A null and the least number share a key; the null comes first.
    firsts = rows.select("key", F.col("doc_id").isNotNull().alias("stated"), "h").withColumn("bucket", place("key", "h")).groupBy("bucket").agg(F.min(F.struct("key", "h", "stated")).alias("f")).collect()
    firsts = sorted((r["bucket"], *r["f"]) for r in firsts)
    closing = spark.createDataFrame([(key, h, stated, firsts[i - 1][0]) for i, (_, key, h, stated) in enumerate(firsts)], "key long, h long, stated boolean, bucket int")
    heads = rows.withColumn("stated", F.col("doc_id").isNotNull()).join(F.broadcast(closing), ["key", "h", "stated"]).groupBy("bucket").agg(F.min("text").alias("text"))
    body = rows.select(place("key", "h").alias("bucket"), "key", "h", "doc_id", "text", F.lit(False).alias("last"))
    nothing = F.lit(None).cast("long")
    every = body.unionByName(heads.select("bucket", nothing.alias("key"), nothing.alias("h"), nothing.alias("doc_id"), "text", F.lit(True).alias("last")))
    return every.repartitionById(n, "bucket").sortWithinPartitions("bucket", "last", "key", "h", "doc_id", "text")


def compare_with_edits(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how like they are to it and to the next document's.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next document
    in ascending doc_id, the first following the last; a single document follows itself. ``near_`` columns estimate the Jaccard
    index by the fingerprints; ``bands_`` columns count equal bands of the signatures, and where there is one,
    ``jaccard_`` columns hold the exact index of the full shingle sets, else null.
    """
    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
              "bands_edited": pa.int32(), "jaccard_edited": pa.float64(), "bands_next": pa.int32(), "jaccard_next": pa.float64()}

    def emit(rows):
        """Results of all rows (doc_id, text) but the last, which only follows."""
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        sets, other_sets = ([shingle_hashes(t, WORDS) for t in x] for x in (texts, changed))
        own, other = universal_signatures(sets, size), universal_signatures(other_sets, size)
        own_text = [fingerprint_text(s) for s in own[:-1]]
        out = {"doc_id": [i for i, _ in rows[:-1]], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
               "fingerprint": own_text, "edited_fingerprint": [fingerprint_text(s) for s in other]}
        for name, against, against_sets in (("edited", other, other_sets), ("next", own[1:], sets[1:])):
            bands = [shared_bands(a, b) if len(x) and len(y) else 0 for a, b, x, y in zip(own, against, sets, against_sets)]
            out[f"near_{name}"] = [likeness(a, b) for a, b in zip(own, against)]
            out[f"bands_{name}"] = bands
            out[f"jaccard_{name}"] = [jaccard(x, y) if n else None for x, y, n in zip(sets, against_sets, bands)]
        return out

    def run(parts):
        queue, chars, now = [], 0, None
        for part in parts:
            for bucket, doc_id, text, last in zip(part["bucket"], part["doc_id"], part["text"], part["last"]):
                if bucket != now:
                    queue, chars, now = [], 0, bucket
                queue.append((doc_id, text))
                chars += len(text)
                if len(queue) > 1 and (last or len(queue) > 256 or chars >= 1 << 21):
                    yield emit(queue)
                    queue, chars = queue[-1:], len(text)

    return map_columns(with_next(docs).select("bucket", "doc_id", "text", "last"), run, fields)

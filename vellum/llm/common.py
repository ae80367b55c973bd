"""Pieces shared by the training-data operators."""

from __future__ import annotations

import hashlib
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import clear_scratch, scratch_root, written  # noqa: F401

TRAIN_FOLDS, HELD_OUT_FOLD = 4, 2
#: Longer texts aren't learned from, so that what the driver collects is bounded.
FIT_CHARS = 1 << 18
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join whose left keys may be hot.

    A second key derived from the first makes Spark shuffle both sides anew even where one is an
    aggregate on the same key, and only joins between two shuffles can be split by AQE's skew handling.
    """
    extra = F.xxhash64(F.lit(7), *keys)
    return left.withColumn("_k", extra).join(right.withColumn("_k", extra).hint("merge"), [*keys, "_k"], how).drop("_k")


def held_out(doc_id="doc_id"):
    """True for the rows that nothing may learn a label from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % TRAIN_FOLDS == HELD_OUT_FOLD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get batches of about ``BATCH_BYTES``, unless the session states a size of its own.

    By Spark's default a batch grows to 64 MB, which the JVM holds outside its heap and the worker as Arrow and as values.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def map_columns(rows: DataFrame, run: Callable[[Iterator[dict[str, list]]], Iterator[dict]], fields: dict[str, pa.DataType], keeps_words: bool = False) -> DataFrame:
    """``rows`` through ``run``, which turns batches {column: values} into batches {column: values or array}.

    Values come and go through Arrow, so integers beyond 2**53 stay exact beside nulls, which pandas would make floats.
    Unless it ``keeps_words``, words that earlier tasks kept in the worker are dropped first.
    """
    from pyspark.sql.pandas.types import from_arrow_schema

    bounded_batches(rows.sparkSession)
    schema = pa.schema(list(fields.items()))

    def arrow(batches):
        if not keeps_words:
            forget_words()
        columns = ({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)} for batch in batches)
        for out in run(columns):
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in fields.items()], schema=schema)

    return rows.mapInArrow(arrow, from_arrow_schema(schema))


def slices(columns: dict[str, list], text: str = "text", most_rows: int = 512, most_chars: int = 1 << 20) -> Iterator[dict[str, list]]:
    """``columns`` in runs of at most ``most_rows`` rows and about ``most_chars`` characters of ``text``; a longer text is a run of its own."""
    first = chars = 0
    texts = columns[text]
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= most_chars or i + 1 - first >= most_rows or i + 1 == len(texts):
            yield {name: values[first : i + 1] for name, values in columns.items()}
            first, chars = i + 1, 0


def marked(rows: DataFrame, keys: DataFrame, place: str, most_bits: int = 28) -> DataFrame:
    """``rows`` with ``_maybe``: false only where the long column ``place`` has no equal in the column of that name of ``keys``.

    A bitmap of the keys, built by Spark in pieces of 4 KB and broadcast, holds 16 bits for each key as long as ``most_bits``
    allows, 32 MB at the default; beyond that more rows are marked that needn't be, and none is missed. Null places are not marked.
    """
    n = keys.count()
    bits = min(most_bits, max(16, (16 * n - 1).bit_length() if n else 0))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    slots = keys.where(F.col(place).isNotNull()).select((at(place) + 1).alias("h"))  # Spark's bitmaps count from 1
    pieces = slots.groupBy(F.expr("bitmap_bucket_number(h)").alias("_piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("_bits"))
    slot = F.col("_slot")
    byte = F.conv(F.hex(F.substr("_bits", (slot % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (slot % 8 + 1).cast("int"))) != 0, F.lit(False))
    found = rows.withColumn("_slot", F.when(F.col(place).isNotNull(), at(place))).withColumn("_piece", F.floor(slot / 32768).cast("long") + 1)
    joined = found.join(F.broadcast(pieces), "_piece", "left").withColumn("_maybe", known)
    return joined.select(*rows.columns, "_maybe")


class Known(dict):
    """Ids by chunk of text, with a bound on the memory they take; long chunks, which hardly come back, aren't kept.

    What was learnt last is found in any case. ``forget`` empties the table.
    """

    def __init__(self, most_bytes: int = 96 << 20, most_chars: int = 48):
        super().__init__()
        self._most_bytes, self._most_chars = most_bytes, most_chars
        self.forget()
        _tables.append(weakref.ref(self))

    def forget(self) -> None:
        self.clear()
        self[""] = b""
        self.room, self._last = self._most_bytes, {}

    def __missing__(self, chunk: str) -> bytes:
        return self._last[chunk]

    def learn(self, found: dict[str, bytes]) -> None:
        self._last = found
        if self.room > 0:
            own = {c: ids for c, ids in found.items() if len(c) <= self._most_chars}
            self.update(own)
            self.room -= sum(map(len, own.values())) + sum(map(len, own)) * 4 + 200 * len(own)


_tables: list[weakref.ref[Known]] = []


def forget_words() -> None:
    """Empties every ``Known`` of this process: a worker that goes on with other work has no use for them."""
    for ref in _tables:
        known = ref()
        if known is not None and len(known) > 1:
            known.forget()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], most_chars: int = FIT_CHARS) -> list[tuple[str, int]]:
    """At most about ``per_class`` training texts of each label value and of up to ``most_chars`` characters, chosen by a hash of doc_id.

    Only the slim labels table is counted and thinned; what is broadcast to the scan of the documents
    is the chosen ids, whose number ``per_class`` bounds. Ids whose labels disagree teach nothing; of texts that share an id
    the least counts.
    """
    stated = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id")
    known = stated.agg(F.min(F.col(label).cast("int")).alias("y"), F.max(F.col(label).cast("int")).alias("hi")).where("y = hi").select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    chosen = F.lit(False)
    for value, n in per_class.items():
        chosen = chosen | ((F.col("y") == value) & (place < int(min(1.0, n / max(1, counts.get(value, 0))) * (1 << 30))))
    ids = known.where(chosen).limit(2 * sum(per_class.values()))
    got = docs.select("doc_id", "text").where(F.length("text") <= most_chars).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r["text"], r["y"]) for r in sorted(got.collect(), key=lambda r: r["doc_id"])]


# ---- words and shingles as arrays -------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, extended by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * np.uint64(pow(base, filled, 1 << 64))
            filled *= 2
        _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than the six ASCII blanks."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running polynomial over each megabyte of bytes."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = int(np.searchsorted(ends, base + _SEGMENT, "right"))
        if last <= first:  # one word longer than a segment
            out[first] = int.from_bytes(hashlib.blake2b(data[base : ends[first]].tobytes(), digest_size=8).digest(), "little")
            first += 1
            continue
        part, lo, hi = data[base : ends[last - 1]], starts[first:last] - base, ends[first:last] - base
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(part)), out=total[1:])
        poly = (total[hi] - total[lo]) * _power_table(_INVERSE, len(part) + 1)[lo]
        out[first:last] = mix64(poly + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; quicker than numpy's own on many small arrays."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words, A-Z lower-cased.

    Fewer words make one shingle of the whole sequence; no word makes none. Lone surrogates cannot
    come from Spark strings.
    """
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = word_hashes(data, starts, ends)
    n = min(width, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x5851F42D4C957F2D) + words[i : i + len(out)]
    return distinct(mix64(out + np.uint64(n)))


def batches_of_docs(sets: list[np.ndarray], most: int = 1 << 16):
    """Index ranges of ``sets`` whose sizes sum to about ``most``."""
    first = total = 0
    for i, x in enumerate(sets):
        total += len(x)
        if total >= most:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sets):
        yield first, len(sets)

"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character n-grams of words. A document is a mixture: every few words in a row are drawn
from one of its languages. Expectation-maximisation estimates the proportions from their n-gram likelihoods;
languages whose removal costs less log likelihood than a penalty are dropped one at a time, and the
rest are the document's language set. The prediction is the one with the largest proportion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget_words, held_out, map_columns, slices

#: Training documents for each language at most, about; the n-gram tables, the penalty and the rounds.
FIT_DOCS, SIZES, BUCKETS, UNIT_WORDS = 400, (2, 3, 4), 1 << 16, 3
#: Languages learned at most, the most frequent ones, and the characters that all samples have together, about.
MOST_LANGUAGES, FIT_CHARS = 100, 64 << 20
ROUNDS, PENALTY, CAP = 8, 3.0, 20.0
UNDETERMINED = "und"
_SLICE_CHARS = 1 << 18


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by a line feed, and the lengths."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4") if lowered else np.empty(0, "<u4")
    return codes, np.array([len(t) + 1 for t in lowered], np.int64)


_LETTER_LIMIT = 0x110000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter or a mark in a word."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(_LETTER_LIMIT)]))
    return _letters[0]


def unit_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(document of each unit, first place of each unit, places, [(bucket at each place, places without a gram)] by size).

    A word is a run of letters with a blank on each side, and has its n-grams for every n of ``SIZES``; a unit
    is up to ``UNIT_WORDS`` words in a row of one document.
    """
    codes, lengths = _codes(texts)
    alpha = letters()[codes]
    edge = np.diff(np.concatenate(([False], alpha, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0, []
    document = np.searchsorted(np.cumsum(lengths), starts, "right")
    sized = ends - starts
    blanks = np.concatenate(([0], np.cumsum(sized + 1)))  # a blank before each word and one after the last
    padded = np.full(blanks[-1] + max(SIZES), 32, np.uint32)
    place = np.ones(blanks[-1], bool)
    place[blanks[:-1]] = False
    padded[: blanks[-1]][place] = codes[alpha]
    count, value, grams = int(blanks[-1]), padded[: blanks[-1]].copy(), []
    for n in range(2, max(SIZES) + 1):
        value *= np.uint32(0x01000193)
        value += padded[n - 1 : n - 1 + count]
        if n in SIZES:
            # A gram that would reach beyond the blank after its word isn't one.
            outside = np.concatenate([blanks[1:] - j for j in range(1, n - 1)]) if n > 2 else np.empty(0, np.int64)
            grams.append(((value * np.uint32(0x9E3779B1)) >> np.uint32(16), outside))
    first_of_document = np.searchsorted(document, document, "left")
    leads = (np.arange(len(document)) - first_of_document) % UNIT_WORDS == 0
    return document[leads], blanks[:-1][leads], count, grams


class Model:
    """Log probabilities of hashed n-grams for each language."""

    def __init__(self, languages: list[str], tables: np.ndarray):
        self.languages, self.tables = languages, tables  # float32[sizes, buckets, languages]

    @classmethod
    def fit(cls, samples: dict[str, list[str]]) -> Model:
        names = sorted(samples)
        counts = np.zeros((len(SIZES), BUCKETS, len(names)))
        if not names:
            return cls(names, counts.astype(np.float32))
        for j, name in enumerate(names):
            for first, last in _slices(samples[name]):
                for k, (buckets, outside) in enumerate(unit_grams(samples[name][first:last])[3]):
                    counts[k, :, j] += np.bincount(buckets, minlength=BUCKETS) - np.bincount(buckets[outside], minlength=BUCKETS)
        shared = counts.sum(axis=2, keepdims=True) + 0.01
        shared /= shared.sum(axis=1, keepdims=True)
        counts += 20.0 * shared + 0.02  # towards what all languages share
        return cls(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def unit_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document of each unit, float32[units, languages] log likelihood, the mean over the sizes)."""
        document, places, count, grams = unit_grams(texts)
        scores = np.zeros((len(document), len(self.languages)), np.float32)
        if len(document):
            values = np.zeros((count, len(self.languages)), np.float32)
            for table, (buckets, outside) in zip(self.tables, grams):
                own = table.take(buckets, axis=0)
                own[outside] = 0
                values += own
            scores = np.add.reduceat(values, places, axis=0) / np.float32(len(SIZES))
            scores -= scores.max(axis=1, keepdims=True)
            np.maximum(scores, -CAP, out=scores)  # one odd unit never rules a language out
        return document, scores

    def infer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(float[texts, languages] proportions, bool[texts] whether there is a word)."""
        if not self.languages:
            return np.zeros((len(texts), 1)), np.zeros(len(texts), bool)
        document, scores = self.unit_scores(texts)
        n, size = len(texts), len(self.languages)
        units = np.bincount(document, minlength=n) if len(document) else np.zeros(n, np.int64)
        likely = np.exp(scores)
        active = np.ones((n, size), bool)
        share, total = self._maximised(document, likely, active, units)
        cost = PENALTY + 0.5 * np.log(np.maximum(units, 1))  # of one more language
        undecided = units > 0
        # Where the best language alone loses less than one cost, no step below would stop before it.
        alone = np.zeros((n, size))
        if len(document):
            starts = np.flatnonzero(np.diff(document, prepend=-1))
            alone[document[starts]] = np.add.reduceat(scores, starts, axis=0)
        best = alone.argmax(axis=1)
        single = undecided & (total - alone[np.arange(n), best] < cost)
        share[single] = 0
        share[single, best[single]] = 1
        undecided &= ~single
        while undecided.any():
            chosen = np.flatnonzero(undecided)
            least = np.where(active[chosen], share[chosen], np.inf).argmin(axis=1)
            fewer = active[chosen].copy()
            fewer[np.arange(len(chosen)), least] = False
            renumber = np.full(n, -1)
            renumber[chosen] = np.arange(len(chosen))
            rows = renumber[document] >= 0
            new_share, new_total = self._maximised(renumber[document[rows]], likely[rows], fewer, units[chosen])
            dropped = total[chosen] - new_total < cost[chosen]
            moved = chosen[dropped]
            active[moved], share[moved], total[moved] = fewer[dropped], new_share[dropped], new_total[dropped]
            undecided[chosen[~dropped]] = False
            undecided &= active.sum(axis=1) > 1
        return share, units > 0

    @staticmethod
    def _maximised(document, likely, active, units):
        """Proportions after EM among the active languages, and each document's log likelihood."""
        n = len(active)
        share = (active / np.maximum(active.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        starts = np.flatnonzero(np.diff(document, prepend=-1)) if len(document) else np.empty(0, np.int64)
        present = document[starts] if len(document) else np.empty(0, np.int64)
        for _ in range(ROUNDS if len(document) else 0):
            joint = likely * share[document]
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-30)
            share[present] = np.add.reduceat(joint, starts) / units[present, None]
        total = np.zeros(n)
        if len(document):
            total[present] = np.add.reduceat(np.log(np.maximum((likely * share[document]).sum(axis=1), 1e-30)), starts)
        return share, total


def _slices(texts: list[str]):
    first = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= _SLICE_CHARS:
            yield first, i + 1
            first, chars = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, most_languages: int = MOST_LANGUAGES, fit_chars: int = FIT_CHARS) -> Model:
    """A model from about ``fit_docs`` documents of each of the ``most_languages`` most frequent languages, chosen by a hash of doc_id.

    Only rows outside the held-out fold with text and a language are used. A language gets fewer documents where its share of ``fit_chars``
    wouldn't hold as many, and texts beyond that share alone aren't learned from. Without a training row the model knows no language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)).alias("place"), "doc_id"
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return Model.fit({})
    room = fit_chars // len(counts)
    share = {r["lang"]: min(1.0, max(8 / r["n"], min(fit_docs / r["n"], room / max(1, r["chars"])))) for r in counts}
    limits = F.create_map(*[F.lit(x) for lang, part in share.items() for x in (lang, int(part * (1 << 30)))])
    chosen = known.where((F.col("place") < F.try_element_at(limits, F.col("lang"))) & (F.length("text") <= room)).select("lang", "text", "doc_id").limit(2 * fit_docs * len(counts))
    samples: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Model.fit(samples)


def predicted(spark, model: Model):
    """A column function: the predicted language of a text, for plans that go on with the row."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.languages, model.tables))

    @F.pandas_udf("string")
    def name(texts: pd.Series) -> pd.Series:
        forget_words()
        own, every, out = Model(*sent.value), ["" if t is None else t for t in texts], []
        for first, last in _slices(every):
            share, worded = own.infer(every[first:last])
            share = np.round(share.astype(np.float64), 6)
            out += [own.languages[k] if w else UNDETERMINED for k, w in zip(share.argmax(axis=1), worded)]
        return pd.Series(out)

    return name.asNondeterministic()  # one evaluation, wherever the column is used


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) for each row.

    ``languages`` is the selected set, the largest share first. ``score`` is the share of the predicted
    language. Null texts and those without a letter give ``und`` with score 0, and so does every text where nothing could be
    learned. Ties go to the first language by name. Rows that repeat an id are predicted one by one. An empty table gives an
    empty result.
    """
    model = fit(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.tables))
    fields = {"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64(), "languages": pa.string()}

    def run(parts):
        own = Model(*sent.value)
        for part in parts:
            for some in slices(part, most_rows=4096, most_chars=_SLICE_CHARS):
                share, worded = own.infer(some["text"])
                share = np.round(share.astype(np.float64), 6)
                order = np.argsort(-share, axis=1, kind="stable")
                top = share[np.arange(len(share)), order[:, 0]]
                yield {
                    "doc_id": some["doc_id"],
                    "held_out": some["held_out"],
                    "lang_pred": [own.languages[o[0]] if w else UNDETERMINED for o, w in zip(order, worded)],
                    "score": np.where(worded, np.clip(top, 0, 1), 0.0),
                    "languages": [",".join(own.languages[j] for j in o if s[j] > 0.001) if w else "" for o, s, w in zip(order, share, worded)],
                }

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_columns(columns, run, fields)

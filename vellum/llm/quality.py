"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Two banks of learned filters slide over each
chunk: one over embedded bytes, one over the planes that say, for each small lag, which bytes equal the byte that many places
before. The first knows what junk is spelt like, the second how bytes repeat. Each filter's largest response, over positions
and lags, is kept; the document's largest and mean responses over its chunks make one probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget_words, held_out, labelled_sample, map_columns, slices
from .neural import Adam, logistic_fit, sigmoid

#: Training documents of each class at most, about.
FIT_ROWS = {0: 700, 1: 1100}
CHUNK, STEP, STRIDE, WIDTH, EMBED, FILTERS = 512, 448, 4, 8, 8, 16
#: Stretches of twelve places are numbers of twelve bits, four places apart.
LAGS, LAG_FILTERS, LAG_WIDTH = range(2, 33), 2, 12
POOLED = FILTERS + LAG_FILTERS
PAD = 256
#: Passes over the rows; small samples get as many as make LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, BATCH, RATE = 5, 300, 24, 0.01
THRESHOLD = 0.7
_SLICE_CHUNKS = 256


def chunks_of(data: bytes) -> np.ndarray:
    """int16[n, CHUNK] of bytes, PAD after the end; an empty document is one chunk of padding."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    flat = np.full((n - 1) * STEP + CHUNK, PAD, np.int16)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STEP]


#: The bits of a stretch of LAG_WIDTH places, for every stretch there can be.
_BITS = (np.arange(1 << LAG_WIDTH)[:, None] >> np.arange(LAG_WIDTH) & 1).astype(np.float32)


def lag_codes(chunks: np.ndarray) -> np.ndarray:
    """uint16[n, lags, stretches]: which of LAG_WIDTH places, every STRIDE places, equal the byte ``lag`` places before."""
    low, inside = chunks.astype(np.uint8), chunks != PAD
    same = np.zeros((len(chunks), len(LAGS), CHUNK), bool)
    for k, lag in enumerate(LAGS):
        np.equal(low[:, lag:], low[:, :-lag], out=same[:, k, lag:])
    if not inside.all():
        same &= inside[:, None]
    packed = np.packbits(same, axis=-1, bitorder="little").astype(np.uint16)
    two = packed[:, :, :-1] | packed[:, :, 1:] << 8
    out = np.empty((*two.shape[:2], 2 * two.shape[2]), np.uint16)
    out[:, :, ::2] = two & 0xFFF
    out[:, :, 1::2] = two >> 4
    return out


def _initial() -> dict[str, np.ndarray]:
    random = np.random.default_rng(7)
    embed = random.normal(0, 0.5, (PAD + 1, EMBED))
    embed[PAD] = 0
    weights = {
        "embed": embed,
        "near": random.normal(0, 0.25, (STRIDE * EMBED, FILTERS)),
        "far": random.normal(0, 0.25, (STRIDE * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS),
        "lag": random.normal(0.1, 0.05, (LAG_WIDTH, LAG_FILTERS)),
        "lag_bias": np.zeros(LAG_FILTERS),
        "out": random.normal(0, 0.1, 2 * POOLED),
        "constant": np.zeros(1),
    }
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _byte_responses(weights: dict, chunks: np.ndarray):
    """(largest response [n, FILTERS], its place, the embedded chunk [n, blocks, STRIDE * EMBED])."""
    blocks = weights["embed"].take(chunks, axis=0).reshape(len(chunks), CHUNK // STRIDE, STRIDE * EMBED)
    response = blocks[:, :-1] @ weights["near"]
    response += blocks[:, 1:] @ weights["far"]
    response += weights["bias"]
    response[chunks[:, STRIDE * np.arange(response.shape[1])] == PAD] = 0  # nothing starts there
    at = response.argmax(axis=1)
    return np.take_along_axis(response, at[:, None, :], axis=1)[:, 0], at, blocks


def _lag_responses(weights: dict, codes: np.ndarray):
    """(largest response [n, LAG_FILTERS] over lags and places, where it is)."""
    tables = _BITS.astype(weights["lag"].dtype) @ weights["lag"]
    flat = codes.reshape(len(codes), -1)
    at = np.stack([tables[:, f].copy().take(flat).argmax(axis=1) for f in range(LAG_FILTERS)], axis=1)
    return tables[np.take_along_axis(flat, at, axis=1), np.arange(LAG_FILTERS)] + weights["lag_bias"], at


def _responses(weights: dict, chunks: np.ndarray, codes: np.ndarray):
    """(largest response of every filter [n, POOLED], at least 0; what the gradient needs)."""
    top, at, blocks = _byte_responses(weights, chunks)
    lag_top, lag_at = _lag_responses(weights, codes)
    return np.maximum(np.concatenate([top, lag_top], axis=1), 0), (at, blocks, lag_at)


def _document(top: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.maximum.reduceat(top, starts), np.add.reduceat(top, starts) / counts[:, None]], axis=1)


def _step(weights: dict, chunks: np.ndarray, codes: np.ndarray, counts: np.ndarray, labels: np.ndarray, scale: np.ndarray) -> dict:
    """Gradients of the weighted log loss of one batch of documents."""
    top, (at, blocks, lag_at) = _responses(weights, chunks, codes)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    features = _document(top, starts, counts)
    error = scale * (sigmoid(features @ weights["out"] + weights["constant"]) - labels) / len(labels)
    owner = np.repeat(np.arange(len(counts)), counts)
    back = np.outer(error, weights["out"])
    spread = back[owner, POOLED:] / counts[owner, None]
    largest = features[owner, :POOLED]
    ties = (top == largest) & (top > 0)
    spread += ties * back[owner, :POOLED] / np.maximum(1, np.add.reduceat(ties, starts, axis=0)[owner])
    spread = np.where(top > 0, spread, 0).astype(weights["out"].dtype)
    spread, lag_spread = spread[:, :FILTERS], spread[:, FILTERS:]
    gradients = {"out": features.T @ error, "constant": error.sum(keepdims=True), "bias": spread.sum(axis=0), "lag_bias": lag_spread.sum(axis=0)}
    rows = np.arange(len(chunks))[:, None]
    for name, shift in (("near", 0), ("far", 1)):
        gradients[name] = np.einsum("nfd,nf->df", blocks[rows, at + shift], spread, optimize=True)
    embed = np.zeros_like(weights["embed"])
    for name, shift in (("near", 0), ("far", 1)):
        moved = spread[:, :, None] * weights[name].T[None]  # [n, f, STRIDE * EMBED]
        for i in range(STRIDE):
            np.add.at(embed, chunks[rows, (at + shift) * STRIDE + i], moved[:, :, i * EMBED : (i + 1) * EMBED])
    embed[PAD] = 0
    seen = _BITS[np.take_along_axis(codes.reshape(len(codes), -1), lag_at, axis=1)]  # [n, f, LAG_WIDTH]
    return gradients | {"embed": embed, "lag": np.einsum("nfs,nf->sf", seen, lag_spread)}


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights learned from (text, label) rows; with a single class or none the score is constant."""
    weights, random = _initial(), np.random.default_rng(3)
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        weights["out"][:] = 0
        weights["constant"][:] = 0 if not len(labels) else (4 if labels[0] else -4)
        return weights
    chunks = [chunks_of(t.encode("utf-8", "surrogatepass")) for t, _ in rows]
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    adam = Adam(weights, RATE)
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(rows)))):
        order = random.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            chosen = order[first : first + BATCH]
            own = np.concatenate([chunks[i] for i in chosen])
            adam.update(_step(weights, own, lag_codes(own), np.array([len(chunks[i]) for i in chosen]), labels[chosen], weight[chosen]))
    # The scale of the scores, on whole documents.
    features = np.concatenate([_document(_top(weights, c), np.array([0]), np.array([len(c)])) for c in chunks])
    logits = features @ weights["out"] + weights["constant"]
    beta = logistic_fit(logits[:, None], labels, weight, ridge=0.01)
    weights["out"] = (weights["out"] * beta[0]).astype(np.float32)
    weights["constant"] = (weights["constant"] * beta[0] + beta[1]).astype(np.float32)
    return weights


def _top(weights: dict, chunks: np.ndarray) -> np.ndarray:
    return np.concatenate([_responses(weights, some, lag_codes(some))[0] for some in (chunks[i : i + _SLICE_CHUNKS] for i in range(0, len(chunks), _SLICE_CHUNKS))])


def score_texts(weights: dict, texts: list[str]) -> np.ndarray:
    """The probability of each whole text."""
    out = np.empty(len(texts))
    pending, first, size = [], 0, 0
    for i, text in enumerate(texts):
        pending.append(chunks_of(text.encode("utf-8", "surrogatepass")))
        size += len(pending[-1])
        if size >= 4 * _SLICE_CHUNKS or i + 1 == len(texts):
            counts = np.array([len(c) for c in pending])
            # A long text's chunks are a view of its bytes, which would take many times the room if put together.
            top = _top(weights, np.concatenate(pending)) if size < 8 * _SLICE_CHUNKS else np.concatenate([_top(weights, c) for c in pending])
            features = _document(top, np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
            out[first : i + 1] = sigmoid((features @ weights["out"] + weights["constant"]).astype(np.float64))
            pending, first, size = [], i + 1, 0
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: dict[int, int] | None = None) -> dict[str, np.ndarray]:
    """Weights from at most about ``fit_rows`` labelled training rows of each class."""
    return train(labelled_sample(docs, labels, label, fit_rows or FIT_ROWS))


def scored(docs: DataFrame, weights: dict[str, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    The whole text counts; null is empty, and an empty text has a score too. Rows that repeat an id are scored one by
    one. Only the text reaches the network. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(parts):
        for part in parts:
            for some in slices(part):
                score = score_texts(sent.value, some["text"])
                yield {"doc_id": some["doc_id"], "held_out": some["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_columns(columns, run, {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()})


def probability(spark, weights: dict[str, np.ndarray]):
    """A column function: the score of a text, for plans that go on with the row."""
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        forget_words()
        every = ["" if t is None else t for t in texts]
        return pd.Series(np.concatenate([score_texts(sent.value, every[i : i + 256]) for i in range(0, len(every), 256)] or [np.empty(0)]))

    return score.asNondeterministic()  # one evaluation, wherever the column is used


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled training rows and score every document."""
    return scored(docs, fit(docs, labels))

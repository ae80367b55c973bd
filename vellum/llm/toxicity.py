"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A text is a row of words. A word enters with learned numbers of its own and of its character n-grams, which gradient
descent moves together with the network; those that say how toxic a word or n-gram is start from the log odds of the
training rows, the others at random. Overlapping windows of words pass through the network, which reads each in both
directions and pools its states by attention; a document scores by its highest window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, held_out, labelled_sample, map_columns, shingle_hashes, slices, word_hashes
from .neardup import circulant_signatures
from .neural import Adam, logistic_fit, sigmoid

#: Training documents of each class at most, about.
FIT_ROWS = {0: 1600, 1: 1000}
WINDOW, STEP, MARGIN = 32, 24, 4
GRAMS, BUCKET_BITS, SMOOTH, DOUBT = (4, 5, 6), 18, 2.0, 1.5
#: Free numbers of a word and of a short n-gram; what a word enters with; documents that must have a bucket for it to be learned.
FREE = 2
INPUTS, HIDDEN, ATTENTION = 4 + 2 * FREE, 8, 8
SEEN = 3
#: Rounds over the rows; small samples get as many as make about LEAST_STEPS steps.
EPOCHS, LEAST_STEPS, BATCH, RATE, TABLE_RATE = 5, 60, 64, 0.01, 0.02
THRESHOLD = 0.3
_SLICE_CHARS, _SLICE_WINDOWS = 1 << 19, 4096
_NONE = 1 << BUCKET_BITS  # the bucket of a place without an n-gram

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bytes(texts: list[str]):
    """(words of each text, bucket of each word, first place of each word and the end, byte at each place).

    Words are runs of letters and digits, lower-cased, each with a blank before it.
    """
    lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of_text = np.bincount(np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), starts, "right"), minlength=len(texts))
    blanks = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    own = (word_hashes(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    letters = np.full(blanks[-1], 32, np.uint8)
    place = np.ones(blanks[-1], bool)
    place[blanks[:-1]] = False
    letters[place] = data[inside]
    return of_text, own, blanks, letters


def gram_buckets(letters: np.ndarray, blanks: np.ndarray) -> list[np.ndarray]:
    """Buckets at each place, by size, of the n-grams of words with a blank on either side; _NONE where no n-gram begins."""
    padded = np.full(len(letters) + max(GRAMS), 32, np.uint32)
    padded[: len(letters)] = letters
    count, value, grams = len(letters), padded[: len(letters)].copy(), []
    for n in range(2, max(GRAMS) + 1):
        value *= np.uint32(0x01000193)
        value += padded[n - 1 : n - 1 + count]
        if n in GRAMS:
            buckets = ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            # Places from which n bytes reach beyond the blank after the word.
            for j in range(1, n - 1):
                buckets[np.maximum(blanks[1:] - j, blanks[:-1])] = _NONE
            buckets[blanks[:-1][np.diff(blanks) < n - 1]] = _NONE
            grams.append(buckets)
    return grams


def word_buckets(texts: list[str]):
    """(words of each text, bucket of each word, first place of each word and the end, buckets at each place by size)."""
    of_text, own, blanks, letters = word_bytes(texts)
    return of_text, own, blanks, gram_buckets(letters, blanks)


class Words:
    """The words of all training texts, a byte for each letter; what the network reads is made of some words at a time."""

    def __init__(self, texts: list[str]):
        parts = [word_bytes(texts[at : at + 64]) for at in range(0, len(texts), 64)]
        self.of_text, self._own, self._letters = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3))
        self._blanks = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
        self._half = np.repeat((np.arange(len(texts)) % 2).astype(np.int8), self.of_text)

    def take(self, numbers: np.ndarray):
        """(bucket, first place and the end, buckets at each place by size) of these words, and the half that each is in."""
        sizes = self._blanks[numbers + 1] - self._blanks[numbers]
        here = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(self._blanks[numbers] - here[:-1], sizes) + np.arange(here[-1])
        return (self._own[numbers], here, gram_buckets(self._letters[places], here)), self._half[numbers]


def bucket_counts(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(int[2, 1 + sizes, buckets + 1] documents of each class with a bucket, documents of each class)."""
    out, documents = np.zeros((2, 1 + len(GRAMS), _NONE + 1), np.int32), np.zeros(2)
    for text, label in rows:
        _, own, _, grams = word_buckets([text])
        documents[label] += 1
        for k, buckets in enumerate([own, *grams]):
            out[label, k, distinct(buckets)] += 1
    return out, documents


def log_odds(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the buckets, drawn towards 0 by DOUBT standard errors, so that rare ones say little; 0 where there is no n-gram."""
    share = documents / max(1, documents.sum())
    toxic, clean = (counts[y] + SMOOTH * share[y] + 1e-9 for y in (1, 0))
    odds = np.log(toxic / clean) - np.log((documents[1] + 1e-9) / (documents[0] + 1e-9))
    odds = np.sign(odds) * np.maximum(0, np.abs(odds) - DOUBT * np.sqrt(1 / toxic + 1 / clean))
    odds[:, _NONE] = 0
    return (0.5 * np.clip(odds, -4, 4)).astype(np.float32)


def word_inputs(tables: dict, own: np.ndarray, blanks: np.ndarray, grams: list[np.ndarray], base: np.ndarray | None = None, half: np.ndarray | None = None, keep: bool = False):
    """float32[words, INPUTS]: toxicity of the word, of its most toxic short and long n-gram, the mean, and the free numbers of both.

    ``base`` [halves, 1 + sizes, buckets + 1] is added to the toxicities, by the half of each word.
    """
    out = np.zeros((len(own), INPUTS), np.float32)
    if not len(own):
        return out, None
    sizes = np.diff(blanks)
    each = None if half is None else np.repeat(half, sizes)
    value = lambda k, buckets, rows: tables["toxic"][k].take(buckets) if base is None else tables["toxic"][k].take(buckets) + base[rows, k, buckets]
    out[:, 0] = value(0, own, half)
    total, values = None, []
    for k, buckets in enumerate(grams, 1):
        values.append(value(k, buckets, each))
        column = 1 if k == 1 else 2
        out[:, column] = np.maximum(out[:, column], np.maximum.reduceat(values[-1], blanks[:-1]))
        total = values[-1] if total is None else total + values[-1]
    out[:, 3] = np.add.reduceat(total, blanks[:-1]) / sizes
    out[:, 4 : 4 + FREE] = tables["word"].take(own, axis=0)
    out[:, 4 + FREE :] = np.add.reduceat(tables["gram"].take(grams[0], axis=0), blanks[:-1]) / sizes[:, None]
    return out, (values if keep else None)


def _moves(own, blanks, grams, inputs, values, back):
    """(table, row of it or None, buckets, gradients) of the tables' numbers, from the gradient by the inputs."""
    sizes = np.diff(blanks)
    spread = lambda x: np.repeat(x, sizes, axis=0)
    yield "toxic", 0, own, back[:, 0]
    mean = spread(back[:, 3] / sizes)
    for k, buckets in enumerate(grams, 1):
        column = 1 if k == 1 else 2
        best = (values[k - 1] == spread(inputs[:, column])) & (values[k - 1] > 0)
        yield "toxic", k, buckets, mean + best * spread(back[:, column])
    yield "word", None, own, back[:, 4 : 4 + FREE]
    yield "gram", None, grams[0], spread(back[:, 4 + FREE :] / sizes[:, None])


class Tables:
    """The numbers of words and n-grams, and AdaGrad steps for those that a batch touches."""

    def __init__(self, learned: np.ndarray):
        random = np.random.default_rng(17)
        self.learned = learned  # bool[1 + sizes, buckets + 1]
        free = lambda k: (random.normal(0, 0.1, (_NONE + 1, FREE)) * learned[k][:, None]).astype(np.float32)
        self.numbers = {"toxic": np.zeros((1 + len(GRAMS), _NONE + 1), np.float32), "word": free(0), "gram": free(1)}
        self._squares = {k: np.full_like(v, 1e-8) for k, v in self.numbers.items()}

    def update(self, moves) -> None:
        for name, row, buckets, gradient in moves:
            numbers, squares = self.numbers[name], self._squares[name]
            numbers, squares = (numbers, squares) if row is None else (numbers[row], squares[row])
            known = self.learned[row or int(name == "gram")][buckets]
            touched, place = np.unique(buckets[known], return_inverse=True)
            gradient = gradient[known].reshape(len(place), 1 if gradient.ndim == 1 else FREE)
            total = np.stack([np.bincount(place, g, len(touched)) for g in gradient.T], axis=1).reshape(len(touched), *numbers.shape[1:])
            squares[touched] += total * total
            numbers[touched] -= TABLE_RATE * total / np.sqrt(squares[touched])


def window_words(of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word [WINDOW, n], or -1 where there is none; mask [WINDOW, n]; windows of each text).

    ``MARGIN`` blank words stand on either side of a text, so that its first and last words are read like any other.
    """
    counts = np.maximum(1, -(-(of_text + 2 * MARGIN - (WINDOW - STEP)) // STEP))
    owner = np.repeat(np.arange(len(of_text)), counts)
    number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    word = (number * STEP - MARGIN)[None] + np.arange(WINDOW)[:, None]
    size, first_word = of_text[owner][None], np.concatenate(([0], np.cumsum(of_text)[:-1]))[owner][None]
    return np.where((word >= 0) & (word < size), first_word + word, -1), word < size + MARGIN, counts


def _placed(words: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """The inputs [WINDOW, n, INPUTS] of numbered words; the last row of the padded inputs stands for none."""
    return np.concatenate([inputs, np.zeros((1, INPUTS), np.float32)])[words]


def _initial() -> dict[str, np.ndarray]:
    random = np.random.default_rng(11)
    draw = lambda *shape: (random.normal(0, 1, shape) / shape[0] ** 0.5).astype(np.float32)
    weights = {"attend": draw(2 * HIDDEN, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32), "attend_out": draw(ATTENTION),
               "out": draw(2 * HIDDEN), "constant": np.zeros(1, np.float32)}
    for side in ("forward", "backward"):
        weights[f"{side}_in"] = draw(INPUTS, 3 * HIDDEN)
        weights[f"{side}_state"] = draw(HIDDEN, 3 * HIDDEN)
        weights[f"{side}_bias"] = np.zeros(3 * HIDDEN, np.float32)
    return weights


def _run_side(weights: dict, side: str, inputs: np.ndarray, mask: np.ndarray, keep: bool):
    """States [WINDOW, n, HIDDEN] of one direction, and what its gradient needs."""
    steps, n, _ = inputs.shape
    entering = inputs.reshape(-1, INPUTS) @ weights[f"{side}_in"] + weights[f"{side}_bias"]
    entering = entering.reshape(steps, n, 3 * HIDDEN)
    state_in, states = weights[f"{side}_state"], np.empty((steps, n, HIDDEN), np.float32)
    state, kept = np.zeros((n, HIDDEN), np.float32), []
    for t in range(steps) if side == "forward" else range(steps - 1, -1, -1):
        moved = state @ state_in
        gates = sigmoid(entering[t, :, : 2 * HIDDEN] + moved[:, : 2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        fresh = np.tanh(entering[t, :, 2 * HIDDEN :] + reset * moved[:, 2 * HIDDEN :])
        here = (1 - update) * mask[t][:, None]  # padding leaves the state
        new = state + here * (fresh - state)
        if keep:
            kept.append((t, state, update, reset, fresh, moved[:, 2 * HIDDEN :]))
        states[t] = state = new
    return states, kept


def _forward(weights: dict, inputs: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window."""
    ahead, kept_ahead = _run_side(weights, "forward", inputs, mask, keep)
    behind, kept_behind = _run_side(weights, "backward", inputs, mask, keep)
    states = np.concatenate([ahead, behind], axis=2)
    hidden = np.tanh(states @ weights["attend"] + weights["attend_bias"])
    scores = np.where(mask, hidden @ weights["attend_out"], -30)
    shares = np.exp(scores - scores.max(axis=0))
    shares = shares * mask / np.maximum((shares * mask).sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", shares, states)
    return pooled @ weights["out"] + weights["constant"], (states, hidden, shares, pooled, kept_ahead, kept_behind)


def _gradients(weights: dict, inputs: np.ndarray, mask: np.ndarray, error: np.ndarray, cache) -> tuple[dict, np.ndarray]:
    """Back through pooling, attention and both directions to the inputs; ``error`` is the gradient of the loss by the logits."""
    states, hidden, shares, pooled, kept_ahead, kept_behind = cache
    by_inputs = np.zeros_like(inputs)
    out = {"out": pooled.T @ error, "constant": error.sum(keepdims=True)}
    d_pooled = np.outer(error, weights["out"])
    d_states = shares[:, :, None] * d_pooled
    d_shares = np.einsum("nh,tnh->tn", d_pooled, states)
    d_scores = shares * (d_shares - (shares * d_shares).sum(axis=0))
    out["attend_out"] = np.einsum("tn,tna->a", d_scores, hidden)
    d_hidden = d_scores[:, :, None] * weights["attend_out"] * (1 - hidden**2)
    out["attend"] = np.einsum("tnh,tna->ha", states, d_hidden)
    out["attend_bias"] = d_hidden.sum(axis=(0, 1))
    d_states += d_hidden @ weights["attend"].T
    for side, kept, part in (("forward", kept_ahead, slice(0, HIDDEN)), ("backward", kept_behind, slice(HIDDEN, None))):
        state_in = weights[f"{side}_state"]
        d_in, d_state_in, d_bias = np.zeros_like(weights[f"{side}_in"]), np.zeros_like(state_in), np.zeros(3 * HIDDEN, np.float32)
        carried = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for t, before, update, reset, fresh, moved in reversed(kept):
            carried = carried + d_states[t, :, part]
            live = carried * mask[t][:, None]
            d_update = live * (before - fresh) * update * (1 - update)
            d_fresh = live * (1 - update) * (1 - fresh**2)
            d_reset = d_fresh * moved * reset * (1 - reset)
            d_entering = np.concatenate([d_update, d_reset, d_fresh], axis=1)
            d_moved = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
            d_in += inputs[t].T @ d_entering
            by_inputs[t] += d_entering @ weights[f"{side}_in"].T
            d_bias += d_entering.sum(axis=0)
            d_state_in += before.T @ d_moved
            carried = carried - live * (1 - update) + d_moved @ state_in.T
        out |= {f"{side}_in": d_in, f"{side}_state": d_state_in, f"{side}_bias": d_bias}
    return out, by_inputs


def _logits(weights: dict, inputs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return _forward(weights, inputs, mask)[0]


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, prior: float | None = None) -> dict:
    """Network and tables learned from (text, label) rows; with a single class or none the score is constant.

    Each half of the rows is trained on with the log odds of the other, so that rare words of a document don't vouch for its
    own label. A document learns through its highest window; other documents also through their second.
    """
    rows = without_copies(rows)
    weights, random = _initial(), np.random.default_rng(5)
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        weights["out"][:] = 0
        scale = np.array([1, 4 if len(labels) and labels[0] else -4 if len(labels) else 0], float)
        return {"network": weights, "tables": Tables(np.zeros((1 + len(GRAMS), _NONE + 1), bool)).numbers, "scale": scale}
    counted = [bucket_counts(rows[h::2]) for h in (0, 1)]
    base = np.stack([log_odds(*counted[1]), log_odds(*counted[0])])
    every, documents = counted[0][0] + counted[1][0], counted[0][1] + counted[1][1]
    tables = Tables((every.sum(axis=0) >= SEEN) & (np.arange(_NONE + 1) < _NONE))

    counted = None
    read = Words([t for t, _ in rows])
    words, mask, windows = window_words(read.of_text)
    owner = np.repeat(np.arange(len(rows)), windows)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    adam = Adam(weights, RATE)

    def ranked(values):
        """Windows by document, the highest first, and each one's place in its document."""
        order = np.lexsort((-values, owner))
        first = np.concatenate(([0], np.cumsum(windows)[:-1]))
        return order, np.arange(len(order)) - first[owner[order]]

    def taken(chosen):
        """Of some windows: their words, what these are, the half of each, and the place among them of each window's words."""
        w = words[:, chosen]
        seen = distinct(w[w >= 0])
        return (seen, *read.take(seen), np.where(w >= 0, np.searchsorted(seen, w), len(seen)))

    def valued(score):
        out = []
        for i in range(0, len(owner), _SLICE_WINDOWS):
            some = slice(i, i + _SLICE_WINDOWS)
            _, batch, half, local = taken(some)
            out.append(score(_placed(local, word_inputs(tables.numbers, *batch, base, half)[0]), mask[:, some]))
        return np.concatenate(out)

    values = valued(lambda x, _: x[:, :, 1:3].max(axis=2).max(axis=0) + x[:, :, 0].max(axis=0))
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // (4 * len(rows))))):
        order, place = ranked(values)
        used = order[(place == 0) | ((place == 1) & (labels[owner[order]] == 0))]
        for _ in range(2):
            random.shuffle(used)
            for at in range(0, len(used), BATCH):
                chosen = used[at : at + BATCH]
                m, y = mask[:, chosen], labels[owner[chosen]]
                seen, batch, half, local = taken(chosen)
                got, kept = word_inputs(tables.numbers, *batch, base, half, keep=True)
                x = _placed(local, got)
                logits, cache = _forward(weights, x, m, keep=True)
                error = (weight[owner[chosen]] * (sigmoid(logits) - y) / len(chosen)).astype(np.float32)
                gradients, by_inputs = _gradients(weights, x, m, error, cache)
                adam.update(gradients)
                if len(seen):
                    back = np.stack([np.bincount(local.ravel(), by_inputs[:, :, c].ravel(), len(seen) + 1)[:-1] for c in range(INPUTS)], axis=1).astype(np.float32)
                    tables.update(_moves(*batch, got, kept, back))
        values = valued(lambda x, m: _logits(weights, x, m))
    order, place = ranked(values)
    top = values[order[place == 0]]
    scale = logistic_fit(top[:, None], labels, _prior_weights(labels, prior), ridge=0.01)
    tables.numbers["toxic"] += log_odds(every, documents)
    return {"network": weights, "tables": tables.numbers, "scale": scale}


def without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows that aren't near copies of an earlier one, so that the words of a copied text count once."""
    seen: list[set] = [set() for _ in range(8)]
    out = []
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        for row, signature in zip(some, circulant_signatures([shingle_hashes(t) for t, _ in some], len(seen)).tolist()):
            if sum(x in own for x, own in zip(signature, seen)) < 3:
                out.append(row)
                for x, own in zip(signature, seen):
                    own.add(x)
    return out


def _prior_weights(labels: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights under which the sample has the share of toxic documents that the labelled rows have."""
    share = labels.mean()
    prior = share if prior is None else prior
    return np.where(labels == 1, prior / share, (1 - prior) / (1 - share))


def score_texts(model: dict, texts: list[str]) -> np.ndarray:
    """The probability of each whole text, over all its windows."""
    weights, out = model["network"], np.empty(len(texts))
    first = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= _SLICE_CHARS or i + 1 == len(texts):
            of_text, own, blanks, grams = word_buckets(texts[first : i + 1])
            inputs = word_inputs(model["tables"], own, blanks, grams)[0]
            words, mask, counts = window_words(of_text)
            logits = np.concatenate([_logits(weights, _placed(words[:, j : j + _SLICE_WINDOWS], inputs), mask[:, j : j + _SLICE_WINDOWS]) for j in range(0, len(mask[0]), _SLICE_WINDOWS)])
            top = np.maximum.reduceat(logits, np.concatenate(([0], np.cumsum(counts)[:-1])))
            slope, constant = model["scale"]
            out[first : i + 1] = sigmoid(np.clip(slope * top.astype(np.float64) + constant, -500, 500))
            first, chars = i + 1, 0
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: dict[int, int] | None = None) -> dict:
    """A model from at most about ``fit_rows`` labelled training rows of each class."""
    shares = {r[0]: r[1] for r in labels.where(F.col(label).isNotNull() & ~held_out()).groupBy(F.col(label).cast("int")).count().collect()}
    prior = shares.get(1, 0) / max(1, shares.get(0, 0) + shares.get(1, 0))
    return train(labelled_sample(docs, labels, label, fit_rows or FIT_ROWS), prior=prior)


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    The whole text counts; null is empty, and an empty text has a score too. Rows that repeat an id are scored one by
    one. Only the text reaches the network. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        for part in parts:
            for some in slices(part):
                score = score_texts(sent.value, some["text"])
                yield {"doc_id": some["doc_id"], "held_out": some["held_out"], "score": score, "predicted": (score >= threshold).astype(np.int32)}

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_columns(columns, run, {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()})


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled training rows and score every document."""
    return scored(docs, fit(docs, labels))

"""Toxicity, quality and language: learning, whole texts, odd rows, gradients, held-out accuracy."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from vellum.llm import bpe, fingerprints, language, neardup, packing, quality, queries, secrets, toxicity
from vellum.llm.common import distinct, shingle_hashes

from .helpers import ODD, docs

SF = "/root/testdata/sf0.01"


def made(n, seed, bad):
    """Texts of invented words; those with label 1 hold a word with a marked stem somewhere."""
    random = np.random.default_rng(seed)
    syllables = ["ta", "ro", "mi", "nel", "ka", "sho", "lin", "ver", "do", "as"]
    word = lambda: "".join(random.choice(syllables, random.integers(1, 4)))
    rows = []
    for i in range(n):
        words, y = [word() for _ in range(random.integers(20, 300))], int(i % 3 == 0)
        if y:
            words[random.integers(len(words))] = bad + word()
        rows.append((" ".join(words), y))
    return rows


def test_toxicity_learns_a_stem_anywhere():
    model = toxicity.train(made(500, 1, "zurg"), epochs=6)
    rows = made(200, 2, "zurg")
    got = toxicity.score_texts(model, [t for t, _ in rows]) >= 0.3
    assert np.mean(got == np.array([y for _, y in rows], bool)) > 0.95
    clean = " ".join(["taro minel kasho"] * 4000)
    assert toxicity.score_texts(model, [clean, clean + " zurgmi", "zurgmi " + clean])[1:].min() > 0.3


def test_toxicity_gradients():
    random = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in toxicity._initial().items()}
    x = random.normal(size=(toxicity.WINDOW, 3, toxicity.INPUTS))
    mask = np.arange(toxicity.WINDOW)[:, None] < np.array([32, 5, 1])
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda w, x: float(np.sum(np.logaddexp(0, (z := toxicity._forward(w, x, mask)[0])) - y * z))
    logits, cache = toxicity._forward(weights, x, mask, keep=True)
    gradients, by_inputs = toxicity._gradients(weights, x, mask, toxicity.sigmoid(logits) - y, cache)

    def slope(value, at, of):
        moved = value.copy()
        moved[at] += 1e-3
        up = of(moved)
        moved[at] -= 2e-3
        return (up - of(moved)) / 2e-3

    for name, value in weights.items():
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 4)]:
            assert abs(slope(value, at, lambda v: loss(weights | {name: v}, x)) - gradients[name][at]) < 2e-3, name
    for at in [(0, 0, 0), (4, 1, 3), (20, 0, toxicity.INPUTS - 1), (9, 1, 0)]:  # the last is padding
        assert abs(slope(x, at, lambda v: loss(weights, v)) - by_inputs[at]) < 2e-3


def test_toxicity_table_gradients():
    """What moves the numbers of words and n-grams is the gradient of the inputs."""
    random = np.random.default_rng(3)
    _, own, blanks, grams = toxicity.word_buckets(["some words to read, words again"])
    tables = toxicity.Tables(np.ones((1 + len(toxicity.GRAMS), toxicity._NONE + 1), bool)).numbers
    tables = {k: np.abs(random.normal(size=v.shape)) for k, v in tables.items()}
    tables["toxic"][:, toxicity._NONE] = 0
    back = random.normal(size=(len(own), toxicity.INPUTS))
    inputs, values = toxicity.word_inputs(tables, own, blanks, grams, keep=True)
    inputs = inputs.astype(np.float64)
    for k in range(len(grams)):  # the exact inputs, so that the most toxic n-gram is found again
        column = 1 if k == 0 else 2
        inputs[:, column] = np.maximum.reduceat(values[k], blanks[:-1]) if k < 2 else np.maximum(inputs[:, column], np.maximum.reduceat(values[k], blanks[:-1]))
    moved = {k: np.zeros_like(v) for k, v in tables.items()}
    for name, row, buckets, gradient in toxicity._moves(own, blanks, grams, inputs, values, back):
        np.add.at(moved[name] if row is None else moved[name][row], buckets, gradient)
    of = lambda t: float((toxicity.word_inputs(t, own, blanks, grams)[0] * back).sum())
    for name, at in [("toxic", (0, own[1])), ("toxic", (1, grams[0][0])), ("toxic", (2, grams[1][blanks[1]])), ("word", (own[0], 1)), ("gram", (grams[0][1], 0))]:
        up, down = ({k: v.copy() for k, v in tables.items()} for _ in range(2))
        up[name][at] += 0.01
        down[name][at] -= 0.01
        assert abs((of(up) - of(down)) / 0.02 - moved[name][at]) < 2e-3, (name, at)


def test_word_grams_stay_in_words():
    """N-grams of each word with a blank on either side, whatever stands around it."""
    text = "ab, c defg-é1"
    _, own, blanks, grams = toxicity.word_buckets([text])
    assert len(own) == len(blanks) - 1 == 4
    alone = {w: toxicity.word_buckets([w]) for w in ("ab", "c", "defg", "é1")}
    kept = lambda x: x[x != toxicity._NONE].tolist()
    for k, n in enumerate(toxicity.GRAMS):
        want = [b for w in ("ab", "c", "defg") for b in kept(alone[w][3][k])]
        assert kept(grams[k])[: len(want)] == want
        assert len(kept(alone["defg"][3][k])) == 4 + 2 - n + 1
        assert len(kept(alone["c"][3][k])) == max(0, 3 - n + 1)


def test_quality_gradients():
    weights = {k: v.astype(np.float64) for k, v in quality._initial().items()}
    weights["lag_bias"][:] = 0.05  # away from the bend at 0
    chunks = np.concatenate([quality.chunks_of(b"some text here " * 20), quality.chunks_of(b"OTHER!! "), quality.chunks_of(b"x y z" * 300)])
    codes, counts, y, scale = quality.lag_codes(chunks), np.array([1, 1, len(chunks) - 2]), np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss(w):
        top = quality._responses(w, chunks, codes)[0]
        z = quality._document(top, np.concatenate(([0], np.cumsum(counts)[:-1])), counts) @ w["out"] + w["constant"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    gradients = quality._step(weights, chunks, codes, counts, y, scale)
    for name in ("near", "far", "bias", "lag", "lag_bias", "out", "constant"):
        value = weights[name]
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 5)]:
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += 1e-5
            up = loss(moved)
            moved[name][at] -= 2e-5
            assert abs((up - loss(moved)) / 2e-5 - gradients[name][at]) < 1e-3, name


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 960, 961, 5000])
def test_quality_chunks_cover_everything(size):
    data = bytes(np.random.default_rng(size).integers(1, 255, size, np.uint8))
    chunks = quality.chunks_of(data)
    back = np.concatenate([chunks[0], *(c[quality.CHUNK - quality.STEP :] for c in chunks[1:])])
    assert bytes(back[back != quality.PAD].astype(np.uint8)) == data


def test_quality_lag_codes():
    data = b"abcdabcdabcdxyz" * 30
    chunks = quality.chunks_of(data)
    codes = quality.lag_codes(chunks)
    assert codes.shape == (len(chunks), 31, 126)
    for n, k, place in [(0, 2, 0), (0, 2, 1), (0, 13, 7), (0, 0, 3), (len(chunks) - 1, 2, 125)]:
        lag, chunk = quality.LAGS[k], chunks[n]
        want = [chunk[t] != quality.PAD and t >= lag and chunk[t] == chunk[t - lag] for t in range(4 * place, 4 * place + 12)]
        assert [bool(codes[n, k, place] >> i & 1) for i in range(12)] == want


def test_quality_learns_repetition():
    """Words said again and again are told from others by the learned lag filters, whatever the words."""
    random = np.random.default_rng(9)
    word = lambda: "".join(random.choice(list("abdeinorstu"), random.integers(2, 9)))
    clean = lambda: " ".join(word() for _ in range(60))
    junk = lambda: " ".join(w for _ in range(6) for w in [word()] * 12)
    weights = quality.train([(clean(), 1) for _ in range(150)] + [(junk(), 0) for _ in range(50)])
    got = quality.score_texts(weights, [clean() for _ in range(40)] + [junk() for _ in range(40)]) >= 0.7
    assert got[:40].mean() > 0.94 and got[40:].mean() < 0.06


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_are_of_each_text_alone(module):
    texts = ["a b c", "", "word " * 3000, "ä😀 x", "REPEAT!! " * 50]
    model = module.train([(t + str(i), i % 2) for i, t in enumerate(texts * 6)], epochs=1)
    whole = module.score_texts(model, texts)
    assert np.allclose(whole, [module.score_texts(model, [t])[0] for t in texts], atol=1e-5)
    assert ((whole >= 0) & (whole <= 1)).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scored_on_odd_rows(spark, module):
    model = module.train([(f"text {i} " * 9, i % 2) for i in range(30)], epochs=1)
    got = module.scored(docs(spark, ODD, extra=True), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert module.scored(docs(spark, []), model).count() == 0
    assert len(set(module.score_texts(module.train([("only", 1)] * 3), ["a", "b c"]).tolist())) == 1
    assert module.score_texts(module.train([]), ["a"])[0] == 0.5


def held_out_shares(spark, folder, query, label, found):
    """(accuracy, recall and precision of label ``found``) on labelled held-out rows."""
    got = {r.doc_id: r for r in queries.QUERIES[query](spark, folder).collect()}
    rows = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r.doc_id].held_out and r[label] is not None]
    truth, said = np.array([r[label] == found for r in rows]), np.array([got[r.doc_id].predicted == found for r in rows])
    return (truth == said).mean(), said[truth].mean(), truth[said].mean()


def test_held_out_quality(spark):
    accuracy, recall, precision = held_out_shares(spark, SF, "op2_quality_classifier", "quality", 0)
    assert accuracy >= 0.97 and recall >= 0.94 and precision >= 0.95


def test_held_out_toxicity(spark):
    """On the largest of the small tables; some labels there say toxic of texts with no such word."""
    accuracy, recall, precision = held_out_shares(spark, "/root/testdata/sf0.1", "op1_toxicity", "toxic", 1)
    assert accuracy >= 0.97 and recall >= 0.92 and precision >= 0.88


def test_language_query(spark):
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    hits = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out and r.lang]
    assert len(got) == len(rows) and np.mean(hits) >= 0.97


ENGLISH, GERMAN = ["the cat and the dog went home with that man "] * 20, ["der hund und die katze ging nicht nach haus "] * 20


def test_language_mixtures():
    model = language.Model.fit({"de": GERMAN, "en": ENGLISH})
    texts = [ENGLISH[0] * 9, GERMAN[0] * 9, ENGLISH[0] * 20 + GERMAN[0] * 10, "", "123 !?", "hund"]
    share, worded = model.infer(texts)
    assert worded.tolist() == [True, True, True, False, False, True]
    assert share[0].tolist() == [0, 1] and share[1].tolist() == [1, 0] and share[5].argmax() == 0
    assert abs(share[2][1] - 2 / 3) < 0.08 and np.allclose(share[2].sum(), 1, atol=1e-5)
    for i, t in enumerate(texts):
        assert np.allclose(model.infer([t])[0][0], share[i], atol=1e-5)


def test_language_on_odd_rows(spark):
    table = docs(spark, [(i, t, None, None) for i, t in ODD] + [(100 + i, t, lang, "s") for lang, own in (("en", ENGLISH), ("de", GERMAN)) for i, t in enumerate(own)], extra=True)
    got = language.identified(table).collect()
    assert len(got) == len(ODD) + 40
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and by[6].lang_pred in ("en", "de")
    assert language.identified(docs(spark, [])).count() == 0
    nothing = language.identified(docs(spark, [(1, "x", None, None), (2, None, "en", "s")])).collect()
    assert [(r.lang_pred, r.score, r.languages) for r in nothing] == [("und", 0.0, "")] * 2


def _frequent(rows, n):
    """The most frequent invented languages of the rows that may be learned from."""
    known = [r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2 and r[2] != "en"]
    return sorted(set(known), key=lambda x: (-known.count(x), x))[:n]


def test_language_samples_are_bounded(spark):
    rows = [(i, "wort und satz " * 40, f"l{i % 7}", "s") for i in range(70)] + [(100 + i, "more of it", "en", "s") for i in range(60)]
    assert language.fit(docs(spark, rows), most_languages=3).languages == sorted({"en", *_frequent(rows, 2)})
    # Texts beyond a language's share of the characters alone aren't learned from.
    model = language.fit(docs(spark, [*rows, (500, "x" * 5000, "en", "s")]), fit_chars=4000, most_languages=2)
    assert len(model.languages) == 2 and "en" in model.languages


def test_language_of_a_second_language():
    """A language worth more than one cost stays, however many others were learned."""
    names = ["der hund und die katze ging nicht", "the cat and the dog went home", "le chat et le chien sont ici avec", "el gato y el perro fueron a casa"]
    model = language.Model.fit({n: [t] * 20 for n, t in zip(("de", "en", "fr", "es"), names)})
    share = model.infer([names[1] * 1 + " " + (names[1] + " ") * 12 + names[0] + " " + names[0]])[0][0]
    assert [model.languages[i] for i in np.flatnonzero(share > 0.01)] == ["de", "en"]


BIG = (1 << 53) + 1


@pytest.mark.parametrize("run", [
    lambda t: quality.scored(t, quality.train([("a b", 0), ("c d", 1)], epochs=1)), lambda t: toxicity.scored(t, toxicity.train([("a b", 0), ("c d", 1)], epochs=1)),
    language.identified, secrets.secret_scan, neardup.minhash_near_dedup, fingerprints.compare_with_edits, fingerprints.fingerprints,
    lambda t: packing.pack_documents(t, public_tokenizers.path("word_bpe_49k.json")), lambda t: bpe.encoded(t, public_tokenizers.path("byte_bpe_50k.tiktoken")),
])
def test_large_ids_beside_a_null(spark, run):
    got = run(docs(spark, [(BIG, "one text of words", "en", "s"), (None, "another", "en", "s"), (BIG + 2, "one more text here", "en", "s")])).collect()
    assert sorted(str(r.doc_id) for r in got) == [str(BIG), str(BIG + 2), "None"]


@pytest.mark.parametrize("label, rows", [("quality", []), ("toxic", []), ("quality", [(1, 0, 1), (1, 1, 0)]), ("toxic", [(1, 0, 1), (1, 1, 0)])])
def test_fitting_on_nothing(spark, label, rows):
    """Without labels, or with labels that disagree on every id, the score is constant; so it is without documents."""
    module = quality if label == "quality" else toxicity
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    table = docs(spark, [(1, "some text"), (1, "other text"), (2, "third")])
    for own in (table, docs(spark, [])):
        model = module.fit(own, labels)
        assert set(module.score_texts(model, ["a", "b"])) == {0.5}


def test_shingles():
    plain = lambda t: {" ".join(w[i : i + 5]) for w in [t.encode().lower().split()] and [[x.decode("utf-8", "surrogatepass") for x in t.encode().lower().split()]] for i in range(max(1, len(w) - 4)) if w}
    for text in ("", " \t", "a", "A b  c\nd", "a b c d e", "a b c d e f", "a a a a a a a", "É b\x0bc d e\x85f g " * 50):
        assert len(shingle_hashes(text)) == len(plain(text))
    assert shingle_hashes("A B c d e f").tolist() == shingle_hashes("a b  C d e F").tolist() != shingle_hashes("É b c d e f").tolist()
    long = "x" * (1 << 20) + " " + "y" * 5 + " " + "word " * 300_000
    assert len(shingle_hashes(long)) == 3 == len(plain(long))
    assert distinct(np.array([3, 1, 3], np.uint64)).tolist() == [1, 3]

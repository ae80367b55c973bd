"""What training holds on the driver."""

import tracemalloc

import numpy as np

from vellum.llm import toxicity


def test_training_holds_few_bytes_for_a_letter():
    random = np.random.default_rng(3)
    words = np.array(["".join(random.choice(list("abcdefghij"), random.integers(2, 9))) for _ in range(5000)])
    long, short = ([(" ".join(random.choice(words, n)), i % 2) for i in range(300)] for n in (2500, 25))
    peaks = []
    for rows in (short, long):
        tracemalloc.start()
        toxicity.train(rows, epochs=1)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 25 * sum(len(t) for t, _ in long)
    assert peaks[1] < 200 << 20


def test_words_taken_are_what_whole_texts_give():
    texts = ["Some words to read, a b c", "", "été 12 x", "- -", "last Words"]
    of_text, own, blanks, grams = toxicity.word_buckets(texts)
    read = toxicity.Words(texts)
    assert read.of_text.tolist() == of_text.tolist() == [7, 0, 3, 0, 2]
    (buckets, places, by_size), half = read.take(np.arange(len(own)))
    assert buckets.tolist() == own.tolist() and places.tolist() == blanks.tolist()
    assert [x.tolist() for x in by_size] == [x.tolist() for x in grams]
    assert half.tolist() == [0] * 12
    for i in range(len(own)):
        (bucket, _, alone), _ = read.take(np.array([i]))
        assert bucket.tolist() == [own[i]] and [x.tolist() for x in alone] == [x[blanks[i] : blanks[i + 1]].tolist() for x in grams]
    (none, places, by_size), half = read.take(np.empty(0, np.int64))
    assert not len(none) and places.tolist() == [0] and not any(map(len, by_size)) and not len(half)

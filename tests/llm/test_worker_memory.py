"""What a Python worker is given at once, and what it keeps."""

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.llm import common, packing
from vellum.llm.queries import tokenizer_file


def test_texts_reach_workers_in_small_batches(spark):
    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("some text "), 1000).alias("text"))
    sizes = [r.n for r in common.map_columns(rows, lambda parts: ({"n": [sum(map(len, p["text"]))]} for p in parts), {"n": pa.int64()}).collect()]
    assert sum(sizes) == 30_000_000
    assert max(sizes) < 6_000_000


def test_a_worker_drops_kept_words_for_other_work():
    coder = packing.Words(tokenizer_file("word_bpe_49k.json"))
    texts = ["some words, and\nsome others", "", "more words"]
    ids = coder.encode(texts)
    kept = coder._known
    assert len(kept) > 1 and kept.room < 256 << 20
    common.forget_words()
    assert dict(kept) == {"": b""} and kept.room == 256 << 20
    assert coder.encode(texts) == ids

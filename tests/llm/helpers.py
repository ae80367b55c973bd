"""Small tables for the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for row in rows:
        i, text, lang, source = (*row, None, None)[:4] if len(row) < 4 else row
        full.append((i, text, lang, source, None if text is None else len(text)))
    out = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "kept", "row", "bucket", "key", "rep", "n", "root", "piece", "unit", "found", "owner", "spans", "last"):
            out = out.withColumn(name, F.lit("x"))
    return out


#: Null and empty texts, blanks, a long text, ties, repeated rows, a null id.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "one two"), (6, "word " * 30_000), (7, "aé中\U0001f600 \x85 b c\r\n\td"),
    (None, "no id here at all, is there"), (8, "x" * 5000), (9, "'s 's\n\n 12 \n  y"), (10, "<|endoftext|> ٣ 1٣"),
]

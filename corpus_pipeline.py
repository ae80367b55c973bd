"""Corpus preparation in five stages; each takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Language ID drops documents without words; the quality classifier drops
those it takes for junk; of near duplicates the least id stays; secrets are masked; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import language, neardup, packing, quality, secrets
from vellum.llm.common import labelled_sample, marked, skew_join, table, written
from vellum.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of undetermined language and names the language of those that had none.

    The texts stay where they were read. Without a training row nothing can be told and nothing goes.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs)
    if not model.languages:
        return docs
    named = docs.withColumn("_lang", language.predicted(spark, model)("text")).where(F.col("_lang") != language.UNDETERMINED)
    return named.withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores below its threshold; the texts stay where they were read.

    Without training rows of both classes nothing can be told and nothing goes.
    """
    docs = docs.select(*COLUMNS)
    rows = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", quality.FIT_ROWS)
    if len({y for _, y in rows}) < 2:
        return docs
    weights = quality.train(rows)
    return docs.where(quality.probability(spark, weights)("text") >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id stays, or one without an id where none has one.

    Groups are made of texts, not of ids: rows that repeat an id with other texts are judged one by one, and those that
    repeat both come down to one. Rows without a word have no duplicates. Only texts that may go shuffle.
    """
    docs = docs.select(*COLUMNS)
    row = ["doc_id", "place"]
    groups = neardup.linked_rows(docs, by_id=False).where("cid IS NOT NULL").groupBy("cid", *row).agg(F.count("*").alias("n"))
    best = groups.groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), *row)).alias("best"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("place") == F.col("best.place"))
    judged = skew_join(groups, best, ["cid"]).select(*row, "n", stays.alias("stays"))
    touched = written(judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "stays"), "judged")

    every = marked(docs.withColumn("_place", F.xxhash64("text")), touched.select("_place"), "_place")
    known = every.where("_maybe").join(touched.hint("merge").withColumnRenamed("_place", "_at"), (F.col("_place") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    once = known.where("stays").dropDuplicates(["doc_id", "_place"])
    return every.where("NOT _maybe").select(*COLUMNS).unionByName(known.where("stays IS NULL").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks what the secret scan finds; every document stays."""
    return secrets.redacted(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes the documents and packs them into training sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_classifier", drop_junk),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack),
]

#: A learned classifier, MinHash and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result but the last written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

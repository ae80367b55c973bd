"""Documents from folders, and the cache of earlier results."""

from __future__ import annotations

import fnmatch
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)
PATTERN = "*.{md,markdown,mdx,wiki,mediawiki}"


def excluded(file: Column, patterns: list[str]) -> Column:
    """Whether the whole path matches one of the shell patterns, whose * crosses folders."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | file.rlike("^" + fnmatch.translate(pattern).replace(r"\Z", "").replace(r"\z", "") + "$")
    return out


def read_documents(spark: SparkSession, paths: list[str], exclude: list[str] = ()) -> DataFrame:
    """(file, content, error) of the markup files under ``paths``.

    Paths that name a file are taken whatever ``exclude`` says; missing ones are passed over with a warning. Bytes that aren't UTF-8 give a null content and an error; any store that
    Spark reads will do.
    """
    out = None
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            _log.warning("no such path: %s", path)
            continue
        single = path.rsplit("/", 1)[-1].rpartition(".")[2] in PATTERN[3:-1].split(",")
        reader = spark.read.format("binaryFile")
        files = reader.load(path) if single else reader.option("recursiveFileLookup", "true").option("pathGlobFilter", PATTERN).load(path)
        file = F.regexp_replace("path", "^file:(//)?", "")
        rows = files.select(file.alias("file"), "content")
        rows = rows if single else rows.where(~excluded(F.col("file"), list(exclude)))
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "file string, content string, error string")
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return out.select("file", F.when(valid, text).alias("content"), F.when(~valid, "not UTF-8").alias("error"))


def content_key(content: Column, ruleset: str) -> Column:
    """What a cached result is valid for: the content and the rules that made it."""
    return F.sha2(F.concat(content, F.lit("\0" + ruleset)), 256)


def changed(documents: DataFrame, cache: DataFrame, ruleset: str) -> DataFrame:
    """``documents`` (file, content) that ``cache`` (file, content_key) has no result of, with their content_key."""
    keyed = documents.withColumn("content_key", content_key(F.col("content"), ruleset))
    return keyed.join(cache.select("file", "content_key").distinct(), ["file", "content_key"], "left_anti")


def read_page_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(key, json): API reference pages from a folder of JSON files, known by their own identifier."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return rows.select(F.get_json_object("value", "$.identifier.url").alias("key"), F.col("value").alias("json"))

"""Linting with results kept from earlier runs: only documents whose content or rules changed are linted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import written
from .engine import COLUMNS, GovernanceEngine

_FIELDS = [*COLUMNS, "check_no", "emit_no"]
_VIOLATION = "struct<rule_id:string,message:string,severity:string,file:string,line:int,column:int,suggestion:string,context:string,check_no:int,emit_no:int>"
_SCHEMA = f"file string, content_key string, violations array<{_VIOLATION}>"


def _exists(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def lint_cached(engine: GovernanceEngine, documents: DataFrame, path: str) -> DataFrame:
    """The violations of ``documents`` (file, content), from the cache at ``path`` or linted now and added to it.

    An entry is a file with the digest of its content and of the rules, and its violations, if any; entries are only ever
    added, so a reader never sees one half written.
    """
    spark, ruleset = documents.sparkSession, engine.ruleset()
    known = spark.read.schema(_SCHEMA).parquet(path) if _exists(spark, path) else spark.createDataFrame([], _SCHEMA)
    new = written(files.changed(documents.where("content IS NOT NULL").select("file", "content"), known, ruleset), "changed")
    found = engine.lint(new).select(*_FIELDS)
    grouped = found.groupBy("file").agg(F.collect_list(F.struct(*_FIELDS)).alias("violations"))
    entries = new.select("file", "content_key").join(grouped, "file", "left").select("file", "content_key", F.coalesce("violations", F.array().cast(f"array<{_VIOLATION}>")).alias("violations"))
    entries.write.mode("append").parquet(path)
    wanted = documents.where("content IS NOT NULL").select("file", files.content_key(F.col("content"), ruleset).alias("content_key"))
    kept = spark.read.schema(_SCHEMA).parquet(path).dropDuplicates(["file", "content_key"])
    return kept.join(wanted.distinct(), ["file", "content_key"], "left_semi").select(F.inline("violations"))

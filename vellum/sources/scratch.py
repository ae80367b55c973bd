"""Tables written between the steps of a job, in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, in local mode only, a folder that goes with this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="vellum-"))
            atexit.register(shutil.rmtree, _local[0], True)
        root = "file://" + _local[0]
    return root.rstrip("/") + "/vellum"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: cuts the lineage and survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes[-1:]:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` left since its begin: use it around work whose results are out by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``written`` left; call it once no result that reads them is still needed."""
    _delete(spark, scratch_root(spark))

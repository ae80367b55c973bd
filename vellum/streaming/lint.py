"""Linting a stream of documents. Each rule sees one document at a time, so every micro-batch is a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import COLUMNS, GovernanceEngine


def lint_stream(documents: DataFrame, path: str, checkpoint: str, engine: GovernanceEngine | None = None, **trigger) -> StreamingQuery:
    """Write the violations of a stream of (file, content) as Parquet under ``path``.

    A batch that is run again writes its own folder again, so violations are there once whatever is retried.
    """
    own = engine or GovernanceEngine()

    def run(batch: DataFrame, number: int) -> None:
        own.lint(batch).select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Depth-bounded traversal of a link graph, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written


def crawl(spark: SparkSession, edges: DataFrame, roots: DataFrame, known: DataFrame | None = None, max_depth: int = 2) -> DataFrame:
    """(node, depth): the nodes reachable from ``roots`` (node), with their least depth.

    ``edges``: (src, dst). The roots' own links are followed whatever ``max_depth`` says; from then on nodes of less than that depth
    are. Where ``known`` (node) is given, other nodes are neither listed nor followed. Each level is a join of the frontier
    with the edges and an anti join with what was seen.
    """
    seen = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier, depth = seen, 0
    while depth < max(1, max_depth):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        found = found.join(seen.select("node"), "node", "left_anti")
        if known is not None:
            found = found.join(known.select("node").distinct(), "node", "left_semi")
        depth += 1
        frontier = written(found.withColumn("depth", F.lit(depth)), "crawl")
        if not frontier.take(1):
            break
        seen = seen.union(frontier)
    return seen


def top_k_by_cosine(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the ``k`` vectors nearest to ``query``, ties by id; Spark keeps k rows in each task."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    own = F.transform(vector_col, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(own, wanted, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(own, lambda a: a * a), F.lit(0.0), lambda s, x: s + x))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    scored = vectors.select(id_col, F.when((norm > 0) & (F.lit(size) > 0), dot / (norm * size)).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), id_col).limit(k)

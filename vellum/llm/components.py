"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import skew_join, written

MOST_ROUNDS = 40


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One half round over edges (hi, lo): every node's neighbours are tied to the least of them and itself.

    ``larger_only``: only the neighbours above the node move, else the node and those below it.
    """
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    if larger_only:
        both = both.union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = skew_join(both, least, ["u"])
    if larger_only:
        moved = moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type): root is the least node reachable.

    Alternating large-star and small-star rounds: each is an aggregate, a join and a distinct, so no
    task and no driver holds a component. Rounds stop when every edge points at a root; their number
    grows with the logarithm of the nodes. Null ends and self loops are ignored; an empty table gives
    an empty result. Each round is written to the shared folder, which cuts the lineage.
    """
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = written(now, label)
    for _ in range(MOST_ROUNDS):
        # A star forest: no node is both above and below, and none has two parents.
        parents = now.groupBy("hi").agg(F.count("*").alias("n"))
        tangled = parents.where("n > 1").select(F.lit(1).alias("x")).union(now.join(parents.select(F.col("hi").alias("lo")), "lo", "left_semi").select(F.lit(1).alias("x")))
        if not tangled.take(1):
            break
        now = written(_towards_least(written(_towards_least(now, True), label), False), label)
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())

"""Connected components of a distributed graph by contraction.

Each round hooks every node to its smallest neighbour, follows the hooks to their roots by pointer jumping, and
contracts the edges to edges between roots, until none is left. Nothing but flags reaches the driver. Every join has
checkpointed rows of two numbers on both sides, so that adaptive execution can split a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _jump(hooks: DataFrame) -> DataFrame:
    parents = hooks.select(F.col("node").alias("root"), F.col("root").alias("__next"))
    return hooks.join(parents, "root", "left").select("node", F.coalesce("__next", "root").alias("root"), (F.coalesce("__next", "root") != F.col("root")).alias("moved"))


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, root) from (node, root) in which a root is smaller than its node or is itself, followed to the end. Two jumps a
    cut; when the second moves nothing, the end is reached."""
    while True:
        jumped = cut(_jump(_jump(hooks).drop("moved")))
        hooks = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return hooks


def follow(hooks: DataFrame) -> DataFrame:
    """(node, root) of a forest: ``hooks`` has for each node but the roots its parent, which is smaller. Roots are added."""
    tops = hooks.select(F.col("root").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti")
    return _roots(cut(hooks.unionByName(tops.withColumn("root", F.col("node")))))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b), the smallest node that it reaches. Loops and repeats are harmless."""
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        hooks = _roots(cut(hooks))
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("__to"))
        if labels is None:
            labels = hooks
        else:
            labels = labels.join(step, "root", "left")
            labels = cut(labels.select("node", F.coalesce("__to", "root").alias("root")))
        for end in ("a", "b"):
            to = hooks.select(F.col("node").alias(end), F.col("root").alias("__to"))
            edges = edges.join(to, end).drop(end).withColumnRenamed("__to", end).select("a", "b")
        edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

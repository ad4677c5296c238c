"""Connected components of edge tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import durable, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): nodes of a component share the label, one of them.

    Each round maps every node to its neighbours' least (by hash, so chains of ascending ids shrink
    too) and that one's in turn, and contracts the edges: O(log n) rounds expected. A round looks at what
    is still connected only; where its nodes went is written, and the rounds are put together at the end.
    """
    first = edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tops: list[DataFrame] = []
    while not (loose := edges.filter("a <> b")).isEmpty():

        def rank(c: str, turn: int = len(tops) + 1) -> Column:
            return F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("id"))

        both = loose.unionByName(loose.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least(rank("a"), F.col("m"))["id"].alias("up"))
        top = durable(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("top")), "up").select(F.col("a").alias("from"), "top"))
        moved = loose.join(top.withColumnsRenamed({"from": "a", "top": "ta"}), "a").join(top.withColumnsRenamed({"from": "b", "top": "tb"}), "b")
        shrunk = durable(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).filter("a <> b").distinct())
        if tops:
            release(edges)
        tops.append(top)
        edges = shrunk
    labels = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for top in tops:
        labels = labels.join(top.withColumnRenamed("from", "label"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    labels = durable(labels)
    release(first, *tops)
    if tops:
        release(edges)
    return labels

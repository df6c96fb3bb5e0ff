"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.common import saved


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of `links` (a, b: long).

    Each round gives every node the least label among its own and its neighbours', and then its label's label, so
    paths halve. A round is a written table; a node with very many links is summed map-side and joined as any other.
    Links with a null end are none, repeated links and links of a node with itself count once, and no links give no rows.
    """
    links = links.filter("a is not null and b is not null")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "links")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        new = labels.join(near, labels.node == near.a).select("node", F.least("label", "l").alias("new"), "label")
        jump = new.select(F.col("node").alias("via"), F.col("new").alias("far"))
        new = saved(new.join(jump, new.new == jump.via).select("node", F.least("new", "far").alias("label"), (F.least("new", "far") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("the components did not settle")

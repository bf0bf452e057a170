"""Connected components of a graph given by its links: labels hook each other's roots and jump along pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copied, dealt, hot_keys, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest node reachable.

    A node's label is a node that it reaches, at most itself. Each round a node takes the least of its label's label and of
    those of its neighbours, and tells the same to the node that its label names, so that whole trees of labels join and
    not single nodes: rounds grow with the logarithm of the number of nodes, whatever the longest path. Minima are combined
    before the shuffle; the links of a hub, and the nodes that share a label, are dealt over several tasks. Loops and
    repeated links do no harm, links with a null end are dropped, no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    # Each round is a written table: a checkpoint would carry on what the optimizer knows of its rows, more with each round.
    both = stored(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    hubs = hot_keys(both.groupBy("b").count(), "b", both.count())
    from_hubs = dealt(both, "b", hubs)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    n_nodes = labels.count()
    while True:
        shared = hot_keys(labels.groupBy("label").count(), "label", n_nodes)
        further = copied(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", shared)
        jumped = stored(dealt(labels, "label", shared).join(further, ["label", "salt"]).select("node", "label", "further"), "jumped")
        told = copied(jumped.select(F.col("node").alias("b"), F.col("further").alias("near")), "b", hubs)
        near = from_hubs.join(told, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        rows = jumped.join(near, "node")
        hooked = rows.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hooked"))
        least = F.least("label", "further", "near", F.coalesce("hooked", "label"))
        better = stored(rows.join(hooked, "node", "left").select("node", least.alias("label"), F.col("label").alias("was")), "labels")
        labels = better.select("node", "label")
        if better.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")

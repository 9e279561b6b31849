"""Connected components of a table of links, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node in ``edges`` (a, b), as a written table.

    Each round takes the least label among a node's neighbours and then the label of that label, so rounds grow with
    the logarithm of the longest chain. Sums are partial before the shuffle and both sides of each join are plain
    shuffles that adaptive execution can split, so one node may have any share of the links.
    """
    both = keep(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = keep(both.groupBy(F.col("src").alias("node")).agg(F.least("src", F.min("dst")).alias("comp")))
    while True:
        near = both.join(labels, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("comp").alias("near"))
        least = keep(labels.join(near, F.col("node") == F.col("dst")).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        up = least.select(F.col("node").alias("up"), F.col("comp").alias("top"))
        new = keep(least.join(up, F.col("comp") == F.col("up")).select("node", "was", F.col("top").alias("comp")))
        drop(labels, least)
        labels = new
        if labels.where("comp <> was").isEmpty():
            drop(both)
            return labels.select("node", "comp")

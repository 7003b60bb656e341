"""Connected components of a table of links, by rounds of joins over written labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `links`: the smallest node it is linked with, itself included.

    A round gives each node the smallest label among itself and its neighbours, then the label of that label, so that a long
    chain is halved rather than walked. The driver sees one count a round. A node with very many links is one row of labels;
    its links are spread by the skew join."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "_near").alias("_low"))
        above = labels.select(F.col("node").alias("_low"), F.col("label").alias("_top"))
        moved = written(lower.join(above, "_low").select("node", F.least("_low", "_top").alias("label"), (F.least("_low", "_top") != F.col("label")).alias("_moved")))
        labels = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return labels.withColumnRenamed("label", "component")

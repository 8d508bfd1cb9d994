"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that links (a, b) reach, for every node of a link.

    Each round every node takes the smallest label around it, then the label of its label, so rounds grow with the
    logarithm of a chain's length. Labels are written to the shared folder after each round.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.stored(both, "links")
    labels = common.stored(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels"
    )
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        least = around.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        taken = labels.join(least, "node").select("node", "label", F.least("label", "near").alias("new"))
        further = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        new = common.stored(
            taken.join(further, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))

"""Connected components of a table of links, by labels that sink to the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stash, stash


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node of the component, for nodes with links.

    Each round a node takes the smallest label among its neighbours, and then that label's
    own label, so that long chains shorten quickly. Rounds go on until nothing changes; each
    is written to the shared folder, and neither labels nor links come to the driver.
    """
    both = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stash(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        sunk = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = sunk.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = stash(sunk.join(roots, "label", "left").select("node", "old", F.coalesce("root", "label").alias("label")), "labels")
        drop_stash(labels)
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            drop_stash(both)
            return labels

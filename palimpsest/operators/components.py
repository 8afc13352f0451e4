"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.materialize import Stash

#: Labels that a task may hold as a hash table, about 50 MB.
BROADCAST_LABELS = 1_000_000


def components(links: DataFrame) -> Stash:
    """(node, comp): for each node of the links (a, b), the smallest node of its component. Each round takes the smallest
    label among the neighbours and then follows labels one step, so that long chains halve; rounds end when no
    label changes. Nothing is gathered on the driver."""
    both = Stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    few = both.df.count() <= BROADCAST_LABELS  # there are no more labels than directed links
    shipped = F.broadcast if few else lambda df: df
    # the first labels need no join: a node's smallest neighbour or itself
    labels = Stash(both.df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        old = labels.df
        near = both.df.join(shipped(old.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.min("comp").alias("near"))
        lower = near.join(shipped(old), old.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("via"))
        step = old.select(F.col("node").alias("via"), F.col("comp").alias("next"))
        new = Stash(lower.join(shipped(step), "via").select("node", F.least("via", "next").alias("comp"), (F.least("via", "next") != F.col("was")).alias("moved")), "labels")
        labels.drop()
        if new.df.where("moved").isEmpty():
            both.drop()
            new.df = new.df.select("node", "comp")
            return new
        labels = new
        labels.df = new.df.select("node", "comp")

"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, removed, stage_path, staged

#: Rounds after which a wrong loop would be stopped; in each, every node that is not the smallest among its neighbours is merged into one, so no graph needs as many.
MOST_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of the nodes in edges (a, b).

    Each round merges a node into its smallest neighbour, or up to three steps on along that way, and renames the edges, of which those within a merged node go; so edges get fewer from round to
    round. Neighbours are reduced before the shuffle, so a node of many edges is a row a task. Merges and edges stay in the shared folder between rounds; labels follow from the merges in the end.
    """
    # Merges and edges are read from files: checkpoints carry how they are dealt and sorted, under every name, which multiplies from round to round
    spark, folder = edges.sparkSession, stage_path(edges.sparkSession, "components")
    rest = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(MOST_ROUNDS):
        if rest.limit(1).count() == 0:
            labels = checkpointed(labels)
            removed(spark, folder)
            return labels
        # Edges point from the smaller to the larger node: a larger one leaves, a smaller one may
        # A plain table: joined with itself by a node that very many hook into, it can be split
        hooks = checkpointed(rest.groupBy(F.col("b").alias("from")).agg(F.min("a").alias("to")))
        for _ in range(2):
            further = hooks.select(F.col("from").alias("via"), F.col("to").alias("end"))
            hooks = hooks.join(further, F.col("to") == F.col("via"), "left").select("from", F.coalesce("end", "to").alias("to"))
        hooks = staged(hooks, "hooks", folder)
        labels = labels.join(hooks, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
        starts, ends = hooks.select(F.col("from").alias("a"), F.col("to").alias("to_a")), hooks.select(F.col("from").alias("b"), F.col("to").alias("to_b"))
        renamed = rest.join(starts, "a", "left").join(ends, "b").select(F.coalesce("to_a", "a").alias("x"), F.col("to_b").alias("y")).filter("x <> y")
        rest = staged(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges", folder)
    raise RuntimeError("edges did not run out")

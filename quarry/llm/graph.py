"""Connected components of an edge table, by smallest labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) of longs -> (v, label): for every vertex of an edge the smallest vertex it reaches.

    Each round takes the smallest label among a vertex and its neighbours and then the label of that label, which
    halves the remaining distances. Labels are aggregated before they are shuffled and joined to a side with
    one row per vertex, so a vertex with very many edges is no more than a skewed join that can be split.
    Every round is written down; the loop ends with the first round that changes nothing.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                       f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("label")),
                         f"{name}-labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near")))
        hooked = labels.join(near, "v").select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jumped = (hooked.join(labels.select(F.col("v").alias("label"), F.col("label").alias("beyond")), "label", "left")
                  .select("v", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")))
        labels = materialize(jumped, f"{name}-labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("v", "label")

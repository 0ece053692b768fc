"""Connected components of a link table, in joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import staged


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``node, label``: the least node of each node's component, for nodes that have a link ``(a, b)`` to another.

    Every round each node takes the least label around it, then the label of its label (pointer jumping), so the
    number of rounds grows with the logarithm of the longest chain. Labels are staged between rounds; what reaches the
    driver is one number a round.
    """
    pairs = links.select("a", "b").where("a != b")
    both = staged(pairs.union(pairs.select("b", "a")).distinct().toDF("a", "b"))
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        up = taken.select(F.col("node").alias("up"), F.col("next").alias("jump"))
        jumped = taken.join(up, F.col("next") == F.col("up"), "left")
        labels_next = staged(jumped.select("node", F.coalesce(F.least("next", "jump"), F.col("next")).alias("to"), (F.coalesce(F.least("next", "jump"), F.col("next")) != F.col("label")).alias("moved")))
        moved = labels_next.where("moved").limit(1).count()
        labels = labels_next.select("node", F.col("to").alias("label"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")

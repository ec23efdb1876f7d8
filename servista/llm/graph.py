"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that can be reached.

    Each round a node takes the least label among its neighbours and then its label's label, until nothing changes;
    the rounds grow with the logarithm of a component's diameter. A round's labels are a table in the shared folder, so
    a lost executor costs a round at most. Minima are combined before the shuffle, so a node with very many
    neighbours is not gathered. Loops and repeated edges do no harm; no edges give no rows.
    """
    both = common.materialise(edges.filter(F.col("a") != F.col("b")).select("a", "b").union(edges.filter(F.col("a") != F.col("b")).select("b", "a")).distinct(), f"{name}-edges")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), name)
    while True:
        near = both.join(common.few(labels.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        # the label's own label: a pointer jump
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = labels.join(near, "node").join(common.few(jump), "label").select("node", F.least("label", "near", "jump").alias("label"), (F.least("near", "jump") < F.col("label")).alias("moved"))
        new = common.materialise(new, name)
        moved = new.filter("moved").limit(1).count()
        common.drop(labels)
        labels = new.drop("moved")
        if not moved:
            common.drop(both)
            return labels

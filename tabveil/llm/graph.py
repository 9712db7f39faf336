"""Connected components of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabveil.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every linked node with the least node it is connected with.

    Each round takes the least label among neighbours, then the label's own label,
    so long chains shrink by halves. Minima are combined map-side, and a node with
    very many links only makes one side of a join hot, which adaptive execution
    splits. Every round is written to the shared folder; its links join unlike
    labels only, so settled parts drop out.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col(a) != F.col(b))
    edges = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        # Links between labels: parts already joined become single nodes.
        near = edges.join(labels, edges["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("least"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "least").alias("label"))
        hooked = materialize(hooked, "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = hooked.join(up, "label").select("node", F.least("label", "upper").alias("label"))
        jumped = materialize(jumped, "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where(F.col("label") != F.col("old")).limit(1).count()
        labels = jumped
        if not changed:
            return labels

"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component`: the smallest node that each node of `links` reaches.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so the number of rounds is about the logarithm of the
    longest path. Labels are staged in the shared folder, never collected; hub
    nodes are split by AQE. Null ends are ignored; an empty table gives an empty one."""
    ok = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = staged(ok.unionByName(ok.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("component").alias("near"))
        lower = staged(
            labels.join(near, labels["node"] == near["x"]).select("node", F.col("component").alias("was"), F.least("component", "near").alias("to")),
            "lower",
        )
        jump = lower.select(F.col("node").alias("root"), F.col("to").alias("further"))
        new = staged(lower.join(jump, lower["to"] == jump["root"]).select("node", "was", F.least("to", "further").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where(F.col("was") != F.col("component")).isEmpty():
            return labels

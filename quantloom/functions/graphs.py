"""Chains and connected components of tables of links, by joins alone; the number of rounds is about the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.sources.shared import written


def chain_ends(links: DataFrame, ratio: str | None = None) -> DataFrame:
    """`node`, `end`, `hops`, `ratio`, `cyclic`: the last node of the chain that starts with each `node` -> `next`, over one successor a node.

    Each round every node takes the successor's end for its own, so steps double
    from round to round. `ratio` multiplies along the chain. What still moves
    after as many rounds as the number of nodes allows runs in a circle: it has
    no end. Null ends are ignored; of several successors the smallest counts."""
    value = F.col(ratio).cast("double") if ratio else F.lit(1.0)
    one = links.where("node is not null and next is not null").groupBy("node").agg(F.min(F.struct(F.col("next"), value.alias("ratio"))).alias("s"))
    now = written(one.select("node", F.col("s.next").alias("end"), F.lit(1).cast("long").alias("hops"), F.col("s.ratio").alias("ratio")), "chain")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("hops").alias("_hops"), F.col("ratio").alias("_ratio"))
        now = written(now.join(ahead, "end", "left").select(
            "node", F.coalesce("_end", "end").alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), (F.col("ratio") * F.coalesce("_ratio", F.lit(1.0))).alias("ratio"), F.col("_end").isNotNull().alias("moved"),
        ), "chain")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved") if _ < rounds - 1 else now
    out = now if "moved" in now.columns else now.withColumn("moved", F.lit(False))
    gone = lambda c: F.when(~F.col("moved"), F.col(c)).alias(c)
    return out.select("node", gone("end"), gone("hops"), gone("ratio"), F.col("moved").alias("cyclic"))


def components(edges: DataFrame) -> DataFrame:
    """`node`, `component`: the smallest node that each end of `a` - `b` reaches. Null ends and loops are ignored."""
    ok = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    both = written(ok.unionByName(ok.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = written(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to")), "labels")
        further = low.select(F.col("node").alias("to"), F.col("to").alias("_to"))  # the label's own label
        new = written(low.join(further, "to").select("node", "was", F.least("to", "_to").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels

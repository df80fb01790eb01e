"""Merkle manifest of a table: a tree of SHA-256 digests per group, a tree of the groups' roots, and a proof per row.

Rows get their position in the group from a range sort and the sizes of its
partitions. A level is one window over bounded segments of a group: lag and lead
columns at fixed offsets, masked by the slot in the run and the length of the
run, are a node's siblings; the first child of each run hashes the parent.
Going down again, each node takes the path of its parent, so that the joins
shrink by the fan-out from level to level and only one has a row per leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, staged

#: rows of a level's window at most, in runs
RUNS = 64
_PATH = "array<struct<left:string,right:string>>"


def encoded(c: str | Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(columns: list[str | Column]) -> Column:
    return F.sha2(F.concat(*(encoded(c) for c in columns)), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `pos`, the place from 0 in the group by `order`, and `total`, the group's rows. A group is cut over many tasks; nothing is collected."""
    index = F.monotonically_increasing_id()
    cut = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", index).withColumn("_part", F.shiftright("_at", 33))
    cut = staged(cut, "ordered")
    parts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_part")  # one row per task and group
    starts = parts.select(
        group, "_part", "_from", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(group)).alias("total"),
    )
    joined = cut.join(staged(starts, "starts"), [group, "_part"])
    return joined.withColumn("pos", F.col("_at") - F.col("_from") + F.col("_start")).drop("_at", "_part", "_from", "_start")


def with_siblings(nodes: DataFrame, group: str, fan: int) -> DataFrame:
    """Adds `left` and `right`, the digests of the siblings on each side, run together; empty where the group has one node."""
    slot = F.col("pos") % fan
    size = F.least(F.lit(fan), F.col("total") - F.col("pos") + slot)
    w = Window.partitionBy(group, F.floor(F.col("pos") / (fan * RUNS))).orderBy("pos")
    left = [F.when(slot >= k, F.lag("node", k).over(w)).otherwise("") for k in range(fan - 1, 0, -1)]
    right = [F.when(slot + k < size, F.lead("node", k).over(w)).otherwise("") for k in range(1, fan)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(level: DataFrame, group: str, fan: int) -> DataFrame:
    """The next level, from the first child of each run; a group of one node keeps it."""
    node = F.when(F.col("total") == 1, F.col("node")).otherwise(F.sha2(F.concat("node", "right"), 256))
    first = level.where(F.col("pos") % fan == 0)
    return first.select(group, F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("total") / fan).alias("total"), node.alias("node"))


def _levels(nodes: DataFrame, group: str, fan: int) -> list[DataFrame]:
    """All levels with siblings, the last with one node per group. One number, the longest group, comes to the driver."""
    longest = nodes.agg(F.max("total")).first()[0] or 0
    out = [staged(with_siblings(nodes, group, fan), "level")]
    while longest > 1:
        out.append(staged(with_siblings(parents(out[-1], group, fan), group, fan), "level"))
        longest = -(-longest // fan)
    return out


def _own() -> Column:
    """The node's own step of the path: none where the group has one node."""
    return F.when(F.col("total") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast(_PATH))


def _paths(levels: list[DataFrame], group: str, tops: DataFrame, fan: int) -> DataFrame:
    """The lowest level with `path`, its siblings up to the root, and the other columns of `tops` (group, path, ...)."""
    more = [c for c in tops.columns if c not in (group, "path")]
    above = tops.withColumnRenamed("path", "_path").withColumn("_run", F.lit(0).cast("long"))
    for level in reversed(levels):
        top = level is levels[-1]
        run = F.col("pos") if top else F.floor(F.col("pos") / fan)
        here = level.withColumn("_run", run).join(above, [group, "_run"]).withColumn("path", F.concat(_own(), F.col("_path")))
        above = here.select(group, F.col("pos").alias("_run"), F.col("path").alias("_path"), *more)
        if level is not levels[0]:
            above = staged(above, "paths")
    return here.drop("_run", "_path", "left", "right")


def folded(node: Column, path: Column) -> Column:
    """The root that `node` and the siblings of `path` give."""
    return F.aggregate(path, node, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def tampered_text(id_col: str, text_col: str) -> Column:
    """A third of the texts, by crc32 of the id, with A-Z lower-cased; others as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text_col, upper, upper.lower())).otherwise(F.col(text_col))


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", text: str = "text", fan: int = 8) -> DataFrame:
    """One row per input row: `order` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    Nulls have a form of their own in every column, so a null text is not an
    empty one; a null group is a group, the first one; null ids come first and
    are never tampered with. Repeated ids stand by their leaves; equal rows have
    equal leaves, so their order does not matter. A lone leaf is its subroot, a
    lone subroot the root, and a row without siblings has the digest of nothing
    as proof. Texts of any length are hashed whole. An empty table gives an
    empty one. Other columns are not read. `verified` says whether the leaf of
    the text as tampered with (or as it is) still leads to the root."""
    cols = {c: F.col(c) for c in columns}
    leaf, bad = digest([*cols.values()]), digest([*(cols | {text: tampered_text(order, text)}).values()])
    key = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    with scratch(docs.sparkSession):
        leaves = staged(docs.select(key.alias("g"), F.col(order).alias("id"), leaf.alias("node"), bad.alias("shown")), "leaves")
        levels = _levels(numbered(leaves, "g", ["id", "node"]), "g", fan)
        subroots = staged(levels[-1].select("g", F.col("node").alias("subroot")), "subroots")
        every = numbered(subroots.select(F.lit("all").alias("table"), "g", F.col("subroot").alias("node")), "table", ["g"])
        upper = _levels(every, "table", fan)
        root = upper[-1].select("table", F.array().cast(_PATH).alias("path"), F.col("node").alias("root"))
        tops = staged(_paths(upper, "table", root, fan).select("g", F.col("node").alias("subroot"), "root", "path"), "tops")
        rows = _paths(levels, "g", tops, fan)
        out = rows.select(
            F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("shown"), F.col("path")).alias("folded_root")
        )
        return staged(out.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest", keep=True)

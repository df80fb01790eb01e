"""How filters of documents overlap: what each removes in every order in which they can be applied.

Each filter has its own stored table of failing rows. What a filter removes
after a set of others depends on that set alone, so a failing row is repeated
for each set of other filters; a left-anti join with the failing rows of the
set leaves what the filter removes, a left-semi join what others removed
before it. Orders then read these counts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import scratch, staged

_SPACE = r"[ \t-\r]+"
FILTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions of A to D; E needs the other texts."""
    words = F.col("words")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _rows(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per document: key, id, part, flags of A to D and the SHA-256 of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    src = src.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    flags = [c.alias(k) for k, c in failures(F.col("text")).items()]
    return src.select(F.monotonically_increasing_id().alias("row"), "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), *flags)


def failing_tables(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Documents per part, and per filter the stored table of its failing rows (row, part, good, toxic)."""
    rows = staged(_rows(docs, id_col, text_col, part_col), "flags")
    copies = rows.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(F.col("sha").alias("copy"), "first")
    later = staged(rows.join(copies, (F.col("sha") == F.col("copy")) & (F.col("id") > F.col("first")), "left_semi").select("row", "id", "part"), "copies")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = staged(marks, "marks")
    failing = {k: rows.where(k).select("row", "id", "part") for k in FILTERS[:4]} | {"E": later}
    stored = {k: staged(f.join(marks, "id", "left").select("row", "part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))), f"failing-{k}") for k, f in failing.items()}
    return staged(rows.groupBy("part").agg(F.count("*").alias("documents")), "parts"), stored


def prefix_counts(failing: dict[str, DataFrame]) -> DataFrame:
    """Per part, filter and set of filters applied before (a bit each, from the first): removed, redundant, good_lost, toxic_lost. Zeros are left out.

    All joins are by row, so the failing rows are shuffled once, before they are repeated."""
    names = sorted(failing)
    bit = {k: 1 << i for i, k in enumerate(names)}
    union = None
    for k, f in failing.items():
        one = f.select("row", "part", F.lit(k).alias("filter"), F.lit(bit[k]).alias("bit"), "good", "toxic")
        union = one if union is None else union.unionByName(one)
    union = union.repartition("row")
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    steps = union.select("row", "part", "filter", "good", "toxic", F.explode(sets).alias("before"))
    gone = union.select(F.col("row").alias("gone"), F.col("bit").alias("by"))
    hit = (F.col("row") == F.col("gone")) & (F.col("before").bitwiseAND(F.col("by")) != 0)
    key = ["part", "filter", "before"]
    n = lambda c: F.sum(F.col(c).cast("long"))
    removed = steps.join(gone, hit, "left_anti").groupBy(*key).agg(F.count("*").alias("removed"), n("good").alias("good_lost"), n("toxic").alias("toxic_lost"), F.lit(0).cast("long").alias("redundant"))
    passed = steps.join(gone, hit, "left_semi").groupBy(*key).agg(*(F.lit(0).cast("long").alias(c) for c in ("removed", "good_lost", "toxic_lost")), F.count("*").alias("redundant"))
    return removed.unionByName(passed).groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty; a null part is the empty string. Rows are told apart
    by a key of their own, so repeated ids, equal rows and null ids all count;
    a null id is no copy of a smaller id and makes none. Texts are equal if
    their SHA-256 are. Repeated labels of an id count once, a label of 1
    prevails. Texts are read whole, whatever their length. An empty table
    gives an empty result; other columns are not read. `shapley` is what a
    filter removes in all orders together. Rows grow with the parts, not with
    the documents."""
    with scratch(docs.sparkSession):
        parts, failing = failing_tables(docs, labels, id_col, text_col, part_col)
        counts = staged(prefix_counts(failing), "counts")
        bits = {k: 1 << i for i, k in enumerate(sorted(failing))}
        whole = sum(bits.values())
        orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
        grid = parts.select("part", "documents", F.explode(orders).alias("filter_order"))
        steps = F.array(*(F.struct(F.lit(i).alias("step"), F.substring("filter_order", i, 1).alias("filter"), F.substring("filter_order", 1, i - 1).alias("earlier")) for i in range(1, len(FILTERS) + 1)))
        grid = grid.select("part", "documents", "filter_order", F.explode(steps).alias("s")).select("part", "documents", "filter_order", "s.*")
        before = sum((F.when(F.col("earlier").contains(k), b).otherwise(0) for k, b in bits.items()), F.lit(0))
        only = counts.select("part", "filter", F.when(F.col("before") + F.element_at(F.create_map(*(F.lit(x) for kb in bits.items() for x in kb)), F.col("filter")) == whole, F.col("removed")).alias("unique_fails"))
        only = only.groupBy("part", "filter").agg(F.max("unique_fails").alias("unique_fails"))
        rows = grid.withColumn("before", before).join(counts, ["part", "filter", "before"], "left").join(only, ["part", "filter"], "left")
        numbers = ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
        rows = rows.select("part", "filter_order", "step", "filter", "documents", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers))
        so_far = Window.partitionBy("part", "filter_order").orderBy("step")
        kept = F.col("documents") - F.sum("removed").over(so_far)
        shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # 120 rows
        return staged(rows.select("part", "filter_order", "step", kept.alias("kept"), *numbers, shapley.alias("shapley")), "audit", keep=True)

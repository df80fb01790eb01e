"""Order statistics of a whole table, without its values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.shared import written


def quantiles(df: DataFrame, x: str, marks: list[float]) -> DataFrame:
    """One row, `quantiles`: the exact quantiles of the values of `x` that are there, between two neighbours in proportion; nulls for an empty table.

    Equal values become one row with their number, so that no range of values
    outgrows the others by ties. Ranges are sorted in tasks of their own; the
    sizes of the ranges (one row each) say in which of them a place lies."""
    spark = df.sparkSession
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = written(written(counts, "values").repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = v.groupBy("part").agg(F.sum("n").alias("size"))
    w = Window.orderBy("part")  # one row a range
    sizes = sizes.select("part", (F.sum("size").over(w) - F.col("size")).alias("before"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(m)).alias("m")) for i, m in enumerate(marks)))
    asked = sizes.select("all").limit(1).select("all", F.inline(places)).select("all", "i", (F.col("m") * (F.col("all") - 1)).alias("at"))
    order = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    up = v.withColumn("upto", F.sum("n").over(order)).join(F.broadcast(sizes), "part").select("v", (F.col("before") + F.col("upto")).alias("upto"), "n")
    hit = lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))
    low, high = F.floor("at"), F.ceil("at")
    found = up.join(F.broadcast(asked), hit(low) | hit(high))  # a few rows
    by = found.groupBy("i").agg(F.max("at").alias("at"), F.max(F.when(hit(low), F.col("v"))).alias("lo"), F.max(F.when(hit(high), F.col("v"))).alias("hi"))
    part = F.col("at") - F.floor("at")
    value = F.when(part == 0, F.col("lo")).otherwise(F.col("lo") + part * (F.col("hi") - F.col("lo")))
    one = by.select("i", value.alias("q")).agg(F.map_from_entries(F.collect_list(F.struct("i", "q"))).alias("_q"))
    return one.select(F.array(*(F.try_element_at("_q", F.lit(i)) for i in range(len(marks)))).alias("quantiles"))

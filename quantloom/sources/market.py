"""Market-shaped tables derived from the star-schema tables, lazily, by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def roll_up(ticks: DataFrame, keys: list[str], price: str, order: str, volume: str, turnover: str) -> DataFrame:
    """OHLC bars per key: first and last price by `order`, extremes, summed volume and turnover."""
    return ticks.groupBy(*keys).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"), F.sum(turnover).alias("turnover"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day bars: instrument = supplier, price = extended price per unit, in order of order key and line."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
    )
    return roll_up(line, ["id", "date"], "px", "seq", "qty", "amount")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-weighted mean price of all instruments by day."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("bench"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per instrument: industry (nation) and sector (region)."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading dates with their ordinal from 1. One row a day: a bounded table."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return days.withColumn("seq", F.row_number().over(Window.orderBy("date")))


def ex_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cumulative adjustment factors per instrument, from days on which an order key divisible by 97 was shipped."""
    line = table(spark, sf_dir, "lineitem").where(F.col("l_orderkey") % 97 == 0)
    days = line.select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("ex_date")).distinct()
    order = Window.partitionBy("id").orderBy("ex_date")
    return days.withColumn("factor", F.pow(F.lit(1.1), F.row_number().over(order)))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades per account: filled orders buy, open orders sell, others are ignored."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    side = F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL")
    return orders.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("date"), side.alias("side"), F.col("o_totalprice").alias("amount"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", F.col("value").alias("price"), "event_type", "event_id")

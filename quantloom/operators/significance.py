"""Signal tests: bucket layers, group backtests and the significance of rank information."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quantloom.functions import rolling as R

GROUPS = 5


def _ranked(df: DataFrame, signal: str, label: str, key: str = "id") -> DataFrame:
    """Rows with both values: place from the top and from the bottom of their date, and rows of the date; ties by key."""
    x = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select("date", key, signal, label)
    d = Window.partitionBy("date")
    top = F.row_number().over(d.orderBy(F.desc(signal), key))
    x = x.withColumn("_top", top).withColumn("_n", F.count("*").over(d)).where("_n >= 2")
    return x.withColumn("_bottom", F.col("_n") - F.col("_top") + 1)


def bucket_size(n: F.Column) -> F.Column:
    """A fifth of the rows, 10 at most, 1 below ten rows."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.when(n >= 10, F.floor(n / 5)).otherwise(1)))


def layers(df: DataFrame, signal: str, label: str) -> DataFrame:
    """Per date: rows, mean label of the top less the bottom bucket, share of positive labels in the top, in buckets of `bucket_size`."""
    x = _ranked(df, signal, label).withColumn("_k", bucket_size(F.col("_n")))
    top, bottom = (F.when(F.col(c) <= F.col("_k"), F.col(label)) for c in ("_top", "_bottom"))
    return x.groupBy("date").agg(F.max("_n").alias("n"), (F.avg(top) - F.avg(bottom)).alias("spread"), F.avg(F.when(F.col("_top") <= F.col("_k"), (F.col(label) > 0).cast("int"))).alias("hit_rate"))


def group_backtest(df: DataFrame, signal: str, label: str) -> DataFrame:
    """One row: mean return of each of five signal groups (0 the strongest), long-short mean and ratio over dates, and rank correlation of group order with the means (0 with fewer than three means that are not 0)."""
    x = _ranked(df, signal, label)
    place = F.col("_top") - 1
    group = F.array_max(F.filter(F.array(*(F.when(place >= F.floor(F.col("_n") * g / GROUPS), F.lit(g)) for g in range(GROUPS))), lambda v: v.isNotNull()))
    daily = x.withColumn("_g", group).groupBy("date").agg(*(F.avg(F.when(F.col("_g") == g, F.col(label))).alias(f"_r{g}") for g in range(GROUPS)))
    spread = F.col("_r0") - F.col(f"_r{GROUPS - 1}")
    sd = F.stddev_pop(spread)
    out = daily.agg(*(F.coalesce(F.avg(f"_r{g}"), F.lit(0.0)).alias(f"group{g}") for g in range(GROUPS)), F.avg(spread).alias("long_short"), F.coalesce(R.ratio(F.avg(spread), sd), F.lit(0.0)).alias("long_short_ir"), F.count(spread).alias("dates"))
    means = F.array(*(F.col(f"group{g}") for g in range(GROUPS)))
    rank = lambda v: F.size(F.filter(means, lambda u: u < v)) + (F.size(F.filter(means, lambda u: u == v)) + 1) / 2
    # Spearman of the orders GROUPS .. 1 with the ranks of the means
    mid = (GROUPS + 1) / 2
    cross = sum(((GROUPS - g) - mid) * (rank(F.col(f"group{g}")) - mid) for g in range(GROUPS))
    own = sum((rank(F.col(f"group{g}")) - mid) * (rank(F.col(f"group{g}")) - mid) for g in range(GROUPS))
    rho = R.ratio(cross, F.sqrt(own * sum((g + 1 - mid) ** 2 for g in range(GROUPS))))
    enough = F.size(F.filter(means, lambda v: v != 0)) >= 3
    return out.withColumn("monotonicity", F.when(enough, F.coalesce(rho, F.lit(0.0))).otherwise(0.0))


def newey_west(daily: DataFrame, x: str = "ic", order: str = "date") -> DataFrame:
    """One row: number, lags, mean, standard error and t of the mean of a daily series, with Bartlett weights; the series has one row a day, so its products by lag are window functions over days."""
    rows = daily.where(F.col(x).isNotNull() & ~F.isnan(x)).withColumn("_one", F.lit(1))
    mean = F.avg(x).over(Window.partitionBy("_one"))
    rows = rows.withColumn("_c", F.col(x) - mean).withColumn("_n", F.count("*").over(Window.partitionBy("_one")))
    lags = F.when(F.col("_n") <= 2, 0).otherwise(F.greatest(F.lit(1), F.round(4 * F.pow(F.col("_n") / 100, F.lit(2 / 9))).cast("int")))
    rows = rows.withColumn("_lags", F.least(lags, F.col("_n") - 1).cast("int")).withColumn("_i", F.row_number().over(Window.partitionBy("_one").orderBy(order)))
    pairs = rows.select("_c", "_n", "_lags", "_i", F.explode(F.sequence(F.lit(0), F.col("_lags"))).alias("_k"))
    before = rows.select(F.col("_i").alias("_j"), F.col("_c").alias("_b"))
    both = pairs.join(before, F.col("_i") - F.col("_k") == F.col("_j"))
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(2 * (1 - F.col("_k") / (F.col("_lags") + 1)))
    variance = both.agg(F.sum(weight * F.col("_c") * F.col("_b")).alias("_v"))
    one = rows.agg(F.count("*").alias("n"), F.max("_lags").alias("lags"), F.avg(x).alias("mean"))
    out = one.crossJoin(F.broadcast(variance))  # one row each
    se = F.sqrt(F.greatest(F.col("_v") / F.col("n"), F.lit(0.0)) / F.col("n"))
    t = F.when(se > 1e-12, F.col("mean") / se).when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * float("inf"))
    return out.select("n", "lags", "mean", se.alias("std_error"), t.alias("t_stat"))


@F.pandas_udf(DoubleType())
def normal_p(t: pd.Series) -> pd.Series:
    """Two-sided p-value of a normal statistic."""
    return t.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def head_metrics(df: DataFrame, signal: str, label: str, profile: list[str], mode: str = "positive", k: int = 5) -> DataFrame:
    """Per date: share of the top k whose label is positive, or above the date's median (`mode` = "median"), and means of `profile` columns over the top k."""
    x = _ranked(df, signal, label).join(df.select("date", "id", *(c for c in profile if c not in (signal, label))), ["date", "id"])
    x = x.withColumn("_mid", F.median(label).over(Window.partitionBy("date")) if mode == "median" else F.lit(0.0))
    best = x.where(F.col("_top") <= k)
    return best.groupBy("date").agg(F.count("*").alias("n"), F.avg((F.col(label) > F.col("_mid")).cast("int")).alias("hit_rate"), *(F.avg(c).alias(f"top_{c}") for c in profile))

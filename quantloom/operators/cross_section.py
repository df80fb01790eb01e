"""Cross-sections: operators within one date (and group) of a panel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def winsorised(df: DataFrame, x: str, by: list[str], k: float = 5.0) -> DataFrame:
    """Clip x to median +- k x 1.4826 x MAD of its date, then `z`, its z-score (sample deviation)."""
    mid = df.groupBy(*by).agg(F.median(x).alias("_mid"))
    df = df.join(mid, by)
    mad = df.groupBy(*by).agg(F.median(F.abs(F.col(x) - F.col("_mid"))).alias("_mad"))
    df = df.join(mad, by)
    half = k * 1.4826 * F.col("_mad")
    cut = F.when(F.col(x).isNotNull(), F.greatest(F.col("_mid") - half, F.least(F.col("_mid") + half, F.col(x))))
    w = Window.partitionBy(*by)
    df = df.withColumn("winsorised", cut)
    return df.withColumn("z", R.ratio(F.col("winsorised") - F.avg("winsorised").over(w), F.stddev_samp("winsorised").over(w))).drop("_mid", "_mad")


def neutralised(df: DataFrame, x: str, group: str, control: str, least: int = 5, by: str = "date") -> DataFrame:
    """Residual of x ~ 1 + group dummies + ln(control) within each date, in closed form: demean both by group, then one slope a date."""
    g, d = Window.partitionBy(by, group), Window.partitionBy(by)
    df = df.where(F.col(x).isNotNull() & (F.col(control) > 0)).withColumn("_c", F.ln(control))
    df = df.withColumn("_y", F.col(x) - F.avg(x).over(g)).withColumn("_c", F.col("_c") - F.avg("_c").over(g))
    slope = F.coalesce(R.ratio(F.sum(F.col("_y") * F.col("_c")).over(d), F.sum(F.col("_c") * F.col("_c")).over(d)), F.lit(0.0))
    df = df.withColumn("_slope", slope).withColumn("_n", F.count("*").over(d))
    return df.withColumn("neutral", F.when(F.col("_n") >= least, F.col("_y") - F.col("_slope") * F.col("_c"))).drop("_c", "_y", "_slope", "_n")


def ranked(df: DataFrame, x: str, by: list[str], groups: int = 5) -> DataFrame:
    """Average percent rank and quantile group (1 to `groups`) of x within `by`."""
    return df.withColumn("pct", R.percent_rank(x, by)).withColumn("bucket", F.least(F.ceil(F.col("pct") * groups), F.lit(groups)).cast("int"))


def top_bottom(df: DataFrame, x: str, k: int, by: str = "date", key: str = "id") -> DataFrame:
    """The k highest and k lowest rows of each date, with their places; ties by key."""
    up, down = Window.partitionBy(by).orderBy(F.desc(x), key), Window.partitionBy(by).orderBy(F.asc(x), key)
    df = df.where(F.col(x).isNotNull()).withColumn("from_top", F.row_number().over(up)).withColumn("from_bottom", F.row_number().over(down))
    return df.where((F.col("from_top") <= k) | (F.col("from_bottom") <= k))


def best_by_score(df: DataFrame, scores: list[str], k: int, keep: list[str], by: str = "date", key: str = "id", name: str = "score") -> DataFrame:
    """The k highest rows of each date for each score, with equal weights; ties by key. Columns `name` (the score's name), `by`, `key`, `keep` and `weight`.

    Rows are not repeated for each score: one shuffle by date, and a task holds one date's names."""
    columns = [by, key, *keep]

    def one(t: pa.Table) -> pa.Table:
        t, out = t.take(pc.sort_indices(t, sort_keys=[(key, "ascending")], null_placement="at_start")), []
        for score in scores:
            there = np.flatnonzero(t.column(score).is_valid().to_numpy())
            at = there[R.largest_first(t.column(score).to_numpy()[there])[:k]]
            rows = t.take(pa.array(at, pa.int64())).select(columns)
            out.append(rows.add_column(0, name, pa.array([score] * len(at), pa.string())).append_column("weight", pa.array([1.0 / max(len(at), 1)] * len(at), pa.float64())))
        return pa.concat_tables(out)

    x = df.select(*columns, *(F.col(c).cast("double").alias(c) for c in scores))
    kept = ", ".join(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in columns)
    return x.groupBy(by).applyInArrow(one, f"`{name}` string, {kept}, weight double")


def capped_weights(df: DataFrame, score: str, cap: float, by: str = "date", key: str = "id") -> DataFrame:
    """Weights proportional to positive scores, none above `cap`, excess to the rest by score.

    The capped names are a prefix in score order: name i is capped if, with the
    i - 1 above it at the cap, its share of the remaining weight reaches the
    cap. Prefix sums give that without iteration. Too few names for the cap get
    the cap each."""
    df = df.where(F.col(score) > 0)
    order, every = Window.partitionBy(by).orderBy(F.desc(score), key), Window.partitionBy(by)
    df = df.withColumn("_i", F.row_number().over(order)).withColumn("_rest", F.sum(score).over(every) - F.sum(score).over(order) + F.col(score))
    df = df.withColumn("_capped", F.col(score) * (1 - (F.col("_i") - 1) * cap) >= cap * F.col("_rest"))
    # the prefix ends before the first name that is not capped
    df = df.withColumn("_k", F.coalesce(F.min(F.when(~F.col("_capped"), F.col("_i"))).over(every), F.count("*").over(every) + 1) - 1)
    df = df.withColumn("_free", F.sum(F.when(F.col("_i") > F.col("_k"), F.col(score))).over(every))
    weight = F.when(F.col("_i") <= F.col("_k"), F.lit(cap)).otherwise((1 - F.col("_k") * cap) * R.ratio(F.col(score), F.col("_free")))
    return df.withColumn("weight", weight).drop("_i", "_rest", "_capped", "_k", "_free")


def transforms(df: DataFrame, x: str, by: str = "date") -> DataFrame:
    """Add of x within each date: `rank` (percent), `quantile` (midpoint of its fifth), `signed_log`, and `robust`: distance from the median in interquartile ranges, or in 1.4826 x MAD where that range is 0."""
    d = Window.partitionBy(by)
    edges = df.groupBy(by).agg(F.median(x).alias("_mid"), (F.percentile(x, 0.75) - F.percentile(x, 0.25)).alias("_iqr"))
    df = df.join(edges, by).withColumn("_far", F.abs(F.col(x) - F.col("_mid"))).withColumn("_mad", F.median("_far").over(d) * 1.4826)
    away = F.col(x) - F.col("_mid")
    df = ranked(df, x, [by]).withColumn("rank", F.col("pct")).withColumn("quantile", (F.col("bucket") - 0.5) / 5)
    df = df.withColumn("signed_log", F.signum(x) * F.log1p(F.abs(x))).withColumn("robust", F.when(F.col("_iqr") > 0, away / F.col("_iqr")).when(F.col("_mad") > 0, away / F.col("_mad")))
    return df.drop("_mid", "_iqr", "_far", "_mad", "pct", "bucket")

"""Signal and portfolio evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def rank_ic(df: DataFrame, signal: str, label: str, least: int = 5) -> DataFrame:
    """Per date: rank correlation of signal and label over rows that have both, and how many there are."""
    both = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    both = both.withColumn("_a", R.average_rank(signal, ["date"])).withColumn("_b", R.average_rank(label, ["date"]))
    out = both.groupBy("date").agg(R.correlation("_a", "_b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)
    return out.select("date", "ic", "n")


def spread(df: DataFrame, signal: str, label: str, k: int) -> DataFrame:
    """Per date: mean label of the k best less that of the k worst signals, and share of the best with a positive label."""
    both = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull())
    up, down = Window.partitionBy("date").orderBy(F.desc(signal), "id"), Window.partitionBy("date").orderBy(F.asc(signal), "id")
    both = both.withColumn("_t", F.row_number().over(up)).withColumn("_b", F.row_number().over(down))
    best, worst = F.col("_t") <= k, F.col("_b") <= k
    return both.groupBy("date").agg((F.avg(F.when(best, F.col(label))) - F.avg(F.when(worst, F.col(label)))).alias("spread"), F.avg(F.when(best, (F.col(label) > 0).cast("int"))).alias("hit_rate"))


def signal_summary(df: DataFrame, signal: str, label: str, k: int = 5, least: int = 5) -> DataFrame:
    """One row: dates, mean rank IC, IC over its population deviation, mean spread, mean hit rate. One shuffle by date; a task holds one date's names and gives a row a date."""

    def one(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("id", "ascending")], null_placement="at_start"))
        x, y = (t.column(c).to_numpy() for c in ("x", "y"))
        up = np.argsort(x, kind="stable")[:k]
        down = R.largest_first(x)[:k]
        hits = (y[down] > 0) | np.isnan(y[down])  # NaN is the largest, as in Spark
        row = {"date": t.column("date")[:1], "n": [t.num_rows], "ic": pa.array([R.correlation_of(R.average_ranks(x), R.average_ranks(y))], pa.float64()), "spread": [float(y[down].mean() - y[up].mean())], "hit_rate": [float(hits.mean())]}
        return pa.table(row)

    x = df.where(F.col(signal).isNotNull() & F.col(label).isNotNull()).select("date", "id", F.col(signal).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    daily = x.groupBy("date").applyInArrow(one, f"date {x.schema['date'].dataType.simpleString()}, n long, ic double, spread double, hit_rate double").where(F.col("n") >= least)
    return daily.agg(F.count("ic").alias("dates"), F.avg("ic").alias("ic_mean"), R.ratio(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.avg("spread").alias("spread_mean"), F.avg("hit_rate").alias("hit_rate"))


def bucket_returns(df: DataFrame, bucket: str, label: str, buckets: int) -> DataFrame:
    """Per bucket from 1 to `buckets`, empty ones too: rows, mean, median, win rate and five quantiles of the label."""
    x = df.where(F.col(bucket).isNotNull() & F.col(label).isNotNull())
    marks = (10, 25, 50, 75, 90)
    q = F.percentile(label, F.array(*(F.lit(p / 100) for p in marks)))
    g = x.groupBy(bucket).agg(F.count("*").alias("n"), F.avg(label).alias("mean"), F.median(label).alias("median"), F.avg((F.col(label) > 0).cast("int")).alias("win_rate"), q.alias("q"))
    every = df.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias(bucket))
    return every.join(g, bucket, "left").select(bucket, F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "win_rate", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate(marks)))


def turnover(weights: DataFrame) -> DataFrame:
    """Per date: half the absolute weight change and the Jaccard overlap of names against the date before. The dates are numbered per date, so the window is over days only."""
    days = weights.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")))
    numbered = weights.join(days, "date").select("_n", "id", "weight")
    before = numbered.select((F.col("_n") + 1).alias("_n"), "id", F.col("weight").alias("was"))
    both = numbered.join(before, ["_n", "id"], "full").join(days, "_n")
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("was", F.lit(0.0))
    common = F.count_if((a > 0) & (b > 0)) / F.count_if((a > 0) | (b > 0))
    return both.groupBy("date").agg((F.sum(F.abs(a - b)) / 2).alias("turnover"), common.alias("overlap"))


def equity(daily: DataFrame, ret: str, key: list[str], order: str = "date") -> DataFrame:
    """Compounded equity, running peak and drawdown of a return series per key."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(ret, F.lit(0.0)))).over(w)))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def performance(daily: DataFrame, ret: str, bench: str, key: list[str], year: int = 252) -> DataFrame:
    """Textbook figures per key: annual return and volatility (sample), Sharpe, Sortino, alpha, beta, tracking error, information ratio, value at risk 5 %, win rate."""
    d = daily.where(F.col(ret).isNotNull() & F.col(bench).isNotNull()).withColumn("_x", F.col(ret) - F.col(bench))
    n = F.count("*")
    g = d.groupBy(*key).agg(
        n.alias("days"), F.avg(ret).alias("_m"), F.stddev_samp(ret).alias("_s"), F.sqrt(F.avg(F.pow(F.least(F.col(ret), F.lit(0.0)), 2))).alias("_d"), F.covar_samp(ret, bench).alias("_c"), F.var_samp(bench).alias("_v"),
        F.avg(bench).alias("_b"), F.stddev_samp("_x").alias("_te"), F.avg("_x").alias("_ex"), F.sum(F.log1p(ret)).alias("_log"), F.percentile(ret, 0.05).alias("var5"), F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"),
    )
    root = float(year) ** 0.5
    b = R.ratio(F.col("_c"), F.col("_v"))
    return g.select(
        *key, "days", (F.exp(F.col("_log") * year / F.col("days")) - 1).alias("annual_return"), (F.col("_s") * root).alias("annual_vol"), (R.ratio(F.col("_m"), F.col("_s")) * root).alias("sharpe"),
        (R.ratio(F.col("_m"), F.col("_d")) * root).alias("sortino"), b.alias("beta"), ((F.col("_m") - b * F.col("_b")) * year).alias("alpha"), (F.col("_te") * root).alias("tracking_error"), (R.ratio(F.col("_ex"), F.col("_te")) * root).alias("info_ratio"), "var5", "win_rate",
    )


def pair_correlations(df: DataFrame, key: str, x: str, least: int = 20) -> DataFrame:
    """Covariance and correlation of every pair of a short list of series (sectors, factors), over the dates both have. The pairs grow with the list's square, so the list must be short."""
    a, b = df.select("date", F.col(key).alias("a"), F.col(x).alias("x")), df.select("date", F.col(key).alias("b"), F.col(x).alias("y"))
    both = a.join(b, "date").where((F.col("a") <= F.col("b")) & F.col("x").isNotNull() & F.col("y").isNotNull())
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov"), R.correlation("x", "y").alias("corr")).where(F.col("n") >= least)


def adjusted_p(df: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values of a short list of tests."""
    up, n = Window.orderBy(p, "test"), F.count("*").over(Window.partitionBy())
    df = df.withColumn("_raw", F.col(p) * n / F.row_number().over(up))
    back = Window.orderBy(F.desc(p), F.desc("test")).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("adjusted", F.least(F.lit(1.0), F.min("_raw").over(back))).drop("_raw")

"""Covariance models in long form: one row per pair of a short list of series. Pairs grow with the square of the list, so it must be short (industries, factors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def _recent(df: DataFrame, key: str, x: str, days: int | None) -> DataFrame:
    rows = df.select("date", F.col(key).alias("k"), F.col(x).alias("x")).where("x is not null")
    dates = rows.select("date").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)  # one row a day
    return rows.join(dates if days is None else dates.where(F.col("age") < days), "date")


def _pairs(rows: DataFrame) -> DataFrame:
    a, b = rows.select("date", "age", F.col("k").alias("a"), "x"), rows.select("date", F.col("k").alias("b"), F.col("x").alias("y"))
    return a.join(b, "date").where("a <= b")


def shrunk_covariance(df: DataFrame, key: str, x: str, days: int = 252, least: int = 20, shrink: float = 0.1) -> DataFrame:
    """Sample covariance over the last `days` dates of pairs with `least` common dates; what is off the diagonal is shrunk by `shrink`."""
    g = _pairs(_recent(df, key, x, days)).groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("x", "y").alias("cov")).where(F.col("n") >= least)
    return g.withColumn("cov", F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise((1 - shrink) * F.col("cov")))


def ewm_covariance(df: DataFrame, key: str, x: str, halflife: float = 60, least: int = 20) -> DataFrame:
    """Covariance with weights that halve every `halflife` dates, corrected for bias, over the dates that both series have."""
    w = F.pow(F.lit(0.5), F.col("age") / halflife)
    p = _pairs(_recent(df, key, x, None)).withColumn("w", w)
    g = p.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("w").alias("_w"), F.sum(w * w).alias("_w2"), F.sum(F.col("w") * F.col("x")).alias("_x"), F.sum(F.col("w") * F.col("y")).alias("_y"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("_xy")).where(F.col("n") >= least)
    biased = F.col("_xy") / F.col("_w") - F.col("_x") / F.col("_w") * F.col("_y") / F.col("_w")
    return g.select("a", "b", "n", (biased * R.ratio(F.col("_w") * F.col("_w"), F.col("_w") * F.col("_w") - F.col("_w2"))).alias("cov"))


def ledoit_wolf(df: DataFrame, key: str, x: str, days: int = 252) -> DataFrame:
    """Covariance shrunk towards a scaled identity with the optimal intensity, over the last `days` dates; a missing value counts as 0.

    The squared distance of all outer products from their mean S needs no
    matrix on the driver: over dates it is the sum of squared squared norms less
    n times the squared norm of S."""
    rows = _recent(df, key, x, days)
    grid = rows.select("date", "age").distinct().join(rows.select("k").distinct().withColumn("_j", F.lit(1)), F.lit(True)).select("date", "age", "k")  # dates of the window x a short list
    full = grid.join(rows.select("date", "k", "x"), ["date", "k"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    full = full.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("k")))
    n = full.agg(F.countDistinct("date").alias("n"), F.countDistinct("k").alias("p"))
    s = _pairs(full).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("_s")).crossJoin(F.broadcast(n)).withColumn("_s", F.col("_s") / F.col("n"))  # one row
    same = F.col("a") == F.col("b")
    norms = full.groupBy("date").agg(F.pow(F.sum(F.col("x") * F.col("x")), 2).alias("_q")).agg(F.sum("_q").alias("_q"))
    one = s.agg(F.max("n").alias("n"), F.max("p").alias("p"), F.sum(F.when(same, F.col("_s"))).alias("_t"), F.sum(F.col("_s") * F.col("_s") * F.when(same, 1).otherwise(2)).alias("_f")).crossJoin(F.broadcast(norms))  # one row each
    mu = F.col("_t") / F.col("p")
    delta = (F.col("_f") - F.col("p") * mu * mu) / F.col("p")
    beta = F.least((F.col("_q") - F.col("n") * F.col("_f")) / (F.col("n") * F.col("n") * F.col("p")), delta)
    one = one.select(mu.alias("_mu"), F.when(delta == 0, 1.0).otherwise(beta / delta).alias("intensity"))
    x2 = s.crossJoin(F.broadcast(one))  # one row
    scale = F.col("n") / (F.col("n") - 1)
    return x2.select("a", "b", "intensity", ((F.when(same, F.col("intensity") * F.col("_mu")).otherwise(0.0) + (1 - F.col("intensity")) * F.col("_s")) * scale).alias("cov"))


def volatility(weights: DataFrame, cov: DataFrame, cap: float | None = None, year: int = 252) -> DataFrame:
    """Per date: yearly volatility of the weights (`k`, `weight`) under the pairs of `cov`, and the factor that brings it to `cap`."""
    w = weights.select("date", "k", "weight")
    x = cov.join(w.select("date", F.col("k").alias("a"), F.col("weight").alias("_a")), "a").join(w.select("date", F.col("k").alias("b"), F.col("weight").alias("_b")), ["date", "b"])
    variance = F.sum(F.col("_a") * F.col("_b") * F.col("cov") * F.when(F.col("a") == F.col("b"), 1).otherwise(2))
    g = x.groupBy("date").agg(F.sqrt(F.greatest(variance, F.lit(0.0)) * year).alias("volatility"))
    return g if cap is None else g.withColumn("scale", F.when(F.col("volatility") > cap, cap / F.col("volatility")).otherwise(1.0))

"""Bootstrap of fold metrics with draws that depend on the seed alone, not on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bootstrap(folds: DataFrame, value: str, key: str = "metric", fold: str = "fold", draws: int = 1000, seed: int = 20260430, confidence: float = 0.8) -> DataFrame:
    """Per metric: observations, mean, and the one-sided interval of the mean over `draws` resamples of its folds with replacement.

    The i-th pick of draw b takes the fold whose place is the first 32 bits of
    md5(seed-b-i) modulo the number of folds, so any engine draws the same. Rows
    are draws x folds a metric; means are taken before anything is collected."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(fold)) - 1
    x = folds.where(F.col(value).isNotNull()).select(key, F.col(value).alias("x"), place.alias("i"), F.count(value).over(Window.partitionBy(key)).alias("n"))
    picks = x.select(key, "i", "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    at = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "b", "i")), 1, 8), 16, 10).cast("long") % F.col("n")
    means = picks.select(key, "b", at.cast("int").alias("i")).join(x.select(key, "i", "x"), [key, "i"]).groupBy(key, "b").agg(F.avg("x").alias("m"))
    interval = means.groupBy(key).agg(F.percentile("m", 1 - confidence).alias("ci_low"), F.max("m").alias("ci_high"))
    own = x.groupBy(key).agg(F.count("*").alias("observations"), F.avg("x").alias("mean"))
    return own.join(interval, key).select(key, "observations", "mean", "ci_low", "ci_high", (F.col("ci_low") <= 0).alias("crosses_zero"))

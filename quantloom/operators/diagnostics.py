"""Diagnostics of features and scores: missing values, rank information, agreement, sanity ranges."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def _long(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keep, columns, "feature", "value")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per feature: rows, missing rows and their share, in one pass."""
    g = _long(df.select(columns), [], columns).groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"))
    return g.withColumn("share", F.col("missing") / F.col("n"))


def missing_reasons(columns: list[str]) -> Column:
    """Names of the columns that are null, in order; empty for a complete row."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))


def daily_rank_correlations(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per date and pair of columns (default: each two): rows of the date (`n`), rows that have both (`both`) and the rank correlation over these (`c`), null where one of them does not vary.

    One shuffle of the rows by date; a task holds the columns of one date. Each
    column is ranked once, and again only for pairs with other missing rows."""
    pairs = pairs or list(combinations(columns, 2))

    def one(t: pa.Table) -> pa.Table:
        x = {c: t.column(c).to_numpy(zero_copy_only=False) for c in columns}
        there = {c: t.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns}
        ranks: dict[tuple[str, bytes], np.ndarray] = {}
        size, value = [], []
        for a, b in pairs:
            mask = there[a] & there[b]
            key = mask.tobytes()
            for c in (a, b):
                if (c, key) not in ranks:
                    ranks[c, key] = R.average_ranks(x[c][mask])
            size.append(int(mask.sum())), value.append(R.correlation_of(ranks[a, key], ranks[b, key]))
        k = len(pairs)
        return pa.table({
            "date": pa.array([t.column("date")[0].as_py()] * k, t.schema.field("date").type), "a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string()),
            "n": pa.array([t.num_rows] * k, pa.int64()), "both": pa.array(size, pa.int64()), "c": pa.array(value, pa.float64()),
        })

    kind = dict(df.dtypes)["date"]
    rows = df.select("date", *(F.col(c).cast("double").alias(c) for c in columns))
    return rows.groupBy("date").applyInArrow(one, f"date {kind}, a string, b string, n long, both long, c double")


def ic_of(daily: DataFrame, label: str, least: int = 10) -> DataFrame:
    """`factor_ic` from daily rank correlations whose second column is the label."""
    daily = daily.where(F.col("b") == label).select(F.col("a").alias("feature"), F.col("c").alias("ic"), "both").where((F.col("both") >= least) & F.col("ic").isNotNull())
    sd = F.stddev_pop("ic")
    return daily.groupBy("feature").agg(F.count("*").alias("dates"), F.avg("ic").alias("ic_mean"), sd.alias("ic_std"), F.coalesce(R.ratio(F.avg("ic"), sd), F.lit(0.0)).alias("ic_ir"))


def agreement_of(daily: DataFrame, least: int = 20) -> DataFrame:
    """`rank_agreement` from daily rank correlations."""
    return daily.where(F.col("n") >= least).groupBy("a", "b").agg(F.count("*").alias("dates"), F.avg(F.coalesce("c", F.lit(0.0))).alias("agreement"))


def factor_ic(df: DataFrame, columns: list[str], label: str, least: int = 10) -> DataFrame:
    """Per feature: dates, mean, population deviation and ratio of the daily rank correlation with the label, over dates with `least` rows."""
    return ic_of(daily_rank_correlations(df, [*columns, label], [(c, label) for c in columns]), label, least)


def rank_agreement(df: DataFrame, columns: list[str], least: int = 20) -> DataFrame:
    """Per pair of a short list of features: daily rank correlation over rows that have both, averaged over the dates with `least` rows; a date without a value counts as 0."""
    return agreement_of(daily_rank_correlations(df, columns), least)


def score_ranges(df: DataFrame, score: str) -> DataFrame:
    """One row: quantiles over dates of each date's smallest, largest and mean score, deviation, quantiles and lead of the top."""
    q = F.percentile(score, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    daily = df.where(F.col(score).isNotNull()).groupBy("date").agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), q.alias("q"))
    daily = daily.withColumn("lead", F.col("q")[2] - F.col("q")[1]).withColumn("p05", F.col("q")[0]).withColumn("p50", F.col("q")[1]).withColumn("p95", F.col("q")[2])
    mids = [F.percentile(c, 0.5).alias(f"{c}_p50") for c in ("lo", "hi", "mean", "p05", "p50", "p95")]
    lows = [F.percentile(c, p / 100).alias(f"{c}_p{p:02d}") for c in ("std", "lead") for p in (1, 5)]
    return daily.agg(*mids, *lows, F.count("*").alias("n_days"))


def above_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows above the median of their date in every column; a column without values on a date is ignored there, a missing value fails."""
    mids = df.groupBy("date").agg(*(F.median(c).alias(f"_mid_{c}") for c in columns))
    out = df.join(mids, "date")
    for c in columns:
        out = out.where(F.col(f"_mid_{c}").isNull() | (F.col(c) > F.col(f"_mid_{c}")))
    return out.drop(*(f"_mid_{c}" for c in columns))


def complete_rows(df: DataFrame, columns: list[str], last: int) -> DataFrame:
    """Rows without a missing value on each of the last dates."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.groupBy("date").agg(F.count_if(whole).alias("complete")).orderBy(F.desc("date")).limit(last)


def longest_run(df: DataFrame, flag: Column, order: str, by: list[str] | None = None) -> DataFrame:
    """Per `by` (default one row): the longest run of consecutive rows for which `flag` holds; 0 without any."""
    by = by or ["_one"]
    df = df.withColumn("_one", F.lit(1)).withColumn("_flag", F.coalesce(flag, F.lit(False)))
    island = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - F.row_number().over(Window.partitionBy(*by, "_flag").orderBy(order))
    runs = df.withColumn("_island", island).groupBy(*by, "_flag", "_island").agg(F.count("*").alias("_n"))
    return runs.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_flag"), F.col("_n"))), F.lit(0)).alias("longest"))


def stability(folds: DataFrame, x: str, fold: str, early: Column) -> DataFrame:
    """One row from one value per fold: number, mean, coefficient of variation, worst, median, share above 0, early less late mean, longest run of folds below the median."""
    folds = folds.withColumn("_one", F.lit(1))  # a handful of rows
    mids = folds.withColumn("_mid", F.median(x).over(Window.partitionBy("_one")))
    runs = longest_run(mids, F.col(x) < F.col("_mid"), fold)
    out = mids.groupBy("_one").agg(
        F.count(x).alias("folds"), F.avg(x).alias("mean"), R.ratio(F.stddev_pop(x), F.abs(F.avg(x))).alias("variation"), F.min(x).alias("worst"), F.max("_mid").alias("median"),
        F.avg((F.col(x) > 0).cast("int")).alias("positive"), (F.avg(F.when(early, F.col(x))) - F.avg(F.when(~early, F.col(x)))).alias("decay"),
    )
    return out.join(runs, "_one").drop("_one").withColumnRenamed("longest", "longest_low")


def conflict_groups(edges: DataFrame, strength: DataFrame) -> DataFrame:
    """Features linked by conflicts (a, b), directly or through others: group, feature, size, ic_mean, and whether it represents the group by the largest mean information in size, then by name."""
    from quantloom.functions.graphs import components

    c = components(edges).select(F.col("component").alias("group"), F.col("node").alias("feature")).join(strength.select("feature", "ic_mean"), "feature", "left")
    order = Window.partitionBy("group").orderBy(F.desc(F.round(F.abs(F.coalesce("ic_mean", F.lit(0.0))), 9)), "feature")
    return c.select("group", "feature", F.count("*").over(Window.partitionBy("group")).alias("size"), "ic_mean", (F.row_number().over(order) == 1).alias("representative"))

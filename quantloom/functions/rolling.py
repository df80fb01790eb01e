"""Window expressions with the panel rules: full windows only, sample or population moments by choice, ties averaged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def history(key: str = "id", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def last_n(n: int, key: str = "id", order: str = "date") -> WindowSpec:
    return history(key, order).rowsBetween(-(n - 1), 0)


def next_n(first: int, last: int, key: str = "id", order: str = "date") -> WindowSpec:
    return history(key, order).rowsBetween(first, last)


def full(agg: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None) -> Column:
    """`agg` of the last n rows if at least `least` of them (default n) are not null."""
    x = F.col(x) if isinstance(x, str) else x
    w = last_n(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def mean(x: Column | str, n: int, least: int | None = None) -> Column:
    return full(F.avg, x, n, least)


def std(x: Column | str, n: int, least: int | None = None) -> Column:
    return full(F.stddev_samp, x, n, least)


def std0(x: Column | str, n: int, least: int | None = None) -> Column:
    return full(F.stddev_pop, x, n, least)


def skew(x: Column | str, n: int) -> Column:
    """Bias-corrected skewness of the last n rows."""
    return full(F.skewness, x, n) * (n * (n - 1)) ** 0.5 / (n - 2)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def correlation(x: str, y: str) -> Column:
    """Correlation over the rows that have both, as an aggregate; null where one of them does not vary, which the built-in answers with an error in ANSI mode."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return ratio(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def average_rank(x: str, by: list[str]) -> Column:
    """Rank from 1 within `by`; ties share the mean of their ranks; null for null. Rank and ties come from one order, so from one sort."""
    order = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
    ties = F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """`average_rank` of the values of one group held by a task; NaN is the largest, as in Spark."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def largest_first(x: np.ndarray) -> np.ndarray:
    """Places of the values of one group held by a task, largest first; ties stay in order, NaN is the largest, as in Spark."""
    return np.lexsort((-x, ~np.isnan(x)))


def correlation_of(x: np.ndarray, y: np.ndarray) -> float | None:
    """Correlation of values held by a task; null where one of them does not vary."""
    if len(x) == 0 or (x == x[0]).all() or (y == y[0]).all():
        return None
    u, v = x - x.mean(), y - y.mean()
    return float((u @ v) / np.sqrt((u @ u) * (v @ v)))


def percent_rank(x: str, by: list[str]) -> Column:
    return average_rank(x, by) / F.count(F.col(x)).over(Window.partitionBy(*by))


Source = str | Callable[[pd.DataFrame], pd.Series]


def exponential(df: DataFrame, specs: dict[str, tuple[Source, float, int]], key: str = "id", order: str = "date") -> DataFrame:
    """Add columns of recursive smoothing y = a x + (1 - a) y', seeded by the first value.

    specs: new column -> (source, a, least number of values); a source is a
    column, one smoothed before it, or a function of both. One group per
    instrument, so rows of one instrument must fit a task, as a price history
    does; instruments run in parallel."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{c}` double" for c in specs)])

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        for c, (source, a, least) in specs.items():
            x = source(pdf) if callable(source) else pdf[source]
            pdf[c] = x.astype(float).ewm(alpha=a, adjust=False, min_periods=least).mean()
        return pdf

    out = df.groupBy(key).applyInPandas(smooth, schema)
    return out.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in specs else c for c in out.columns))


def asof(probes: DataFrame, facts: DataFrame, key: list[str], probe_time: str, fact_time: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the latest fact of its key at or before its time.

    One union, one shuffle by key and one sort replace a range join; facts sort
    before probes of the same time, so the match is inclusive."""
    names = [c for c in probes.columns]
    a = facts.select(*key, F.col(fact_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_fact"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in names if c not in key))
    b = probes.select(*key, F.col(probe_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_fact"].dataType).alias("_fact"), *(c for c in names if c not in key))
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_fact", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*names, *(F.col(f"_fact.{v}").alias(v) for v in values))

"""Market regimes for all dates at once: trend, direction and rotation scores of a market's day bars, and the label they give.

A market is one series with a row a day; every score of a date looks back only.
Smoothing starts at the first bar of the history."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import scalars as S

# Weights of the parts of each score.
TREND = {"adx_score": 0.35, "hurst_score": 0.15, "width_score": 0.20, "atr_score": 0.15, "volume_score": 0.15}
DIRECTION = {"arrangement": 0.30, "macd_sign": 0.25, "return_sign": 0.20, "place": 0.15, "rsrs_sign": 0.10}
ROTATION = {"dispersion": 0.35, "skew": 0.20, "neutrality": 0.25, "concentration": 0.20}
LAGS = range(2, 21)


def weighted(parts: dict[str, float]) -> Column:
    """Weighted mean over the parts that are not null; null without any."""
    value = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts.items()), F.lit(0.0))
    return R.ratio(value, weight)


def wilder(x: pd.Series, n: int) -> pd.Series:
    """Wilder smoothing seeded at row n by the mean of the first n values; a missing value repeats the last."""
    out = pd.Series(np.nan, index=x.index, dtype=float)
    if len(x) >= n:
        rest = np.concatenate(([np.nanmean(x.to_numpy(float)[:n])], x.to_numpy(float)[n:]))
        out.iloc[n - 1 :] = pd.Series(rest).ewm(alpha=1 / n, adjust=False, ignore_na=True).mean().to_numpy()
    return out


def _smooth(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("date").reset_index(drop=True)
    high, low, close = (pdf[c].astype(float) for c in ("high", "low", "close"))
    before = close.shift()
    span = pd.concat([high - low, (high - before).abs(), (low - before).abs()], axis=1).max(axis=1)
    span[0] = np.nan
    up, down = high.diff(), -low.diff()
    atr = wilder(span, 14)
    plus, minus = (100 * wilder(x.where(c, 0.0), 14) / atr for x, c in ((up, (up > down) & (up > 0)), (down, (down > up) & (down > 0))))
    total = plus + minus
    dx = (100 * (plus - minus).abs() / total).where(total > 0, 0.0)
    macd = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    pdf["atr"], pdf["adx"], pdf["hist"] = atr, wilder(dx, 14), macd - macd.ewm(span=9, adjust=False).mean()
    return pdf.astype({"atr": float, "adx": float, "hist": float})


def trend_and_direction(bars: DataFrame, key: str = "market") -> DataFrame:
    """Per market and date: the parts of both scores and `trendiness`, `direction` and `label` (bull, bear or range)."""
    schema = f"{key} {dict(bars.dtypes)[key]}, date date, high double, low double, close double, volume double, atr double, adx double, hist double"
    df = bars.select(key, "date", "high", "low", "close", "volume").groupBy(key).applyInPandas(_smooth, schema)
    df = df.select(*(F.nanvl(c, F.lit(None)).alias(c) if c in ("atr", "adx", "hist") else c for c in df.columns))
    h = Window.partitionBy(key).orderBy("date")
    last = lambda n: h.rowsBetween(-(n - 1), 0)
    full = lambda f, x, n, least=None: F.when(F.count(x).over(last(n)) >= (least or n), f(x).over(last(n)))
    lag = lambda x, n=1: F.lag(x, n).over(h)
    c = F.col("close")
    df = df.withColumns({f"d{k}": c - lag("close", k) for k in LAGS} | {
        "n": F.row_number().over(h), "ret": R.ratio(c, lag("close")) - 1, "change": R.ratio(F.col("volume"), lag("volume")) - 1, "width": R.ratio(4 * full(F.stddev_pop, "close", 20), full(F.avg, "close", 20)),
        "slope": F.when(F.count("*").over(last(18)) >= 18, R.ratio(F.covar_pop("high", "low").over(last(18)), F.var_pop("low").over(last(18)))),
    })
    logs = [math.log(k) for k in LAGS]
    mid = sum(logs) / len(logs)
    spread = sum((v - mid) ** 2 for v in logs)
    deviations = {f"s{k}": F.stddev_pop(f"d{k}").over(h.rowsBetween(-(99 - k), 0)) for k in LAGS}
    df = df.withColumns(deviations).drop(*(f"d{k}" for k in LAGS))
    exponent = sum((F.when(F.col(f"s{k}") > 0, F.ln(f"s{k}")) * ((v - mid) / spread) for k, v in zip(LAGS, logs, strict=True)), F.lit(0.0))
    hurst = F.when(F.col("n") >= 100, S.clamp(2 * exponent))
    x, y = F.when(F.col("change").isNotNull(), F.col("ret")), F.when(F.col("ret").isNotNull(), F.col("change"))
    sx, sy = F.stddev_pop(x).over(last(20)), F.stddev_pop(y).over(last(20))
    pv = F.when((F.count(x).over(last(20)) >= 16) & (sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y).over(last(20)) / (sx * sy))
    widths = F.filter(F.collect_list("width").over(last(60)), lambda v: v.isNotNull())
    z = F.when(F.col("n") >= 270, R.ratio(F.col("slope") - full(F.avg, "slope", 252, 202), full(F.stddev_pop, "slope", 252, 202)))
    sign = lambda v: F.signum(v)
    averages = [full(F.avg, "close", n) for n in (5, 20, 60)]
    hist3 = [F.col("hist"), lag("hist"), lag("hist", 2)]
    top, bottom = full(F.max, "close", 60), full(F.min, "close", 60)
    df = df.withColumns({
        "adx": F.when(F.col("n") >= 16, F.col("adx")),
        "hurst_score": S.clamp(F.abs(hurst - 0.5) * 2), "width_score": F.when(F.col("width").isNotNull(), F.size(F.filter(widths, lambda v: v <= F.col("width"))) / F.size(widths)),
        "atr_score": F.when(F.col("n") >= 76, S.scaled(R.ratio(F.col("atr"), full(F.avg, "atr", 60)), 0.7, 1.5)), "volume_score": S.clamp(pv),
        "arrangement": F.when((averages[0] > averages[1]) & (averages[1] > averages[2]), 1.0).when((averages[0] < averages[1]) & (averages[1] < averages[2]), -1.0).when(averages[2].isNotNull(), 0.0),
        "macd_sign": F.when(hist3[2].isNotNull(), F.when((hist3[0] > 0) & (hist3[1] > 0) & (hist3[2] > 0), 1.0).when((hist3[0] < 0) & (hist3[1] < 0) & (hist3[2] < 0), -1.0).otherwise(0.0)),
        "return_sign": sign(R.ratio(c, lag("close", 20)) - 1), "place": F.when(top > bottom, S.clamp((c - bottom) / (top - bottom)) * 2 - 1), "rsrs_sign": sign(z),
    })
    df = df.withColumn("adx_score", S.scaled(F.col("adx"), 20, 35)).withColumn("trendiness", weighted(TREND)).withColumn("direction", weighted(DIRECTION))
    label = F.when(F.col("trendiness") < 0.45, "range").when(F.col("direction") > 0.35, "bull").when(F.col("direction") < -0.35, "bear").otherwise("range")
    return df.select(key, "date", "adx", *TREND, *DIRECTION, "trendiness", "direction", F.when(F.col("trendiness").isNull() | F.col("direction").isNull(), "range").otherwise(label).alias("label"))


def rotation(industries: DataFrame, breadth: DataFrame) -> DataFrame:
    """Per date from `industry`, `close` and from `advancing`, `declining`: the parts of the rotation score, the score and `structure` (rotation or co_move). A return spans five rows of the industry."""
    ret = R.ratio(F.col("close"), F.lag("close", 5).over(Window.partitionBy("industry").orderBy("date"))) - 1
    x = industries.withColumn("_r", ret).where("_r is not null").withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("_r")), "industry")))
    n = F.count("*")
    day = x.groupBy("date").agg(n.alias("_n"), F.stddev_pop("_r").alias("_d"), F.when(n > 2, F.skewness("_r") * F.sqrt(n * (n - 1)) / (n - 2)).alias("_s"), R.ratio(F.sum(F.when(F.col("_k") <= 3, F.abs("_r"))), F.sum(F.abs("_r"))).alias("_c"))
    day = breadth.select("date", "advancing", "declining").join(day, "date", "left")
    past = Window.orderBy("date").rowsBetween(-59, 0)  # one row a day
    known = F.filter(F.collect_list("_d").over(past), lambda v: v.isNotNull())
    enough = F.col("_n") >= 5
    ratio = R.ratio(F.col("advancing"), F.col("declining"))
    day = day.withColumns({
        "dispersion": F.when(enough, F.size(F.filter(known, lambda v: v <= F.col("_d"))) / F.size(known)), "skew": F.when(enough & ~F.isnan("_s"), S.clamp(F.abs("_s") / 2)),
        "concentration": F.when(enough, S.scaled(F.col("_c"), 0.25, 0.5)), "neutrality": F.when(ratio > 0, S.clamp(1 - F.abs(F.ln(ratio)) / math.log(2))),
    })
    day = day.withColumn("rotation", weighted(ROTATION))
    return day.select("date", *ROTATION, "rotation", F.when(F.col("rotation") >= 0.4, "rotation").otherwise("co_move").alias("structure"))


def regimes(trend: DataFrame, structure: DataFrame) -> DataFrame:
    """Per date: the joint label of direction and structure, and its strength, the geometric mean of both strengths (0 if one is missing)."""
    df = trend.join(structure, "date", "left").withColumn("structure", F.coalesce("structure", F.lit("co_move")))
    a = S.clamp(F.when(F.col("label") != "range", F.col("trendiness")).otherwise(1 - F.col("trendiness")))
    b = S.clamp(F.when(F.col("structure") == "rotation", F.col("rotation")).otherwise(1 - F.col("rotation")))
    return df.select("date", F.concat_ws("_", "label", "structure").alias("regime"), F.coalesce(F.sqrt(a * b), F.lit(0.0)).alias("strength"), "trendiness", "direction", "rotation")

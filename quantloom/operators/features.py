"""Per-instrument factors of day bars (id, date, open, high, low, close, volume, turnover).

All windows of a function share one partitioning and order, so Spark sorts once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import frames as A
from quantloom.functions import rolling as R


def lagged(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(R.history())


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", R.ratio(F.col("close"), lagged("close")) - 1)


def momentum(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Difference, rate of change, bias, returns over 5, 20, 40 and 60 days, gaps to and between averages, place in the range of closes (0.5 where there is none) and distance to its top."""
    c = F.col("close")
    change = lambda n: R.ratio(c, lagged("close", n)) - 1
    low, high = (lambda n: R.full(F.min, "close", n)), (lambda n: R.full(F.max, "close", n))
    place = lambda n: F.coalesce(R.ratio(c - low(n), high(n) - low(n)), F.lit(0.5))
    return bars.select(
        "id", "date", *keep, (c - lagged("close", 10)).alias("mom"), change(10).alias("roc"), (R.ratio(c, R.mean("close", 6)) - 1).alias("bias"),
        (-change(5)).alias("reversal"), change(20).alias("mom20"), change(40).alias("mom40"), change(60).alias("mom60"),
        *((R.ratio(c, R.mean("close", n)) - 1).alias(f"ma_gap{n}") for n in (20, 60)), (R.ratio(R.mean("close", 10), R.mean("close", 40)) - 1).alias("ma_cross"),
        *(place(n).alias(f"place{n}") for n in (20, 60)), (R.ratio(c, high(60)) - 1).alias("to_high60"),
    )


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.select("id", "date", *(F.col(c).cast("double").alias(c) for c in names))


def volatility(bars: DataFrame) -> DataFrame:
    """Yearly volatility, downside volatility, corrected skew, 20-day drawdown, Bollinger bands and Donchian channel. A task holds one instrument's history."""
    last = lambda kind, c: lambda t: A.rolling(kind, t[c], 20)
    of = lambda f, *names: lambda t: A.both(f, *(t[c] for c in names))
    df = A.by_history(_doubles(with_returns(bars), "high", "low", "close", "ret"), {
        "down": of(lambda r: np.fmin(r, 0.0) ** 2, "ret"), "peak": last("max", "close"), "fall": lambda t: A.both(lambda q: q - 1, A.ratio(t["close"], t["peak"])), "vol": last("std", "ret"), "down_mean": last("mean", "down"),
        "sk": last("skew", "ret"), "boll_mid": last("mean", "close"), "sd": last("std0", "close"), "don_up": last("max", "high"), "don_low": last("min", "low"), "drawdown20": last("min", "fall"),
        "vol20": of(lambda v: v * math.sqrt(252.0), "vol"), "down_vol20": of(lambda v: np.sqrt(v * 252), "down_mean"), "skew20": of(lambda v: v * (20 * 19) ** 0.5 / 18, "sk"),
        "boll_up": of(lambda m, v: m + 2 * v, "boll_mid", "sd"), "boll_low": of(lambda m, v: m - 2 * v, "boll_mid", "sd"), "boll_width": lambda t: A.ratio(A.both(lambda v: 4 * v, t["sd"]), t["boll_mid"]),
        "don_mid": of(lambda a, b: (a + b) / 2, "don_up", "don_low"),
    }, drop=("high", "low", "close", "ret", "down", "peak", "fall", "vol", "down_mean", "sk", "sd"))
    return df.select("id", "date", "vol20", "down_vol20", "skew20", "drawdown20", "boll_up", "boll_mid", "boll_low", "boll_width", "don_up", "don_low", "don_mid")


def liquidity(bars: DataFrame) -> DataFrame:
    """Volume ratio and trend, turnover ratio and stability, log dollar volume, turnover by volatility, Amihud illiquidity, on-balance volume with its mean and money flow (null without falls)."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = with_returns(bars).withColumn("typical", typical).withColumn("diff", F.col("close") - lagged("close"))
    df = df.withColumn("rise", F.col("typical") - lagged("typical")).withColumn("flow", F.col("typical") * F.col("volume"))
    df = df.withColumn("signed", F.coalesce(F.signum("diff"), F.lit(0.0)) * F.col("volume"))
    up = F.sum(F.when(F.col("rise") > 0, F.col("flow")).otherwise(0.0)).over(R.last_n(14))
    down = F.sum(F.when(F.col("rise") < 0, F.col("flow")).otherwise(0.0)).over(R.last_n(14))
    impact = R.ratio(F.abs("ret"), F.greatest(F.col("turnover"), F.lit(1.0)))
    df = df.withColumn("proxy", F.greatest(F.col("turnover"), F.lit(1.0))).withColumn("obv", F.sum("signed").over(R.history().rowsBetween(Window.unboundedPreceding, 0)))
    log_mean = F.log1p(R.mean("proxy", 20))
    return df.select(
        "id", "date", R.ratio(F.col("volume"), R.mean("volume", 20)).alias("volume_ratio"), (R.ratio(R.mean("volume", 5), R.mean("volume", 20)) - 1).alias("volume_trend"),
        R.ratio(F.col("proxy"), R.mean("proxy", 20)).alias("turnover_ratio"), R.ratio(R.mean("proxy", 20), R.std("proxy", 20)).alias("turnover_stability"), log_mean.alias("log_turnover"),
        R.ratio(log_mean, R.std("ret", 20) * F.sqrt(F.lit(252.0))).alias("vol_turnover"), (R.mean(impact, 20) * 1e6).alias("amihud"), "obv", R.mean("obv", 20).alias("obv_mean"),
        F.when(F.count("*").over(R.last_n(14)) >= 14, 100 - 100 / (1 + R.ratio(up, down))).alias("mfi"),
    )


def _z(t: dict[str, A.Series], c: str, n: int, least: int | None = None) -> A.Series:
    return A.ratio(A.both(np.subtract, t[c], A.rolling("mean", t[c], n, least)), A.rolling("std0", t[c], n, least))


def oscillators(bars: DataFrame) -> DataFrame:
    """Commodity channel index and the high-to-low mean ratio with its z-score over 600 days. A task holds one instrument's history."""
    df = A.by_history(_doubles(bars, "high", "low", "close"), {
        "typical": lambda t: A.both(lambda h, l, c: (h + l + c) / 3, t["high"], t["low"], t["close"]), "gap": lambda t: A.both(np.subtract, t["typical"], A.rolling("mean", t["typical"], 20)), "away": lambda t: A.both(np.abs, t["gap"]),
        "cci": lambda t: A.ratio(t["gap"], A.both(lambda v: 0.015 * v, A.rolling("mean", t["away"], 20))), "rsrs": lambda t: A.ratio(A.rolling("mean", t["high"], 18), A.rolling("mean", t["low"], 18)), "rsrs_z": lambda t: _z(t, "rsrs", 600),
    }, drop=("high", "low", "close", "typical", "gap", "away"))
    return df.select("id", "date", "cci", "rsrs", "rsrs_z")


def regression_slope(bars: DataFrame) -> DataFrame:
    """Slope of high on low over 18 bars with its z-score over 252 slopes (80 % at least), correlation of return and change of volume over 20 bars (16 at least), and the percentile of the Bollinger width among the last 60. A task holds one instrument's history."""

    def slope(t: dict[str, A.Series]) -> A.Series:
        level = A.rolling("std0", t["low"], 18, 1)
        s = A.ratio(A.covariances(t["high"], t["low"], 18)[0], A.both(np.square, level))
        return A.Series(s.v, s.there & (np.arange(len(s.v)) >= 17))

    def together(t: dict[str, A.Series]) -> A.Series:
        cov, x, y = A.covariances(t["change"], t["ret"], 20)
        spread = A.both(lambda a, b: np.sqrt(a) * np.sqrt(b), x, y)
        n = A.counted(A.both(np.add, t["change"], t["ret"]), 20)
        r = A.ratio(cov, spread)
        return A.Series(r.v, r.there & (n.v >= 16) & ((spread.v > 1e-12) | np.isnan(spread.v)))

    df = with_returns(bars).withColumn("change", R.ratio(F.col("volume"), lagged("volume")) - 1)
    df = A.by_history(_doubles(df, "high", "low", "close", "ret", "change"), {
        "slope": slope, "slope_z": lambda t: _z(t, "slope", 252, 202), "pv_corr": together, "width": lambda t: A.ratio(A.both(lambda v: 4 * v, A.rolling("std0", t["close"], 20)), A.rolling("mean", t["close"], 20)), "width_pct": lambda t: A.rolling("share", t["width"], 60, 1),
    }, drop=("high", "low", "close", "ret", "change", "width"))
    return df.select("id", "date", "slope", "slope_z", "pv_corr", "width_pct")


def beta(bars: DataFrame, bench: DataFrame, n: int = 60) -> DataFrame:
    """Rolling beta to the benchmark's return and 20- and 60-day momentum in excess of the benchmark's. Benchmark rows are one a day."""
    by_date = R.history("_all")
    b = bench.withColumn("_all", F.lit(0)).select("date", (R.ratio(F.col("bench"), F.lag("bench").over(by_date)) - 1).alias("bret"), *((R.ratio(F.col("bench"), F.lag("bench", n).over(by_date)) - 1).alias(f"bmom{n}") for n in (20, 60)))
    df = with_returns(bars).join(b, "date", "left")
    w = R.last_n(n)
    x, y = F.when(F.col("bret").isNotNull(), F.col("ret")), F.when(F.col("ret").isNotNull(), F.col("bret"))
    return df.select(
        "id", "date", F.when(F.count(x).over(w) >= n, R.ratio(F.covar_samp(x, y).over(w), F.var_samp(y).over(w))).alias("beta"),
        *((R.ratio(F.col("close"), lagged("close", n)) - 1 - F.col(f"bmom{n}")).alias(f"excess_mom{n}") for n in (20, 60)),
    )


def smoothed(bars: DataFrame) -> DataFrame:
    """Wilder RSI, ATR and ADX of 14 days, MACD histogram 12/26/9, EMA 12 and 26, and KDJ of 9 days, in one pass over each instrument's history.

    The directional moves of this ADX do not exclude each other."""
    prev = lagged("close")
    span = R.full(F.max, "high", 9) - R.full(F.min, "low", 9)
    df = bars.select(
        "id", "date", "close", F.when(prev.isNotNull(), F.greatest(F.col("close") - prev, F.lit(0.0))).alias("gain"), F.when(prev.isNotNull(), F.greatest(prev - F.col("close"), F.lit(0.0))).alias("loss"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)).alias("range"),
        F.greatest(F.coalesce(F.col("high") - lagged("high"), F.lit(0.0)), F.lit(0.0)).alias("up"), F.greatest(F.coalesce(lagged("low") - F.col("low"), F.lit(0.0)), F.lit(0.0)).alias("down"),
        (100 * R.ratio(F.col("close") - R.full(F.min, "low", 9), span)).alias("rsv"),
    )
    dx = lambda t: 100 * ((t["pu"] - t["pd"]).abs() / (t["pu"] + t["pd"]).where(lambda x: x != 0))
    df = R.exponential(df, {
        "g": ("gain", 1 / 14, 14), "l": ("loss", 1 / 14, 14), "atr": ("range", 1 / 14, 14), "e12": ("close", 2 / 13, 1), "e26": ("close", 2 / 27, 1), "dea": (lambda t: t["e12"] - t["e26"], 2 / 10, 1),
        "pu": ("up", 1 / 14, 14), "pd": ("down", 1 / 14, 14), "adx": (dx, 1 / 14, 14), "k": ("rsv", 1 / 3, 1), "d": ("k", 1 / 3, 1),
    })
    k, d = F.col("k"), F.col("d")
    return df.select("id", "date", (100 - 100 / (1 + R.ratio(F.col("g"), F.col("l")))).alias("rsi"), "atr", "e12", "e26", (2 * (F.col("e12") - F.col("e26") - F.col("dea"))).alias("macd"), "adx", "k", "d", (3 * k - 2 * d).alias("j"))


def percentile_of_last(df: DataFrame, x: str, n: int, least: int, name: str = "pct", key: str = "id", order: str = "date") -> DataFrame:
    """`key`, `order` and the Hazen percentile of the current value among the last n rows' values: (mean rank - 0.5) / count; null without a value and below `least` values.

    A task holds one key's history and compares some rows at a time with all
    values of their windows."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        there = t.column("_x").is_valid().to_numpy(zero_copy_only=False)
        code = np.unique(t.column("_x").to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int32)  # NaN is the largest
        code[~there] = -1
        padded, out = np.concatenate([np.full(n - 1, -1, np.int32), code]), np.empty(len(code))
        windows = np.lib.stride_tricks.sliding_window_view(padded, n)
        missing = np.zeros(len(code), bool)
        for lo in range(0, len(code), 256):
            w, now = windows[lo : lo + 256], code[lo : lo + 256, None]
            size = (w >= 0).sum(axis=1)
            less, same = ((w < now) & (w >= 0)).sum(axis=1), (w == now).sum(axis=1)
            out[lo : lo + 256] = (less + (same + 1) / 2 - 0.5) / np.maximum(size, 1)
            missing[lo : lo + 256] = (now[:, 0] < 0) | (size < least)
        return pa.table({key: t.column(key), order: t.column(order), name: pa.array(out, pa.float64(), mask=missing)})

    kinds = dict(df.dtypes)
    rows = df.select(key, order, F.col(x).cast("double").alias("_x"))
    return rows.groupBy(key).applyInArrow(one, f"{key} {kinds[key]}, {order} {kinds[order]}, {name} double")


def crossings(bars: DataFrame) -> DataFrame:
    """Moving-average crosses, channel breakouts and dual-thrust bounds: 1 up, -1 down, 0 none."""
    df = bars.withColumn("gap", R.mean("close", 5) - R.mean("close", 20)).withColumn("was", lagged("gap"))
    before = lambda f, x, n: F.when(F.count(x).over(R.next_n(-n, -1)) >= n, f(x).over(R.next_n(-n, -1)))
    df = df.withColumns({"top": before(F.max, "high", 55), "bottom": before(F.min, "low", 20), "hh": before(F.max, "high", 2), "ll": before(F.min, "low", 2), "hc": before(F.max, "close", 2), "lc": before(F.min, "close", 2)})
    cross = F.when((F.col("gap") > 0) & (F.col("was") <= 0), 1).when((F.col("gap") < 0) & (F.col("was") >= 0), -1).otherwise(0)
    breakout = F.when(F.col("close") > F.col("top"), 1).when(F.col("close") < F.col("bottom"), -1).otherwise(0)
    span = F.greatest(F.col("hh") - F.col("lc"), F.col("hc") - F.col("ll"))
    return df.select("id", "date", cross.alias("cross"), breakout.alias("breakout"), (F.col("open") + 0.5 * span).alias("buy_above"), (F.col("open") - 0.5 * span).alias("sell_below"))


def trade_signals(bars: DataFrame, account: float = 1e6, risk: float = 0.01) -> DataFrame:
    """MACD cross (1 up, -1 down, 0), RSI of plain 14-day means (7 at least, 50 where there is none) with its signal (1 below 30, -1 above 70), stop price of a 55-day breakout two mean ranges below, and the unit that risks a share of the account."""
    prev = lagged("close")
    df = bars.withColumns({
        "range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        "gain": F.when(prev.isNotNull(), F.greatest(F.col("close") - prev, F.lit(0.0))), "loss": F.when(prev.isNotNull(), F.greatest(prev - F.col("close"), F.lit(0.0))),
    })
    df = R.exponential(df, {"e12": ("close", 2 / 13, 1), "e26": ("close", 2 / 27, 1), "dea": (lambda t: t["e12"] - t["e26"], 2 / 10, 1)}).withColumn("hist", F.col("e12") - F.col("e26") - F.col("dea"))
    before = R.next_n(-55, -1)
    top = F.when(F.count("high").over(before) >= 55, F.max("high").over(before))
    rsi = F.coalesce(100 - 100 / (1 + R.ratio(R.mean("gain", 14, 7), R.mean("loss", 14, 7))), F.lit(50.0))
    df = df.withColumn("was", lagged("hist")).withColumn("atr", R.mean("range", 20)).withColumn("rsi", rsi).withColumn("top", top)
    cross = F.when((F.col("hist") > 0) & (F.col("was") <= 0), 1).when((F.col("hist") < 0) & (F.col("was") >= 0), -1).otherwise(0)
    return df.select(
        "id", "date", cross.alias("macd_cross"), F.when(F.col("rsi") < 30, 1).when(F.col("rsi") > 70, -1).otherwise(0).alias("rsi_signal"), "rsi",
        F.when(F.col("close") > F.col("top"), F.col("close") - 2 * F.col("atr")).alias("stop"), R.ratio(F.lit(risk * account), F.col("atr")).alias("unit"),
    )


def _recent(df: DataFrame, x: str, n: int, key: str, order: str) -> DataFrame:
    """The last n rows of each key with a finite x; `_now` is the latest x."""
    back = Window.partitionBy(key).orderBy(F.col(order).desc())
    good = df.where(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return good.withColumn("_k", F.row_number().over(back)).withColumn("_now", F.first(x).over(back)).where(F.col("_k") <= n)


def latest_percentile(df: DataFrame, x: str, n: int = 252, key: str = "id", order: str = "date") -> DataFrame:
    """Per key: latest x and the share of the last n values that are not larger; null below min(n, 20) values. Keys without a value are left out."""
    share = F.avg(F.when(F.col(x) <= F.col("_now"), 1.0).otherwise(0.0))
    return _recent(df, x, n, key, order).groupBy(key).agg(F.max("_now").alias("value"), F.when(F.count("*") >= min(n, 20), share).alias("percentile"))


def hurst(df: DataFrame, x: str, n: int = 100, lags: int = 20, key: str = "id", order: str = "date") -> DataFrame:
    """Per key: twice the slope of log deviation of lagged differences on log lag, within 0 and 1, over the last n values; null with fewer values or without variance.

    All lags share one window, so the rows are sorted once."""
    h = R.history(key, order)
    span = range(2, lags + 1)
    rows = _recent(df, x, n, key, order).select(key, order, *((F.col(x) - F.lag(x, k).over(h)).alias(f"_d{k}") for k in span))
    moments = rows.groupBy(key).agg(F.count("*").alias("_n"), *(F.stddev_pop(f"_d{k}").alias(f"_s{k}") for k in span))
    logs = [math.log(k) for k in span]
    mid = sum(logs) / len(logs)
    spread = sum((v - mid) ** 2 for v in logs)
    slope = sum((F.when(F.col(f"_s{k}") > 0, F.ln(f"_s{k}")) * ((v - mid) / spread) for k, v in zip(span, logs, strict=True)), F.lit(0.0))
    return moments.select(key, F.when(F.col("_n") >= n, R.clip(2 * slope, 0.0, 1.0)).alias("hurst"))


def common(bars: DataFrame, full_liquidity: float = 5e8, fund_cost: float = 4e-4) -> DataFrame:
    """Factors for shares and funds alike: momentum, volatility with short minimum histories, liquidity, risk and cost forecasts, illiquidity, skew.

    `asset_type`, where the bars have it, gives funds ("etf") a flat cost. A task holds one instrument's history."""
    df = with_returns(bars).withColumn("_dv", F.greatest(F.coalesce(F.col("close") * F.coalesce("volume", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    df = df.withColumn("_impact", R.ratio(F.coalesce(F.abs("ret"), F.lit(0.0)), F.col("_dv")))
    vols = {"vol5": (5, 2), "vol10": (10, 3), "vol20": (20, 5), "vol60": (60, 10)}
    df = df.withColumn("momentum5", R.ratio(F.col("close"), lagged("close", 5)) - 1)
    kind = [c for c in bars.columns if c == "asset_type"]
    df = A.by_history(df.select("id", "date", *kind, *(F.col(c).cast("double").alias(c) for c in ("momentum5", "ret", "_dv", "_impact"))), {
        **{c: (lambda t, a=a: A.rolling("std", t["ret"], *a)) for c, a in vols.items()}, "_n": lambda t: A.counted(t["ret"], 20), "_skew": lambda t: A.rolling("skew", t["ret"], 20, 5),
        "_flow": lambda t: A.rolling("mean", t["_dv"], 20, 3), "_illiquid": lambda t: A.rolling("mean", t["_impact"], 20, 5),
    }, drop=("ret", "_impact"))
    skew = F.col("_skew") * F.sqrt(F.col("_n") * (F.col("_n") - 1)) / (F.col("_n") - 2)
    liquid = F.coalesce(R.clip(F.col("_flow") / full_liquidity, 0.0, 1.0), F.lit(0.0))
    cost = 0.0001 + (1 - liquid) * 0.0015
    if kind:
        cost = F.when(F.lower("asset_type") == "etf", fund_cost).otherwise(cost)
    return df.select(
        "id", "date", "momentum5", *vols, F.log1p("_dv").alias("dollar_volume"), liquid.alias("liquidity"), F.coalesce("vol20", F.lit(0.0)).alias("risk"), cost.alias("cost"),
        F.coalesce("_illiquid", F.lit(0.0)).alias("illiquidity"), F.coalesce(skew, F.lit(0.0)).alias("skew"),
    )

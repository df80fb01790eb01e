"""Rolling-window scores of a return series: indicators, quarters, composite, stability and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import diagnostics

# Per indicator the coefficients of the quartic, the range it holds on, the slopes beyond, and whether less is better.
CURVES = {
    "total_returns": ([0.0, 385.873016, 36.772487, -5579.365079, 16243.386243], -0.15, 0.3, 144.4444, 655.7937, False),
    "annualized_returns": ([-17.142857, 306.190476, 1033.333333, -6476.190476, 9523.809524], -0.1, 0.4, 130.0, 462.381, False),
    "excess_annual_returns": ([19.312452, 329.895595, -690.603514, 8041.762159, -13750.954927], -0.1, 0.2, 764.273, 578.6351, False),
    "max_drawdown": ([166.875, 1702.916667, 8391.666667, 22833.333333, 23333.333333], -0.35, -0.05, 218.3333, 1023.3333, True),
    "max_drawdown_duration_days": ([549.2455242967089, 9.365380789997912, 0.06447013829687052, 0.00019543904518330954, 2.1194468125416533e-07], -350, -90, 0.25, 1.8919, True),
    "excess_max_drawdown": ([229.705882, 6249.509804, 76062.091503, 419934.640523, 816993.464052], -0.2, -0.03, 382.3529, 2731.3725, True),
    "tracking_error": ([160.0, 1423.333333, 4633.333333, 2666.666667, -13333.333333], -0.3, -0.05, 803.3333, 986.6667, True),
    "sharpe": ([0.0, 70.434783, -80.942029, 55.652174, -10.144928], -0.3, 2.0, 135.1217, 89.8551, False),
    "sortino": ([0.0, 73.145743, -77.676768, 37.822671, -5.451339], -0.3, 3.0, 130.5527, 39.5527, False),
    "information_ratio": ([0.0, 76.260684, -59.850427, 59.496676, -15.906933], -0.3, 1.5, 129.953, 83.5684, False),
    "win_rate": ([-1920.0, 13426.666667, -34366.666667, 37333.333333, -13333.333333], 0.35, 0.6, 803.3333, 986.6667, False),
    "profit_loss_rate": ([-121.671068, 253.344465, -164.707265, 52.293645, -5.776856], 0.5, 3.0, 124.969, 53.1288, False),
    "monthly_excess_win_rate": ([-111.666667, 215.15873, 1013.492063, -2825.396825, 2222.222222], 0.25, 0.7, 331.0317, 529.6032, False),
}
# Weights of the indicators, and those shown beside the score.
WEIGHTS = {
    "total_returns": 0.12, "annualized_returns": 0.12, "excess_annual_returns": 0.06, "max_drawdown": 0.10, "max_drawdown_duration_days": 0.075, "excess_max_drawdown": 0.0375, "tracking_error": 0.0375,
    "sharpe": 0.10, "sortino": 0.10, "information_ratio": 0.05, "win_rate": 0.04, "profit_loss_rate": 0.06, "monthly_excess_win_rate": 0.10,
}
CORE = ["annualized_returns", "max_drawdown", "sharpe", "win_rate"]


def indicator_score(x: Column, curve: tuple) -> Column:
    """A quartic within its range, a straight line beyond; a missing value scores 0."""
    coefficients, lo, hi, left, right, less = curve
    x = -x if less else x
    at = lambda v: sum((c * (F.pow(v, F.lit(i)) if isinstance(v, Column) else v**i) if i else F.lit(c)) for i, c in enumerate(coefficients))
    return F.coalesce(F.when(x < lo, at(lo) + left * (x - lo)).when(x > hi, at(hi) + right * (x - hi)).otherwise(at(x)), F.lit(0.0))


def window_scores(df: DataFrame, curves: dict[str, tuple] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Add `score`: the weighted sum of the indicators' scores."""
    curves, weights = curves or CURVES, weights or WEIGHTS
    return df.withColumn("score", sum((indicator_score(F.col(k), curves[k]) * w for k, w in weights.items()), F.lit(0.0)))


def windows(daily: DataFrame, months: int = 12, every: int = 3, year: int = 252) -> DataFrame:
    """The thirteen indicators of rolling windows of `months`, one beginning every `every` months of the series (`ret`, `bench` per date): each row meets the windows that hold it, months / every at most.

    Excess is geometric: the value of the series over that of the benchmark.
    Falls count from the start of a window. The longest fall is told in days
    from the row before it to the one before the next higher value, or to the
    end. Profit and loss are the daily changes of the value."""
    month = F.year("date") * 12 + F.month("date") - 1
    first = daily.agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    rows = daily.withColumn("_m", month).crossJoin(F.broadcast(first))  # one row
    number = F.floor((F.col("_m") - F.col("_a")) / every)
    lowest = F.greatest(F.lit(0), F.ceil((F.col("_m") - F.col("_a") - months + 1) / every))
    rows = rows.withColumn("window", F.explode(F.sequence(lowest.cast("int"), number.cast("int")))).where(F.col("_a") + F.col("window") * every + months - 1 <= F.col("_b"))

    w = Window.partitionBy("window").orderBy("date")  # a year of rows
    so_far, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col("ret") - F.col("bench")
    rows = rows.withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(so_far))).withColumn("_x", F.col("_e") / F.exp(F.sum(F.log1p("bench")).over(so_far)))
    rows = rows.withColumn("_peak", F.max("_e").over(so_far)).withColumn("_xpeak", F.greatest(F.lit(1.0), F.max("_x").over(so_far))).withColumn("_gain", F.col("_e") - F.coalesce(F.lag("_e").over(w), F.lit(1.0)))
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_top", F.sum(F.coalesce((F.col("_e") > F.max("_e").over(last)).cast("int"), F.lit(0))).over(so_far)).withColumn("_before", F.lag("date").over(w))

    below = F.col("_e") < F.col("_peak")
    falls = rows.groupBy("window", "_top").agg(F.min(F.when(below, F.struct("_i", "_before"))).alias("_f"), F.max(F.struct("_i", "date", below.alias("below"))).alias("_l"))
    final = F.col("_top") == F.max("_top").over(Window.partitionBy("window"))
    length = F.col("_l._i") - F.col("_f._i") + 1 + F.when(final, F.when(F.col("_l.below"), 0)).otherwise(1)
    falls = falls.withColumn("_n", length).where("_n is not null")
    longest = falls.groupBy("window").agg(F.max(F.struct("_n", (-F.col("_f._i")).alias("_s"), F.datediff("_l.date", "_f._before").alias("days"))).alias("_b")).select("window", F.col("_b.days").alias("max_drawdown_duration_days"))
    by_month = rows.groupBy("window", "_m").agg((F.sum(F.log1p("ret")) > F.sum(F.log1p("bench"))).cast("int").alias("_won")).groupBy("window").agg(F.avg("_won").alias("monthly_excess_win_rate"))

    growth, excess = F.sum(F.log1p("ret")), F.sum(F.log1p("ret")) - F.sum(F.log1p("bench"))
    root, n = float(year) ** 0.5, F.count("*")
    mean_gain, mean_loss = F.avg(F.when(F.col("_gain") > 0, F.col("_gain"))), F.avg(F.when(F.col("_gain") < 0, F.col("_gain")))
    g = rows.groupBy("window").agg(
        F.min(F.col("_a") + F.col("window") * every).alias("_start"), n.alias("days"), F.count_if(F.col("ret") != 0).alias("active_days"), F.min(F.when(F.col("ret") != 0, F.col("date"))).alias("first_active"), F.min("date").alias("first_date"),
        F.expm1(growth).alias("total_returns"), F.expm1(growth * year / n).alias("annualized_returns"), F.expm1(excess * year / n).alias("excess_annual_returns"), F.max(1 - F.col("_e") / F.greatest(F.lit(1.0), F.col("_peak"))).alias("max_drawdown"),
        F.max(1 - F.col("_x") / F.col("_xpeak")).alias("excess_max_drawdown"), (F.stddev_samp(x) * root).alias("tracking_error"), (R.ratio(F.avg("ret"), F.stddev_samp("ret")) * root).alias("sharpe"),
        (R.ratio(F.avg("ret"), F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), 2)))) * root).alias("sortino"), (R.ratio(F.avg(x), F.stddev_samp(x)) * root).alias("information_ratio"),
        F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), F.when(mean_loss.isNotNull(), R.ratio(F.coalesce(mean_gain, F.lit(0.0)), -mean_loss)).alias("profit_loss_rate"),
    )
    g = g.join(longest, "window", "left").join(by_month, "window").withColumn("max_drawdown_duration_days", F.coalesce("max_drawdown_duration_days", F.lit(0)))
    end = F.col("_start") + months - 1
    return g.withColumn("start_quarter", F.floor(F.col("_start") / 3).cast("int")).withColumn("end_quarter", F.floor(end / 3).cast("int")).withColumn("delay", F.datediff("first_active", "first_date")).drop("_start")


def quarters(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Per quarter (year x 4 + quarter - 1): mean score and mean of `keep` (0 without a value) over the windows that cover it."""
    rows = scored.select("score", *keep, F.explode(F.sequence("start_quarter", "end_quarter")).alias("quarter"))
    return rows.groupBy("quarter").agg(F.avg("score").alias("score"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in keep), F.count("*").alias("windows"))


def composite(by_quarter: DataFrame, keep: list[str], decay: float = 0.03) -> DataFrame:
    """One row: score and `keep`, weighted by exp(-decay x quarters of the series since)."""
    place = F.row_number().over(Window.orderBy(F.desc("quarter"))) - 1  # one row a quarter
    x = by_quarter.withColumn("_w", F.exp(-decay * place))
    return x.agg(*((F.sum(F.col(c) * F.col("_w")) / F.sum("_w")).alias(c) for c in ("score", *keep)), F.count("*").alias("quarters"))


def _steps(x: Column, points: list[tuple[float, float]]) -> Column:
    from quantloom.functions import scalars as S

    return S.piecewise(x, points)


def stability_score(by_quarter: DataFrame) -> DataFrame:
    """One row: 0 to 100 from the coefficient of variation (half), the worst quarter (30 %) and the longest run below 30 (20 %)."""
    runs = diagnostics.longest_run(by_quarter, F.col("score") < 30, "quarter").select("longest")
    g = by_quarter.agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"), F.min("score").alias("worst"), F.count("*").alias("quarters")).crossJoin(F.broadcast(runs))  # one row each
    cv = F.when(F.abs("_m") >= 1e-6, F.col("_s") / F.abs("_m")).otherwise(F.lit(float("inf")))
    parts = (_steps(cv, [(0.1, 100.0), (0.25, 50.0), (0.5, 0.0)]), _steps(F.col("worst"), [(-10.0, 0.0), (25.0, 50.0), (50.0, 100.0)]), _steps(F.col("longest").cast("double"), [(0.0, 100.0), (2.0, 50.0), (5.0, 0.0)]))
    # a coefficient below 0.1 jumps to 100, a worst quarter above 50 as well: the ends of the lines agree with it
    return g.select("quarters", cv.alias("variation"), "worst", "longest", (0.5 * parts[0] + 0.3 * parts[1] + 0.2 * parts[2]).alias("stability"))


def alerts(by_quarter: DataFrame) -> DataFrame:
    """Rows (code, severity) of the risks a series of quarterly scores shows; none below four quarters."""
    h = Window.orderBy("quarter")  # one row a quarter
    x = by_quarter.select("quarter", "score").withColumn("_one", F.lit(1)).withColumn("_i", F.row_number().over(h)).withColumn("_n", F.count("*").over(Window.partitionBy("_one"))).withColumn("_k", F.row_number().over(Window.orderBy(F.desc("score"), "quarter")))
    half, head = F.floor(F.col("_n") / 2), F.least(F.col("_n"), F.greatest(F.lit(3), F.floor(F.col("_n") / 5)))
    runs = diagnostics.longest_run(by_quarter, F.col("score") < 30, "quarter").select("longest")
    g = x.agg(
        F.max("_n").alias("n"), (F.avg(F.when(F.col("_i") <= half, F.col("score"))) - F.avg(F.when(F.col("_i") > half, F.col("score")))).alias("decay"), (F.max("score") - F.median("score")).alias("gap"),
        (F.avg(F.when(F.col("_k") <= head, F.col("score"))) - F.median("score")).alias("head"), F.when(F.abs(F.avg("score")) >= 1e-6, F.stddev_pop("score") / F.abs(F.avg("score"))).otherwise(F.lit(float("inf"))).alias("cv"), F.min("score").alias("worst"),
    ).crossJoin(F.broadcast(runs))  # one row each
    c = F.col
    # The codes and their thresholds.
    level = lambda code, when, high: F.when(when, F.struct(F.lit(code).alias("code"), F.when(high, "high").otherwise("medium").alias("severity")))
    found = F.array_compact(F.array(
        level("performance_decay", c("decay") >= 15, c("decay") >= 25), level("return_concentration", (c("gap") >= 45) | (c("gap") >= 30) & (c("head") >= 20), (c("gap") >= 60) | (c("head") >= 35)),
        level("score_volatility", c("cv") >= 0.55, c("cv") >= 0.8), level("prolonged_slump", c("longest") >= 3, c("longest") >= 5), level("weak_tail", c("worst") <= 10, c("worst") <= 0),
    ))
    return g.where("n >= 4").select(F.inline(found))

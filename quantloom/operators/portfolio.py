"""Costs, calendar returns and drawdowns of return series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def cost_summary(daily: DataFrame, rate: float, year: int = 252, tiny: float = 1e-12) -> DataFrame:
    """One row from `ret` and `turnover` per date at a round-trip `rate`: turnover, yearly drag, share of the return that costs take, net mean, breakeven rate in basis points."""
    g = daily.agg(F.avg("turnover").alias("_t"), F.avg("ret").alias("_g"), F.avg(F.col("ret") - F.col("turnover") * rate).alias("_n"))
    gross, net, turn = F.col("_g"), F.col("_n"), F.col("_t")
    erosion = F.when(F.abs(gross) <= tiny, 0.0).when(gross > 0, 1 - net / gross).otherwise(F.lit(float("inf")))
    breakeven = F.when((turn > tiny) & (gross > 0), gross / turn * 10000).otherwise(0.0)
    return g.select((turn * year).alias("annual_turnover"), turn.alias("mean_turnover"), (turn * rate * year).alias("annual_drag"), erosion.alias("erosion"), net.alias("net_mean"), breakeven.alias("breakeven_bps"))


def summary(daily: DataFrame, year: int = 252) -> DataFrame:
    """One row from `ret`, `drawdown`, `turnover` and `overlap` per date; population deviation."""
    sd = F.stddev_pop("ret")
    return daily.agg(F.avg("ret").alias("mean_return"), F.min("drawdown").alias("max_drawdown"), (sd * float(year) ** 0.5).alias("volatility"), R.ratio(F.avg("ret"), sd).alias("ir"), F.avg("turnover").alias("turnover"), F.avg("overlap").alias("overlap"))


def calendar_returns(daily: DataFrame, ret: str) -> DataFrame:
    """Per year: compounded return of each month (null without rows) and of the year."""
    grown = F.expm1(F.sum(F.log1p(ret)))
    rows = daily.where(F.col(ret).isNotNull()).select(F.year("date").alias("year"), F.month("date").alias("_m"), ret)
    by_month = rows.groupBy("year").pivot("_m", list(range(1, 13))).agg(grown)
    by_month = by_month.select("year", *(F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))
    return by_month.join(rows.groupBy("year").agg(grown.alias("total")), "year")


def drawdown_interval(df: DataFrame, x: str, key: str = "id", order: str = "date") -> DataFrame:
    """Per key: deepest fall of x from its running peak, the first date it was reached and the last date at the peak before."""
    w = R.history(key, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_peak", F.max(x).over(w)).withColumn("_at", F.max(F.when(F.col(x) == F.col("_peak"), F.col(order))).over(w))
    low = F.min(F.struct((F.col(x) / F.col("_peak") - 1).alias("dd"), F.col(order).alias("trough"), F.col("_at").alias("peak")))
    return df.where(F.col(x).isNotNull()).groupBy(key).agg(low.alias("_low")).select(key, F.col("_low.peak").alias("peak_date"), F.col("_low.trough").alias("trough_date"), F.col("_low.dd").alias("drawdown"))


def worst_shortfall(df: DataFrame, ret: str, bench: str, n: int = 20, key: str = "id") -> DataFrame:
    """Per key: largest n-row sum of benchmark less own return, over full windows."""
    behind = df.withColumn("_short", F.col(bench) - F.col(ret)).where(F.col("_short").isNotNull())
    return behind.withColumn("_sum", R.full(F.sum, "_short", n)).groupBy(key).agg(F.max("_sum").alias("shortfall"))


def active_share(weights: DataFrame, bench: DataFrame) -> DataFrame:
    """Per date on which both sides hold something: half the sum of absolute differences of `weight` between (date, id) tables; what one side lacks counts as 0."""
    both = weights.select("date", "id", F.col("weight").alias("_w")).join(bench.select("date", "id", F.col("weight").alias("_b")), ["date", "id"], "full")
    apart = F.sum(F.abs(F.coalesce("_w", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2
    per_date = both.groupBy("date").agg(apart.alias("active_share"), F.count("_w").alias("_nw"), F.count("_b").alias("_nb"))
    return per_date.where("_nw > 0 and _nb > 0").select("date", "active_share")


def activity(weights: DataFrame, target: float = 1.0, tiny: float = 1e-12) -> DataFrame:
    """One row: mean and largest gross exposure, share of days with and without exposure, mean cash below the target exposure. Null weights count as 0."""
    gross = weights.groupBy("date").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)))).alias("_g"))
    on = F.when(F.col("_g") > tiny, 1.0).otherwise(0.0)
    return gross.agg(F.avg("_g").alias("gross_mean"), F.max("_g").alias("gross_max"), F.avg(on).alias("active_days"), F.avg(1 - on).alias("idle_days"), F.avg(F.greatest(target - F.col("_g"), F.lit(0.0))).alias("mean_cash"))


def up_down(daily: DataFrame, ret: str, fold: str) -> DataFrame:
    """One row: number, mean and sum of rising and of other periods (0 without any), and how many folds have a positive mean. Null returns are left out."""
    rows = daily.where(F.col(ret).isNotNull())
    up, down = F.when(F.col(ret) > 0, F.col(ret)), F.when(F.col(ret) <= 0, F.col(ret))
    parts = rows.groupBy(fold).agg(F.avg(ret).alias("_m"), *(f(c).alias(f"_{side}{name}") for side, c in (("up", up), ("down", down)) for name, f in (("n", F.count), ("t", F.sum))))
    out = parts.agg(
        *(F.sum(f"_{s}n").alias(f"{s}_periods") for s in ("up", "down")), *(F.coalesce(F.sum(f"_{s}t"), F.lit(0.0)).alias(f"{s}_total") for s in ("up", "down")),
        F.sum(F.when(F.col("_m") > 0, 1).otherwise(0)).alias("positive_folds"), F.count("*").alias("folds"),
    )
    return out.select("*", *(F.coalesce(R.ratio(F.col(f"{s}_total"), F.col(f"{s}_periods")), F.lit(0.0)).alias(f"{s}_mean") for s in ("up", "down")))


def drawdown_duration(daily: DataFrame, ret: str, order: str = "date") -> DataFrame:
    """One row: the largest number of consecutive days on which the compounded return stays below its peak so far (0 at the start)."""
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    x = daily.where(F.col(ret).isNotNull()).withColumn("_e", F.sum(F.log1p(ret)).over(run))
    x = x.withColumn("_peak", F.max(F.greatest("_e", F.lit(0.0))).over(run))
    x = x.withColumn("_top", F.count_if(F.col("_e") >= F.col("_peak")).over(run))
    return x.groupBy("_top").agg(F.count_if(F.col("_e") < F.col("_peak")).alias("_n")).agg(F.max("_n").alias("days"))

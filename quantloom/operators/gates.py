"""Universe filters, sanitising, calibration, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import scalars as S
from quantloom.functions.order import quantiles
from quantloom.sources.shared import written


def without_flagged(panel: DataFrame, flags: DataFrame, flag: str) -> DataFrame:
    """Rows whose latest flag as of the date is not set; without any flag so far they stay. Columns of flags: id, date, `flag`."""
    x = R.asof(panel, flags.withColumnRenamed("date", "_at"), ["id"], "date", "_at", [flag])
    return x.where(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def above_quantile(snapshot: DataFrame, x: str, q: float) -> DataFrame:
    """Rows of a snapshot at or above the q-quantile of x; unknown x goes."""
    floor = quantiles(snapshot, x, [q]).select(F.get("quantiles", F.lit(0)).alias("_floor"))
    return snapshot.crossJoin(F.broadcast(floor)).where(F.col(x) >= F.col("_floor")).drop("_floor")  # one row


def rescaled(df: DataFrame, columns: list[str], lo: float = -1000.0, hi: float = 10000.0) -> DataFrame:
    """Percent-like columns clipped to [lo, hi], then divided by 10000 if the median size of the column exceeds 100, by 100 if it exceeds 1."""
    x = df
    for c in columns:  # one row each
        x = x.crossJoin(F.broadcast(quantiles(df.select(F.abs(c).alias(c)), c, [0.5]).select(F.get("quantiles", F.lit(0)).alias(f"_m_{c}"))))
    scale = lambda c: F.when(F.col(f"_m_{c}") > 100, 10000.0).when(F.col(f"_m_{c}") > 1, 100.0).otherwise(1.0)
    return x.withColumns({c: R.clip(F.col(c), lo, hi) / scale(c) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def sane_weights(df: DataFrame, by: str = "date", key: str = "id") -> DataFrame:
    """Positive finite weights of named rows, scaled to 1 on each date."""
    w = F.col("weight")
    x = df.where(F.col(key).isNotNull() & (w > 0) & ~F.isnan(w) & (w < float("inf")))
    return x.withColumn("weight", w / F.sum("weight").over(Window.partitionBy(by)))


def calibrator(df: DataFrame, score: str, label: str, buckets: int = 5) -> DataFrame:
    """Per bucket between global quantiles of the score: edges, rows and share of positive labels; every bucket is there, an empty one with the overall share."""
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    x = written(x.select(F.col(score).cast("double").alias(score), (F.col(label) > 0).cast("int").alias("_up")), "scores")  # read several times
    marks = quantiles(x, score, [i / buckets for i in range(1, buckets)]).withColumnRenamed("quantiles", "_e")
    edges = marks.crossJoin(F.broadcast(x.agg(F.avg("_up").alias("_all"))))  # one row each
    edges = written(edges, "edges")
    y = x.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter("_e", lambda e: e < F.col(score))) + 1)  # one row
    g = y.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("_up").alias("_h"))
    grid = edges.select("_e", "_all", F.explode(F.sequence(F.lit(1), F.lit(buckets))).alias("bucket"))
    return grid.join(g, "bucket", "left").select("bucket", F.get("_e", F.col("bucket") - 2).alias("lower"), F.get("_e", F.col("bucket") - 1).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_h", "_all").alias("hit_rate"))


def gate(metrics: DataFrame, rules: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """One row per rule (metric, sense, limit, hard): its value, whether it passes and whether all hard ones do. `sense` is ">=" or "<="; a missing value fails."""
    table = metrics.sparkSession.createDataFrame([(m, s, float(v), h) for m, (s, v, h) in rules.items()], "metric string, sense string, limit double, hard boolean")
    x = table.join(metrics, "metric", "left")
    ok = F.coalesce(F.when(F.col("sense") == ">=", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")), F.lit(False))
    x = x.withColumn("passes", ok).withColumn("_one", F.lit(1))
    return x.withColumn("promoted", F.bool_and(F.col("passes") | ~F.col("hard")).over(Window.partitionBy("_one"))).drop("_one")  # one row a rule


def deltas(metrics: DataFrame, variant: str, baseline: str, columns: list[str]) -> DataFrame:
    """Per variant: each metric less the baseline variant's."""
    base = metrics.where(F.col(variant) == baseline).agg(*(F.max(c).alias(f"_b_{c}") for c in columns))
    return metrics.crossJoin(F.broadcast(base)).select(variant, *((F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in columns))  # one row


def stressed(daily: DataFrame, periods: dict[str, tuple[str, str]], ret: str = "ret") -> DataFrame:
    """Per named period that the series covers from end to end: days and compounded return."""
    table = daily.sparkSession.createDataFrame([(n, a, b) for n, (a, b) in periods.items()], "period string, _a string, _b string").select("period", F.to_date("_a").alias("_a"), F.to_date("_b").alias("_b"))
    ends = daily.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    whole = table.crossJoin(F.broadcast(ends)).where("_lo <= _a and _hi >= _b")  # a few rows, one row
    days = whole.select("period", F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.join(daily, "date").groupBy("period").agg(F.count(ret).alias("days"), F.expm1(F.sum(F.log1p(ret))).alias("total"))


def profit_loss(daily: DataFrame, ret: str = "ret") -> DataFrame:
    """One row: mean gain of rising days over mean loss of falling days, total and mean turnover."""
    up, down = F.when(F.col(ret) > 0, F.col(ret)), F.when(F.col(ret) < 0, -F.col(ret))
    return daily.agg(R.ratio(F.avg(up), F.avg(down)).alias("profit_loss"), F.sum("turnover").alias("turnover"), F.avg("turnover").alias("mean_turnover"), F.count("*").alias("days"))


def environments(quarters: DataFrame, score: str, bench: str, up: float = 0.08, down: float = -0.08) -> DataFrame:
    """Per environment of the benchmark's quarter (bull above `up`, bear below `down`, else flat): quarters and mean score."""
    kind = F.when(F.col(bench) > up, "bull").when(F.col(bench) < down, "bear").otherwise("flat")
    return quarters.where(F.col(bench).isNotNull()).groupBy(kind.alias("environment")).agg(F.count("*").alias("quarters"), F.avg(score).alias("score"))


def dominant_adjusted(bars: DataFrame, mode: str = "ratio") -> DataFrame:
    """A continuous series from the contract in force each day (`id`, `date`, `contract`, `close`, `prev_close` of the same contract): what the roll changes is taken out, by factor or by difference, of all before it; the last contract stays as it is."""
    h = R.history()
    x = bars.withColumn("_was", F.lag("close").over(h)).withColumn("_roll", F.coalesce(F.lag("contract").over(h) != F.col("contract"), F.lit(False)))
    later = R.history().rowsBetween(1, Window.unboundedFollowing)
    if mode == "ratio":
        step = F.ln(F.when(F.col("_roll"), R.ratio(F.col("prev_close"), F.col("_was"))).otherwise(1.0))
        return x.select("id", "date", (F.col("close") * F.exp(F.coalesce(F.sum(step).over(later), F.lit(0.0)))).alias("adjusted"))
    step = F.when(F.col("_roll"), F.col("prev_close") - F.col("_was")).otherwise(0.0)
    return x.select("id", "date", (F.col("close") + F.coalesce(F.sum(step).over(later), F.lit(0.0))).alias("adjusted"))


def grown(df: DataFrame, x: str, lags: int = 4, key: str = "id", order: str = "quarter") -> DataFrame:
    """Add `growth`: change of x over `lags` quarters by the size of the base; null without a base or at 0."""
    was = F.lag(x, lags).over(R.history(key, order))
    return df.withColumn("growth", R.ratio(F.col(x) - was, F.abs(was)))


def hot_signals(df: DataFrame, percentiles: list[str], hot: float = 0.9) -> DataFrame:
    """Add `hot`: how many percentiles are at `hot` or above; missing ones count as cool."""
    return df.withColumn("hot", sum((F.coalesce((F.col(c) >= hot).cast("int"), F.lit(0)) for c in percentiles), F.lit(0)))


def curve_weight(percentile: Column, anchors: list[tuple[float, float]]) -> Column:
    """Target weight on a piecewise-linear curve of a valuation percentile."""
    return S.piecewise(percentile, anchors)


def shaped(df: DataFrame, score: str, least: float, multipliers: dict[str, float], group: str) -> DataFrame:
    """Add `shaped`: (score - least), 0 below, x confidence x group multiplier / (1 + risk)."""
    m = F.coalesce(F.create_map(*(x for k, v in multipliers.items() for x in (F.lit(k), F.lit(v))))[F.col(group)], F.lit(1.0))
    return df.withColumn("shaped", F.greatest(F.col(score) - least, F.lit(0.0)) * F.coalesce("confidence", F.lit(1.0)) * m / (1 + F.greatest(F.coalesce("risk", F.lit(0.0)), F.lit(0.0))))


def stopped_out(positions: DataFrame, limit: float = 0.08) -> DataFrame:
    """Positions whose unrealised return is at or below -limit."""
    loss = R.ratio(F.col("price"), F.col("cost")) - 1
    return positions.withColumn("unrealised", loss).where(F.col("unrealised") <= -limit)


def runtime_gates(days: DataFrame, least: int = 300, share: float = 0.8, delay: int = 1, model: tuple[int, int] = (20, 60), evidence: tuple[int, int] = (20, 60)) -> DataFrame:
    """Per trade date the reasons not to publish, the warnings, and whether it passes.

    Columns: date, eligible, history (median of the eligible names of the dates
    before), missing (required values missing), gap (trading days that the
    request is ahead of the data), data_end, label_end, evidence_end. Coverage
    must reach `least` names and `share` of the history; labels and evidence
    warn and stop after so many days, a missing date of theirs is no objection."""
    c = F.col
    age = lambda end: F.datediff("date", end)
    floor = F.greatest(F.lit(least), F.coalesce(F.floor(c("history") * share).cast("int"), F.lit(least)))
    stale = {name: (age(f"{name}_end"), *limits) for name, limits in (("label", model), ("evidence", evidence))}
    reasons = F.array_compact(F.array(
        F.when(c("gap") > delay, "request_ahead_of_data"), F.when(age("data_end") > delay, "data_stale"), F.when(c("missing"), "missing_values"), F.when(c("eligible") < floor, "coverage_below_threshold"),
        *(F.when(days_old > stop, f"{name}_stale") for name, (days_old, _, stop) in stale.items()),
    ))
    warnings = F.array_compact(F.array(F.when(c("gap") > delay, "request_ahead_of_data"), *(F.when((days_old > warn) & (days_old <= stop), f"{name}_aging") for name, (days_old, warn, stop) in stale.items())))
    return days.select("date", "eligible", floor.alias("threshold"), F.array_join(reasons, ",").alias("reasons"), F.array_join(warnings, ",").alias("warnings"), (F.size(reasons) == 0).alias("passed"))


def score_gates(scores: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """Per date: deviation of the scores and lead of their 95th percentile over the median, against the low ends of both in the reference (std_p01, lead_p05, one row); without scores it does not pass."""
    q = F.percentile(score, F.array(F.lit(0.5), F.lit(0.95)))
    g = scores.groupBy("date").agg(F.stddev_pop(score).alias("std"), q.alias("_q")).withColumn("lead", F.col("_q")[1] - F.col("_q")[0])
    x = g.crossJoin(F.broadcast(reference.select("std_p01", "lead_p05")))  # one row
    reasons = F.when(F.col("std").isNull(), F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(F.when(F.col("std") <= F.col("std_p01"), "std_below_p01"), F.when(F.col("lead") <= F.col("lead_p05"), "spread_below_p05"))))
    return x.select("date", "std", "lead", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))

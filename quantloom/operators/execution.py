"""Target weights made executable against what is held: buffers, gates, locks, capacity and turnover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.construction import allocated, group_capped, unclassified
from quantloom.sources.shared import written


@dataclass(frozen=True)
class Rules:
    """Limits of a rebalance; None switches one off."""

    gross: float = 1.0
    max_weight: float | None = None
    max_industry: float | None = None
    min_weight: float = 0.0
    buffer: float = 0.0
    alpha: float | None = None
    lock: bool = False
    participation: float | None = None
    value: float | None = None
    min_trade: float = 0.0
    max_turnover: float | None = None


def _normalised(day: DataFrame, rules: Rules, gross: Column) -> DataFrame:
    """Positive weights scaled to the gross weight of their date under the caps of names and industries; dates without any are left out."""
    grouped = rules.max_industry is not None and "industry" in day.columns
    x = day.withColumn("_whole", unclassified("industry", ["date"])) if grouped else day
    x = x.withColumn("_gross", gross).where("_gross > 0").withColumn("_pos", F.sum(F.greatest("weight", F.lit(0.0))).over(Window.partitionBy("date"))).where("_pos > 0")
    if rules.max_weight is None:
        x = x.withColumn("weight", F.greatest("weight", F.lit(0.0)) / F.col("_pos") * F.col("_gross")).where("weight > 1e-15")
    else:
        x = allocated(x, "weight", rules.max_weight, F.col("_gross"))
    if grouped:  # the budget of a date's groups is the sum of its weights, which is at most the gross weight
        x = group_capped(x, "industry", rules.max_industry, float("inf"), skip="_whole")
    return x.drop("_gross", "_pos", "_whole")


def _limited(x: DataFrame, rules: Rules) -> DataFrame:
    """What was bought today is not sold, no trade exceeds the share of liquidity that may be taken, and none is below the least value."""
    held, target = F.col("held"), F.col("weight")
    if rules.lock:
        target = F.when(target < held, F.greatest(target, F.greatest(F.col("locked"), F.lit(0.0)))).otherwise(target)
    move = target - held
    if rules.participation and rules.value:
        most = F.greatest(F.col("liquidity"), F.lit(0.0)) * rules.participation
        capped = F.when(F.col("liquidity").isNull() | (F.abs(move) * rules.value <= most + 1e-12), move).otherwise(F.signum(move) * most / rules.value)
        target, move = held + capped, capped
    if rules.min_trade > 0 and rules.value is not None:
        target = F.when(F.abs(move) * rules.value < rules.min_trade, held).otherwise(target)
    return x.withColumn("weight", target)


def _within_turnover(x: DataFrame, rules: Rules, priority: Column) -> DataFrame:
    """Where a date's turnover exceeds its limit, purchases and sales each get the limit, by priority, then id: what is left after those before decides, so running sums replace the queue."""
    if rules.max_turnover is None:
        return x
    x = x.withColumn("_d", F.col("weight") - F.col("held")).withColumn("_side", F.signum("_d")).withColumn("_p", priority)
    before = Window.partitionBy("date", "_side").orderBy(F.desc("_p"), "id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0.0), rules.max_turnover - F.coalesce(F.sum(F.abs("_d")).over(before), F.lit(0.0)))
    turnover = F.sum(F.abs("_d")).over(Window.partitionBy("date")) / 2
    x = x.withColumn("_left", left).withColumn("_t", turnover - 1e-12)
    moved = F.when(F.col("_t") <= rules.max_turnover, F.col("_d")).otherwise(F.col("_side") * F.least(F.abs("_d"), F.col("_left")))
    return x.withColumn("weight", F.when(F.col("_t") <= rules.max_turnover, F.col("weight")).otherwise(F.col("held") + moved)).drop("_d", "_side", "_p", "_left", "_t")


def executable(targets: DataFrame, current: DataFrame | None, rules: Rules) -> DataFrame:
    """date, id, weight (and industry): targets brought to what can be traded from the weights held on each date.

    Columns of targets: date, id, weight, and industry, alpha, liquidity where
    rules need them; of current: date, id, weight, and locked, what was bought
    today. In order: targets of a name are summed, small ones dropped, all scaled
    under the caps; then small changes stay, purchases need alpha (a missing one
    blocks), locks, capacity and the least trade hold, turnover goes to the
    largest change times alpha; what is left is scaled again, never up, and locks,
    capacity, least trade and turnover hold once more. Without `current` the
    first scaling is all. Dates are independent, a name's row meets its holding
    by one join."""
    more = [c for c in ("industry", "alpha", "liquidity") if c in targets.columns]
    day = targets.dropna(subset=["date", "id", "weight"]).groupBy("date", "id").agg(F.sum("weight").alias("weight"), *(F.max(c).alias(c) for c in more))
    if rules.min_weight > 0:
        day = day.where(F.abs("weight") >= rules.min_weight)
    scaled = _normalised(day, rules, F.lit(float(rules.gross)))
    out = ["date", "id", "weight", *(c for c in more if c == "industry")]
    if current is None:
        return scaled.select(*out)
    scaled = written(scaled.select("date", "id", "weight", *more), "scaled")  # read three times below
    locked = F.coalesce("locked", F.lit(0.0)) if "locked" in current.columns else F.lit(0.0)
    own = current.groupBy("date", "id").agg(F.sum("weight").alias("held"), F.max(locked).alias("locked"))
    if rules.lock:  # a day without positive targets trades only if something is locked
        shut = own.groupBy("date").agg(F.max("locked").alias("_l")).where("_l > 0").select("date")
        empty = day.join(scaled.select("date").distinct(), "date", "left_anti").join(shut, "date", "left_semi")
        scaled = scaled.unionByName(empty)
    held = own.join(scaled.select("date").distinct(), "date", "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    x = scaled.join(held, ["date", "id"], "full").select("date", "id", zero("weight"), zero("held"), zero("locked"), *more)
    move = F.col("weight") - F.col("held")
    stay = F.abs(move) < rules.buffer
    if rules.alpha:
        alpha = F.col("alpha") if "alpha" in more else F.lit(None).cast("double")
        stay = stay | (move > 0) & F.coalesce(alpha < rules.alpha, F.lit(True))
    x = _limited(x.withColumn("weight", F.when(stay, F.col("held")).otherwise(F.col("weight"))), rules)
    size = F.abs(F.col("weight") - F.col("held"))
    x = _within_turnover(x, rules, size * F.abs(F.coalesce("alpha", F.lit(0.0))) if "alpha" in more else size)
    gross = F.least(F.lit(float(rules.gross)), F.sum(F.greatest("weight", F.lit(0.0))).over(Window.partitionBy("date")))
    x = written(x.withColumn("_most", gross), "limited")  # and this one twice
    kept = x.drop("weight", "_most")
    again = _normalised(x.select("date", "id", "weight", "_most", *(c for c in more if c == "industry")), rules, F.col("_most")).select("date", "id", "weight")
    x = _limited(kept.join(again, ["date", "id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))), rules).where("weight > 0")
    x = _within_turnover(x, rules, F.lit(0.0) if "alpha" in more else F.abs(F.col("weight") - F.col("held")))
    return x.where("weight > 0").select(*out)

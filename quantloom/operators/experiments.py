"""Experiments compared over their folds: stability, signs of overfitting, the decision to merge and the judgement under guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import rolling as R

# Limits of the guardrails; what counts as decay from validation to test.
GUARDRAILS = {"max_drawdown": 0.12, "turnover": 0.20, "stability": 50.0, "cv": 0.60, "positive": 0.70}
DECAY = {"ic": 0.02, "spread": 0.005, "wins": 0.8}
INF = float("inf")


def _folds_of(metric: str) -> list[Column]:
    """Aggregates over the folds of one experiment that `_stability` reads: moments, median and the folds in order."""
    x = F.col(metric)
    listed = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("fold", x.alias("x")))))
    return [f.alias(f"_{metric}_{n}") for n, f in {"m": F.avg(x), "s": F.stddev_pop(x), "w": F.min(x), "d": F.median(x), "n": F.count(x), "x": listed}.items()]


def _stability(metric: str, name: str) -> list[Column]:
    """Columns `name`, its variation and its worst fold from the aggregates of `_folds_of`."""
    m, s, w, d, n, listed = (F.col(f"_{metric}_{c}") for c in "mswdnx")
    ramp = lambda v: R.clip((0.5 - v) / 0.4 * 100, 0.0, 100.0)
    step = lambda a, f: F.struct(F.when(f["x"] < d, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["long"], F.when(f["x"] < d, a["run"] + 1).otherwise(0)).alias("long"))
    longest = F.aggregate(listed, F.struct(F.lit(0).alias("run"), F.lit(0).alias("long")), step)["long"]
    cv = F.when(F.abs(m) > 1e-12, s / F.abs(m)).otherwise(F.lit(INF))
    worst = F.when(d == 0, 50.0).otherwise(R.clip(R.ratio(w, d) / 0.8 * 100, 0.0, 100.0))
    run = F.when(n <= 1, 100.0).otherwise(ramp(longest / n))
    return [(0.5 * ramp(F.least(cv, F.lit(1e6))) + 0.3 * worst + 0.2 * run).alias(name), cv.alias(f"{name}_cv"), w.alias(f"{name}_worst")]


def stability(folds: DataFrame, metric: str, name: str, key: str = "experiment") -> DataFrame:
    """Per experiment 0 to 100: variation over folds (half), worst against median fold (30 %), longest run below the median (20 %); columns `name`, and its variation and worst fold. One aggregate; an experiment's folds are a few values."""
    return folds.groupBy(key).agg(*_folds_of(metric)).where(F.col(f"_{metric}_n") > 0).select(key, *_stability(metric, name))


def summaries(folds: DataFrame, key: str = "experiment") -> DataFrame:
    """One row per experiment from its folds (ic, spread, val_ic, val_spread, gross, net, max_drawdown, turnover): means, stability of information and of net return, share of positive folds, decays from validation to test and their flags. All of it is one aggregate."""
    c = F.col
    won = (c("val_ic") + c("val_spread") > c("ic") + c("spread")).cast("int")
    means = ("ic", "spread", "gross", "net", "turnover")
    g = folds.where(c(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("folds"), *(F.avg(x).alias(x) for x in means), F.max("max_drawdown").alias("max_drawdown"), F.avg((c("ic") > 0).cast("int")).alias("positive"),
        F.avg(c("val_ic") - c("ic")).alias("ic_decay"), F.avg(c("val_spread") - c("spread")).alias("spread_decay"), F.avg(won).alias("val_wins"), *_folds_of("ic"), *_folds_of("net"),
    )
    flags = [(c("ic_decay") > DECAY["ic"]).alias("flag_ic"), (c("spread_decay") > DECAY["spread"]).alias("flag_spread"), (c("val_wins") > DECAY["wins"]).alias("flag_val")]
    own = (key, "folds", *means, "max_drawdown", "positive", "ic_decay", "spread_decay", "val_wins")
    return g.where("_ic_n > 0 and _net_n > 0").select(*own, *flags, *_stability("ic", "stability"), *_stability("net", "net_stability"))


def _beside(summary: DataFrame, baseline: str, key: str) -> DataFrame:
    base = summary.where(F.col(key) == baseline).select(*(F.col(c).alias(f"b_{c}") for c in summary.columns if c != key))
    return summary.where(F.col(key) != baseline).crossJoin(F.broadcast(base))  # one row


def compared(folds: DataFrame, baseline: str, key: str = "experiment") -> DataFrame:
    """Per candidate against the baseline: differences by fold and in all, and the decision: REJECT where net return does not beat it, HOLD with reasons where gains lie in few folds, overfitting or instability grew, else MERGE."""
    c = F.col
    b = folds.where(c(key) == baseline).select("fold", c("ic").alias("_ic"), c("net").alias("_net"))
    x = folds.where(c(key) != baseline).join(b, "fold").withColumn("_d", F.round(c("net") - c("_net"), 12)).withColumn("_i0", F.round(c("ic") - c("_ic"), 12))  # equal folds differ by rounding alone
    x = x.withColumn("_up", F.when(c("_d") > 0, c("_d")))
    best = F.aggregate(F.slice(F.sort_array(F.collect_list("_up"), asc=False), 1, 2), F.lit(0.0), lambda a, b: a + b)
    by = x.groupBy(key).agg(
        F.count("*").alias("aligned"), F.avg(c("ic") - c("_ic")).alias("ic_delta"), F.count_if(c("_i0") > 0).alias("ic_wins"), F.avg("_d").alias("net_delta"), F.count_if(c("_d") > 0).alias("net_wins"), F.sum("_d").alias("_t"),
        F.coalesce(R.ratio(best, F.sum("_up")), F.lit(0.0)).alias("top2_share"),
    )
    few = (c("_t") > 0) & ((c("net_wins") / c("aligned") < 0.4) | (c("net_wins") <= 2) & (c("aligned") >= 5) | (c("top2_share") >= 0.65))
    y = _beside(summaries(folds, key), baseline, key).join(by, key).withColumn("_few", few)
    more = lambda n, by: c(n) > c(f"b_{n}") + by
    overfit = more("ic_decay", 0.01) | more("spread_decay", 0.003) | more("val_wins", 0.15)
    for flag in ("flag_ic", "flag_spread", "flag_val"):
        overfit = overfit | c(flag) & ~c(f"b_{flag}")
    worse = (c("stability") - c("b_stability") < -5) | (c("net_stability") - c("b_net_stability") < -5) | (c("positive") - c("b_positive") < -0.15)
    lost = F.round(c("net") - c("b_net"), 12) <= 0
    reasons = F.array_compact(F.array(F.when(lost, "cost_not_hold"), F.when(c("_few"), "few_window_uplift"), F.when(overfit, "overfit_warning"), F.when(worse, "stability_regression")))
    status = F.when(lost, "REJECT").when(F.size(reasons) > 0, "HOLD").otherwise("MERGE")
    return y.select(key, "aligned", "ic_delta", "ic_wins", "net_delta", "net_wins", "top2_share", (c("stability") - c("b_stability")).alias("stability_delta"), (c("net_stability") - c("b_net_stability")).alias("net_stability_delta"), F.array_join(reasons, ",").alias("reasons"), status.alias("status"))


def calmar(net: Column, drawdown: Column) -> Column:
    return F.when(drawdown > 0, net * 252 / drawdown).otherwise(0.0)


def judged(summary: DataFrame, baseline: str, best: str | None = None, smoke: bool = False, key: str = "experiment") -> DataFrame:
    """Per candidate: discard with the guardrails it fails, keep, or champion if it also beats the best so far; better is more net return and Calmar ratio at a stability at most 5 lower. Guardrails give way where the baseline itself is near them."""
    c = F.col
    x = _beside(summary, baseline, key)
    top = summary.where(c(key) == (best or baseline)).select(*(c(n).alias(f"t_{n}") for n in ("net", "max_drawdown", "stability")))
    x = x.crossJoin(F.broadcast(top))  # one row
    g = GUARDRAILS
    least_stable = F.least(F.lit(g["stability"]), F.greatest(F.lit(10.0), c("b_stability") * 0.85))
    least_positive = F.greatest(F.least(F.lit(g["positive"]), c("b_positive")), c("b_positive") - 0.1)
    failed = F.array_compact(F.array(
        F.when(c("max_drawdown") > g["max_drawdown"], "max_drawdown"), F.when(c("turnover") > g["turnover"], "mean_turnover"), F.when(c("stability") < least_stable, "stability_score"),
        F.when(c("stability_cv") > F.greatest(F.lit(g["cv"]), c("b_stability_cv") + 0.15), "cv"), F.when(c("positive") < least_positive, "positive_ratio"), F.when(c("flag_ic"), "flag_ic_decay"), F.when(c("flag_spread"), "flag_spread_decay"), F.when(c("flag_val"), "flag_val_dominant"),
    ))
    own = calmar(c("net"), c("max_drawdown"))
    better = lambda s: (c("net") > c(f"{s}_net")) & (own > calmar(c(f"{s}_net"), c(f"{s}_max_drawdown"))) & (c("stability") - c(f"{s}_stability") >= -5)
    status = F.when(F.size(failed) > 0, "discard").when(F.lit(smoke), "keep").when(better("b") & better("t"), "champion").when(better("b"), "keep").otherwise("discard")
    why = F.when(F.size(failed) > 0, "guardrail_failed").when(F.lit(smoke), "smoke_pass").when(better("b") & better("t"), "full_improved").when(better("b"), "full_pass_not_best").otherwise("no_material_improvement")
    return x.select(key, status.alias("status"), why.alias("reason"), F.array_join(failed, ",").alias("failed"), (c("net") - c("b_net")).alias("net_delta"), (own - calmar(c("b_net"), c("b_max_drawdown"))).alias("calmar_delta"))

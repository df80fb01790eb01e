"""Features judged by folds: metrics, classes, scorecards, the audit before a search, and their terms with the market's state."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions import rolling as R

METRICS = ("coverage", "std", "rank_ic", "spread", "hit_rate", "monotonicity")


def fold_metrics(panel: DataFrame, features: list[str], label: str, fold: str = "fold", top: int = 10, groups: int = 5) -> DataFrame:
    """Per fold and feature: rows, valid rows, coverage, mean deviation over a date's names, mean rank information, spread of the `top` best less the worst (at most half a date's names each), hit rate of the best, and monotonicity: the rank correlation of group and mean label over `groups` equal parts of each date.

    One shuffle by fold and date; a task holds the features of one date's names
    and gives a row a feature. Dates with fewer than two valid names count for
    coverage only. Ties in a feature are cut by id."""

    def one(t: pa.Table) -> pa.Table:
        y, ids = t.column("y").to_numpy(zero_copy_only=False), t.column("id").to_numpy(zero_copy_only=False)
        named, rows = np.argsort(ids, kind="stable"), []
        for c in features:
            x = t.column(c).to_numpy(zero_copy_only=False)[named]  # null comes as NaN
            ok = ~np.isnan(x) & ~np.isnan(y[named])
            u, v = x[ok], y[named][ok]
            n = len(u)
            if n < 2:
                rows.append((c, t.num_rows, n, None, None, None, None, []))
                continue
            v = v[order := np.argsort(-u, kind="stable")]  # largest first, ties by id
            u = u[order]
            k, g = min(top, n // 2), min(groups, n)
            bounds = [n * p // g for p in range(g + 1)]
            rows.append((c, t.num_rows, n, float(u.std()), R.correlation_of(R.average_ranks(u), R.average_ranks(v)), float(v[:k].mean() - v[n - k :].mean()), float((v[:k] > 0).mean()), [float(v[i:j].mean()) for i, j in zip(bounds, bounds[1:], strict=False)]))
        names = ("feature", "rows", "valid", *METRICS[1:5], "parts")
        types = (pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.list_(pa.float64()))
        own = pa.array([t.column("fold")[0].as_py()] * len(rows), t.schema.field("fold").type)
        return pa.table({"fold": own, **{name: pa.array(col, kind) for name, col, kind in zip(names, zip(*rows, strict=True), types, strict=True)}})

    x = panel.select(F.col(fold).alias("fold"), "date", "id", F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in features))
    daily = x.groupBy("fold", "date").applyInArrow(one, f"fold {x.schema['fold'].dataType.simpleString()}, feature string, rows long, valid long, {', '.join(f'{c} double' for c in METRICS[1:5])}, parts array<double>")
    part = [F.struct(F.lit(-float(i)).alias("p"), F.avg(F.get("parts", F.lit(i))).alias("m")) for i in range(groups)]
    out = daily.groupBy("fold", "feature").agg(F.sum("rows").alias("rows"), F.sum("valid").alias("valid"), *(F.avg(c).alias(c) for c in METRICS[1:5]), F.count("rank_ic").alias("dates"), F.array(*part).alias("_parts"))
    # a row a fold, feature and part
    both = ["fold", "feature"]
    out = out.select("*", F.inline("_parts")).withColumn("_r", R.average_rank("m", both)).withColumn("_p", F.when(F.col("m").isNotNull(), F.col("p")))
    out = out.groupBy(*both).agg(*(F.first(c).alias(c) for c in ("rows", "valid", *METRICS[1:5], "dates")), F.when(F.count("m") >= 3, R.correlation("_p", "_r")).alias("monotonicity"))
    return out.select("fold", "feature", "rows", "valid", R.ratio(F.col("valid"), F.col("rows")).alias("coverage"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in METRICS[1:]), F.coalesce("dates", F.lit(0)).alias("dates"))


def summary(folds: DataFrame) -> DataFrame:
    """Per feature over its folds: coverage and deviation weighted by rows, means of the others, and deviation, variation, worst, positive share and number of the folds' rank information."""
    ic = F.col("rank_ic")
    g = folds.groupBy("feature").agg(
        F.coalesce(R.ratio(F.sum("valid"), F.sum("rows")), F.lit(0.0)).alias("coverage"), F.coalesce(R.ratio(F.sum(F.col("std") * F.col("valid")), F.sum("valid")), F.lit(0.0)).alias("std"), *(F.avg(c).alias(c) for c in METRICS[2:]),
        F.stddev_pop(ic).alias("ic_std"), F.min(ic).alias("worst"), F.avg((ic > 0).cast("int")).alias("positive"), F.count("*").alias("folds"), F.stddev_samp(ic).alias("_s"),
    )
    t = F.when(F.col("folds") < 2, 0.0).when(F.col("_s") > 0, F.col("rank_ic") / (F.col("_s") / F.sqrt("folds"))).when(F.col("rank_ic") == 0, 0.0).otherwise(F.signum("rank_ic") * float("inf"))
    return g.withColumn("variation", F.when(F.abs("rank_ic") > 1e-12, F.col("ic_std") / F.abs("rank_ic")).otherwise(0.0)).withColumn("t_stat", t).drop("_s")


def _reasons(representative: Column, **named: Column) -> Column:
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in named.items()), F.when(F.col("feature") != representative, F.lit("redundant"))))


def reviewed(summaries: DataFrame, groups: DataFrame, importance: DataFrame | None = None, coverage: float = 0.5, flat: float = 0.01, negative: float = 0.0) -> DataFrame:
    """Features with reasons, a class (keep, review, drop_candidate) and the scores that add up to `factor_score`.

    `groups` (feature, representative) holds those that resemble each other;
    `importance` (feature, importance) is what a model made of them."""
    x = summaries.join(groups.select("feature", "representative"), "feature", "left")
    if importance is not None:
        x = x.join(importance.select("feature", "importance"), "feature", "left")
    used = F.coalesce("importance", F.lit(0.0)) if importance is not None else F.lit(0.0)
    lead = F.coalesce("representative", "feature")
    x = x.withColumn("reasons", _reasons(lead, low_coverage=F.col("coverage") < coverage, low_variance=(F.col("coverage") >= coverage) & (F.col("std") <= flat), negative_rank_ic=F.col("rank_ic") <= negative))
    has = lambda r: F.array_contains("reasons", r)
    drop = has("low_variance") | has("negative_rank_ic") | has("redundant")
    x = x.withColumn("decision", F.when(drop, "drop_candidate").when(F.size("reasons") > 0, "review").otherwise("keep"))
    unit = R.clip(F.col("spread") * 100, -1.0, 1.0)
    signal = F.col("rank_ic") + 0.2 * unit + 0.1 * F.col("monotonicity")
    stable = F.col("positive") - F.least(F.abs("variation"), F.lit(2.0)) * 0.1
    quality = F.when(has("low_coverage"), 0.25).otherwise(0.0) + F.when(has("low_variance"), 0.35).otherwise(0.0) + F.when(has("negative_rank_ic"), 0.2).otherwise(0.0)
    twin = F.when(has("redundant"), 0.35).otherwise(0.0)
    return x.select(
        "feature", "coverage", "rank_ic", F.array_join("reasons", ",").alias("reasons"), "decision", signal.alias("signal_score"), stable.alias("stability_score"), twin.alias("redundancy_penalty"), quality.alias("quality_penalty"),
        (signal + 0.25 * stable + 0.1 * used - twin - quality).alias("factor_score"),
    )


def audited(summaries: DataFrame, groups: DataFrame, coverage: float = 0.5, flat: float = 0.01, negative: float = -0.02, positive: float = 0.5) -> DataFrame:
    """Before a search: hard_exclude with reasons, watch where the folds' information is weak (p above 0.2 and fewer than 67 % positive), else keep_candidate; p by the normal law."""
    from quantloom.operators.significance import normal_p

    x = summaries.join(groups.select("feature", "representative"), "feature", "left").withColumn("p_value", F.when(F.col("folds") < 2, 1.0).when(F.abs("t_stat") == float("inf"), 0.0).otherwise(normal_p("t_stat")))
    lead = F.coalesce("representative", "feature")
    x = x.withColumn("reasons", _reasons(
        lead, low_coverage=F.col("coverage") < coverage, low_variance=(F.col("coverage") >= coverage) & (F.col("std") <= flat), stable_negative_ic=(F.col("rank_ic") <= negative) & (F.col("positive") < positive),
    ))
    weak = (F.col("p_value") > 0.2) & (F.col("positive") < 0.67)
    out = F.size("reasons") > 0
    return x.select("feature", F.when(out, "hard_exclude").when(weak, "watch").otherwise("keep_candidate").alias("decision"), F.when(~out & weak, "weak_evidence").otherwise(F.array_join("reasons", ",")).alias("reasons"), "coverage", "rank_ic", "positive", "folds", "t_stat", "p_value", lead.alias("representative"))


# Terms of the market's state.
STATES = ("strength", "risk_on", "neutral", "risk_off", "rotation")


def regime_terms(panel: DataFrame, regimes: DataFrame, scores: list[str]) -> DataFrame:
    """Add the state of the date's regime (`regime`, `strength`; `range_co_move` with no strength where there is none) as five terms, and each score times each term less its mean over all rows."""
    x = panel.join(regimes.select("date", "regime", F.col("strength").alias("_s")), "date", "left").withColumn("regime", F.coalesce("regime", F.lit("range_co_move")))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    up, down = F.col("regime").startswith("bull_"), F.col("regime").startswith("bear_")
    x = x.withColumns({"strength": R.clip(F.coalesce(F.nanvl("_s", F.lit(0.0)), F.lit(0.0)), 0.0, 1.0), "risk_on": one(up), "neutral": one(~up & ~down), "risk_off": one(down), "rotation": one(F.col("regime").endswith("_rotation"))}).drop("_s")
    means = x.agg(*(F.avg(c).alias(f"_m_{c}") for c in STATES))
    x = x.crossJoin(F.broadcast(means))  # one row
    return x.select("*", *((F.col(s) * (F.col(c) - F.col(f"_m_{c}"))).alias(f"{s}_x_{c}") for s in scores for c in STATES)).drop(*(f"_m_{c}" for c in STATES))


# Component -> range that it is scaled on, weight; limits of the labels; strength -> share of the span of floors.
TREND = {"close_short": (-0.04, 0.05, 0.9), "close_mid": (-0.08, 0.10, 1.2), "short_mid": (-0.03, 0.05, 1.0), "mid_long": (-0.04, 0.06, 1.2), "ret_short": (-0.06, 0.08, 0.8), "ret_mid": (-0.10, 0.15, 1.0), "drawdown": (-0.12, 0.0, 1.0)}
MODES = ((0.78, "bull"), (0.58, "constructive"), (0.38, "neutral"))
FLOORS = ((0.0, 0.0), (0.25, 0.20), (0.45, 0.40), (0.65, 0.62), (0.82, 0.82), (1.0, 1.0))


def trend_states(bars: DataFrame, short: int = 20, mid: int = 60, long: int = 120, breakout: int = 60, floor: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """Per instrument and bar with enough history: seven components of the price trend scaled to 0 to 1, their weighted mean `strength`, its label, and the least share to hold, which rises with it."""
    from quantloom.functions.scalars import piecewise

    h = R.history()
    c = F.col("close")
    need = max(short, mid, long, breakout) + 1
    mean = lambda n: F.avg("close").over(R.last_n(n))
    change = lambda n: R.ratio(c, F.when(F.lag("close", n).over(h) > 0, F.lag("close", n).over(h))) - 1
    raw = {
        "close_short": R.ratio(c, mean(short)) - 1, "close_mid": R.ratio(c, mean(mid)) - 1, "short_mid": R.ratio(mean(short), mean(mid)) - 1, "mid_long": R.ratio(mean(mid), mean(long)) - 1,
        "ret_short": F.coalesce(change(short), F.lit(0.0)), "ret_mid": F.coalesce(change(mid), F.lit(0.0)), "drawdown": R.ratio(c, F.max("close").over(R.last_n(breakout))) - 1,
    }
    x = bars.where(c.isNotNull()).select("id", "date", "close", F.row_number().over(h).alias("_n"), *(v.alias(k) for k, v in raw.items())).where(F.col("_n") >= need)
    x = x.withColumns({k: R.clip((F.col(k) - lo) / (hi - lo), 0.0, 1.0) for k, (lo, hi, _) in TREND.items()})
    strength = sum((F.col(k) * w for k, (_, _, w) in TREND.items()), F.lit(0.0)) / sum(w for _, _, w in TREND.values())
    x = x.withColumn("strength", strength)
    mode = F.when(F.col("strength") >= MODES[0][0], MODES[0][1])
    for at, name in MODES[1:]:
        mode = mode.when(F.col("strength") >= at, name)
    lo, hi = floor
    return x.select("id", "date", *TREND, "strength", mode.otherwise("defensive").alias("mode"), piecewise(F.col("strength"), [(a, lo + (hi - lo) * b) for a, b in FLOORS]).alias("floor"))

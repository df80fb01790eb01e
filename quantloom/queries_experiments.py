"""Queries of experiments, of periodic risk and of values by period, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import cross_section, evaluation, experiments, feature_review
from quantloom.queries import BARS, FWD, WEIGHTS, _portfolio, _rounded, query
from quantloom.queries_portfolio import _SERIES
from quantloom.sources import market
from quantloom.sources.shared import written

_SIGNALS = {"slow": 20, "middle": 10, "fast": 5}
_EX = f"""ew AS MATERIALIZED (SELECT id, date, {', '.join(f'round(close / lag(close, {n}) OVER h - 1, 9) AS {k}' for k, n in _SIGNALS.items())}, lead(close, 2) OVER h / lead(close, 1) OVER h - 1 AS fwd1 FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)),
el AS MATERIALIZED (SELECT * FROM (SELECT id, date, fwd1, {', '.join(_SIGNALS)} FROM ew WHERE fwd1 IS NOT NULL) UNPIVOT (x FOR experiment IN ({', '.join(_SIGNALS)}))), dn AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM bars)),
er AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY experiment, date ORDER BY x DESC, id) AS i, rank() OVER (PARTITION BY experiment, date ORDER BY x) + (count(*) OVER (PARTITION BY experiment, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY experiment, date ORDER BY fwd1) + (count(*) OVER (PARTITION BY experiment, date, fwd1) - 1) / 2.0 AS b FROM el WINDOW w AS (PARTITION BY experiment, date)),
ed AS (SELECT experiment, date, year(date) AS fold, month(date) <= 6 AS val, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic, avg(CASE WHEN i <= least(5, n // 2) THEN fwd1 END) - avg(CASE WHEN i > n - least(5, n // 2) THEN fwd1 END) AS spread FROM er WHERE n >= 2 GROUP BY ALL),
ef AS (SELECT experiment, fold, coalesce(avg(CASE WHEN NOT val THEN ic END), 0) AS ic, coalesce(avg(CASE WHEN NOT val THEN spread END), 0) AS spread, coalesce(avg(CASE WHEN val THEN ic END), 0) AS val_ic, coalesce(avg(CASE WHEN val THEN spread END), 0) AS val_spread FROM ed GROUP BY ALL HAVING count_if(val) > 0 AND count_if(NOT val) > 0),
eh AS (SELECT experiment, dn.n AS d, date, id, fwd1, 1.0 / count(*) OVER (PARTITION BY experiment, date) AS w FROM er JOIN dn USING (date) WHERE i <= 5), et AS (SELECT coalesce(p.experiment, q.experiment) AS experiment, coalesce(p.d, q.d + 1) AS d, sum(abs(coalesce(p.w, 0) - coalesce(q.w, 0))) / 2 AS t FROM eh p FULL JOIN eh q ON p.experiment = q.experiment AND p.id = q.id AND p.d = q.d + 1 GROUP BY 1, 2),
ep AS (SELECT experiment, date, d, sum(w * fwd1) / 1000 AS r FROM eh GROUP BY ALL), en AS (SELECT ep.*, year(date) AS fold, CASE WHEN EXISTS (SELECT 1 FROM ep z WHERE z.experiment = ep.experiment AND z.d = ep.d - 1) THEN t ELSE 1.0 END AS t FROM ep JOIN et ON et.experiment = ep.experiment AND et.d = ep.d WHERE month(date) > 6),
ee AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY experiment, fold ORDER BY d)) AS e FROM en), eg AS (SELECT *, greatest(1, max(e) OVER (PARTITION BY experiment, fold ORDER BY d)) AS peak FROM ee),
ek AS (SELECT experiment, fold, avg(r) AS gross, avg(r - t * 0.0001) AS net, avg(t) AS turnover, max(1 - e / peak) AS max_drawdown FROM eg GROUP BY ALL), folds AS MATERIALIZED (SELECT * FROM ef JOIN ek USING (experiment, fold))"""


def _stable_sql(name: str, metric: str) -> str:
    return f"""{name}a AS (SELECT experiment, fold, {metric} AS x, median({metric}) OVER (PARTITION BY experiment) AS mid FROM folds), {name}b AS (SELECT *, x < mid AS low, row_number() OVER (PARTITION BY experiment ORDER BY fold) - row_number() OVER (PARTITION BY experiment, x < mid ORDER BY fold) AS g FROM {name}a), {name}c AS (SELECT experiment, max(c) AS lg FROM (SELECT experiment, count(*) AS c FROM {name}b WHERE low GROUP BY experiment, g) GROUP BY experiment),
{name}d AS (SELECT experiment, avg(x) AS m, stddev_pop(x) AS s, min(x) AS w, max(mid) AS mid, count(*) AS n FROM {name}a GROUP BY experiment), {name} AS (SELECT experiment, CASE WHEN abs(m) > 1e-12 THEN s / abs(m) ELSE 'inf'::DOUBLE END AS cv, 0.5 * CASE WHEN s / abs(m) >= 0.5 THEN 0 WHEN s / abs(m) <= 0.1 THEN 100 ELSE (0.5 - s / abs(m)) / 0.4 * 100 END
+ 0.3 * CASE WHEN mid = 0 THEN 50 WHEN w / mid >= 0.8 THEN 100 WHEN w / mid <= 0 THEN 0 ELSE w / mid / 0.8 * 100 END + 0.2 * CASE WHEN n <= 1 THEN 100 WHEN coalesce(lg, 0) / n >= 0.5 THEN 0 WHEN coalesce(lg, 0) / n <= 0.1 THEN 100 ELSE (0.5 - coalesce(lg, 0) / n) / 0.4 * 100 END AS score FROM {name}d LEFT JOIN {name}c USING (experiment))"""


_SM = f"""{_stable_sql('si', 'ic')}, {_stable_sql('sn', 'net')}, sg AS (SELECT experiment, count(*) AS folds, avg(ic) AS ic, avg(spread) AS spread, avg(gross) AS gross, avg(net) AS net, avg(turnover) AS turnover, max(max_drawdown) AS max_drawdown, avg((ic > 0)::INT) AS positive, avg(val_ic - ic) AS ic_decay, avg(val_spread - spread) AS spread_decay, avg((val_ic + val_spread > ic + spread)::INT) AS val_wins FROM folds GROUP BY experiment),
sm AS MATERIALIZED (SELECT sg.*, si.score AS stability, si.cv AS stability_cv, sn.score AS net_stability, ic_decay > 0.02 AS fi, spread_decay > 0.005 AS fs, val_wins > 0.8 AS fv FROM sg JOIN si USING (experiment) JOIN sn USING (experiment))"""


def _folds(spark, d):
    """Yearly folds of three momentum signals: the first half of a year validates, the second tests; the five best names in equal weights, at a hundredth of a percent a side."""
    h = Window.partitionBy("id").orderBy("date")
    bars = market.bars(spark, d)
    x = bars.select("id", "date", *(F.round(R.ratio(F.col("close"), F.lag("close", n).over(h)) - 1, 9).alias(k) for k, n in _SIGNALS.items()), (R.ratio(F.lead("close", 2).over(h), F.lead("close", 1).over(h)) - 1).alias("fwd1")).where("fwd1 is not null")
    x = x.repartition("date")  # one shuffle of the panel serves the metrics and the portfolios
    half = F.year("date") * 2 + (F.month("date") > 6).cast("int")
    m = feature_review.fold_metrics(x.withColumn("half", half), list(_SIGNALS), "fwd1", fold="half", top=5).select(F.col("feature").alias("experiment"), F.floor(F.col("fold") / 2).cast("int").alias("fold"), (F.col("fold") % 2).alias("_test"), "rank_ic", "spread", "dates").where("dates > 0")
    of = lambda test, c: F.max(F.when(F.col("_test") == test, F.col(c)))  # noqa: E731  one row a half
    m = m.groupBy("experiment", "fold").agg(of(1, "rank_ic").alias("ic"), of(1, "spread").alias("spread"), of(0, "rank_ic").alias("val_ic"), of(0, "spread").alias("val_spread")).where("ic is not null and val_ic is not null")
    days = market.calendar(spark, d).select("date", F.col("seq").alias("d"))
    r = cross_section.best_by_score(x, list(_SIGNALS), 5, ["fwd1"], name="experiment").withColumnRenamed("weight", "w").join(days, "date")
    name = Window.partitionBy("experiment", "id").orderBy("d")
    bought = F.abs(F.col("w") - F.when(F.lag("d").over(name) == F.col("d") - 1, F.lag("w").over(name)).otherwise(0.0))
    sold = F.when(F.lead("d").over(name) == F.col("d") + 1, 0.0).otherwise(F.col("w"))
    p = r.withColumn("_b", bought).withColumn("_s", sold).groupBy("experiment", "date", "d").agg((F.sum(F.col("w") * F.col("fwd1")) / 1000).alias("r"), F.sum("_b").alias("_b"), F.sum("_s").alias("_s"))
    own = Window.partitionBy("experiment").orderBy("d")
    t = F.when(F.lag("d").over(own) == F.col("d") - 1, (F.col("_b") + F.lag("_s").over(own)) / 2).otherwise(1.0)
    p = p.withColumn("t", t).where(F.month("date") > 6).withColumn("fold", F.year("date"))
    p = evaluation.equity(p, "r", ["experiment", "fold"])
    k = p.groupBy("experiment", "fold").agg(F.avg("r").alias("gross"), F.avg(F.col("r") - F.col("t") * 0.0001).alias("net"), F.avg("t").alias("turnover"), F.max(-F.col("drawdown")).alias("max_drawdown"))
    return written(m.join(k, ["experiment", "fold"]), "folds")  # a few rows, read several times


@query(f"""{BARS}, {_EX}, {_SM} SELECT experiment, folds, {_rounded('ic', 'spread', 'gross', 'net', 'turnover', 'max_drawdown', 'positive', 'ic_decay', 'spread_decay', 'val_wins', 'stability', 'stability_cv', 'net_stability', digits=4)}, fi AS flag_ic, fs AS flag_spread, fv AS flag_val FROM sm""", digits=4)
def experiment_summaries(spark, d):
    return experiments.summaries(_folds(spark, d)).drop("stability_worst", "net_stability_cv", "net_stability_worst")


@query(f"""{BARS}, {_EX}, {_SM}, xd AS (SELECT c.experiment, c.fold, round(c.ic - b.ic, 12) AS di, round(c.net - b.net, 12) AS dn FROM folds c JOIN folds b ON b.fold = c.fold AND b.experiment = 'slow' WHERE c.experiment <> 'slow'), xr AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY dn DESC) AS i FROM xd),
xa AS (SELECT experiment, count(*) AS aligned, avg(di) AS ic_delta, count_if(di > 0)::BIGINT AS ic_wins, avg(dn) AS net_delta, count_if(dn > 0)::BIGINT AS net_wins, sum(dn) AS t, coalesce(sum(CASE WHEN dn > 0 AND i <= 2 THEN dn END) / nullif(sum(CASE WHEN dn > 0 THEN dn END), 0), 0) AS top2_share FROM xr GROUP BY experiment),
xf AS (SELECT xa.*, c.stability - b.stability AS stability_delta, c.net_stability - b.net_stability AS net_stability_delta, round(c.net - b.net, 12) <= 0 AS lost, t > 0 AND (net_wins / aligned < 0.4 OR net_wins <= 2 AND aligned >= 5 OR top2_share >= 0.65) AS few, c.ic_decay > b.ic_decay + 0.01 OR c.spread_decay > b.spread_decay + 0.003 OR c.val_wins > b.val_wins + 0.15 OR c.fi AND NOT b.fi OR c.fs AND NOT b.fs OR c.fv AND NOT b.fv AS ov,
c.stability - b.stability < -5 OR c.net_stability - b.net_stability < -5 OR c.positive - b.positive < -0.15 AS ws FROM xa JOIN sm c ON c.experiment = xa.experiment JOIN sm b ON b.experiment = 'slow')
SELECT experiment, aligned, ic_wins, net_wins, {_rounded('ic_delta', 'net_delta', 'top2_share', 'stability_delta', 'net_stability_delta', digits=4)}, concat_ws(',', CASE WHEN lost THEN 'cost_not_hold' END, CASE WHEN few THEN 'few_window_uplift' END, CASE WHEN ov THEN 'overfit_warning' END, CASE WHEN ws THEN 'stability_regression' END) AS reasons, CASE WHEN lost THEN 'REJECT' WHEN few OR ov OR ws THEN 'HOLD' ELSE 'MERGE' END AS status FROM xf""", digits=4)
def experiment_comparison(spark, d):
    return experiments.compared(_folds(spark, d), "slow")


@query(f"""{BARS}, {_EX}, {_SM}, j AS (SELECT c.*, b.net AS bn, b.max_drawdown AS bd, b.stability AS bs, b.stability_cv AS bc, b.positive AS bp, t.net AS tn, t.max_drawdown AS td, t.stability AS ts FROM sm c, sm b, sm t WHERE c.experiment <> 'slow' AND b.experiment = 'slow' AND t.experiment = 'middle'),
k AS (SELECT *, CASE WHEN max_drawdown > 0 THEN net * 252 / max_drawdown ELSE 0 END AS cal, CASE WHEN bd > 0 THEN bn * 252 / bd ELSE 0 END AS bcal, CASE WHEN td > 0 THEN tn * 252 / td ELSE 0 END AS tcal, concat_ws(',', CASE WHEN max_drawdown > 0.12 THEN 'max_drawdown' END, CASE WHEN turnover > 0.2 THEN 'mean_turnover' END, CASE WHEN stability < least(50, greatest(10, bs * 0.85)) THEN 'stability_score' END,
CASE WHEN stability_cv > greatest(0.6, bc + 0.15) THEN 'cv' END, CASE WHEN positive < greatest(least(0.7, bp), bp - 0.1) THEN 'positive_ratio' END, CASE WHEN fi THEN 'flag_ic_decay' END, CASE WHEN fs THEN 'flag_spread_decay' END, CASE WHEN fv THEN 'flag_val_dominant' END) AS failed FROM j), l AS (SELECT *, net > bn AND cal > bcal AND stability - bs >= -5 AS b1, net > tn AND cal > tcal AND stability - ts >= -5 AS b2 FROM k)
SELECT experiment, CASE WHEN failed <> '' THEN 'discard' WHEN b1 AND b2 THEN 'champion' WHEN b1 THEN 'keep' ELSE 'discard' END AS status, CASE WHEN failed <> '' THEN 'guardrail_failed' WHEN b1 AND b2 THEN 'full_improved' WHEN b1 THEN 'full_pass_not_best' ELSE 'no_material_improvement' END AS reason, failed, {_rounded('net - bn AS net_delta', 'cal - bcal AS calmar_delta', digits=3)} FROM l""", digits=3)
def candidate_judgement(spark, d):
    return experiments.judged(experiments.summaries(_folds(spark, d)), "slow", best="middle")


_PERIODS = """pr AS (SELECT 'week' AS period, date_trunc('week', date) AS p, date, ret, bench FROM sr UNION ALL SELECT 'month', date_trunc('month', date), date, ret, bench FROM sr), pc AS (SELECT period, p, exp(sum(ln(1 + ret))) - 1 AS ret, exp(sum(ln(1 + bench))) - 1 AS bret, max(date) AS date FROM pr GROUP BY ALL)"""


def _series(spark, d):
    """Portfolio and benchmark returns, a thousandth of them, by period; weeks begin on Monday."""
    b = market.benchmark(spark, d).select("date", (R.ratio(F.lead("bench").over(Window.orderBy("date")), F.col("bench")) - 1).alias("bench"))  # one row a day
    daily = _portfolio(spark, d).join(b, "date").where("bench is not null").select("date", (F.col("ret") / 1000).alias("ret"), (F.col("bench") / 1000).alias("bench"))
    span = F.array(*(F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, "date")).alias("p")) for p in ("week", "month")))
    x = daily.select("date", "ret", "bench", F.explode(span).alias("s")).select("date", "ret", "bench", "s.*")
    return x.groupBy("period", "p").agg(F.expm1(F.sum(F.log1p("ret"))).alias("ret"), F.expm1(F.sum(F.log1p("bench"))).alias("bret"), F.max("date").alias("date"))


def _risk_sql(year: str) -> str:
    return _rounded(
        f"exp(sum(ln(1 + ret)) * {year} / count(*)) - 1 AS annual_return", f"stddev_samp(ret) * sqrt({year}) AS annual_vol", f"avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({year}) AS sharpe", f"avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt({year}) AS sortino",
        "covar_samp(ret, bret) / nullif(var_samp(bret), 0) AS beta", f"(avg(ret) - covar_samp(ret, bret) / nullif(var_samp(bret), 0) * avg(bret)) * {year} AS alpha", f"stddev_samp(ret - bret) * sqrt({year}) AS tracking_error", f"avg(ret - bret) / nullif(stddev_samp(ret - bret), 0) * sqrt({year}) AS info_ratio", "quantile_cont(ret, 0.05) AS var5", "avg((ret > 0)::INT) AS win_rate",
        digits=5,
    )


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_SERIES}, {_PERIODS} SELECT period, count(*) AS days, {_risk_sql('52')} FROM pc WHERE period = 'week' GROUP BY period UNION ALL SELECT period, count(*), {_risk_sql('12')} FROM pc WHERE period = 'month' GROUP BY period""", digits=5)
def periodic_risk(spark, d):
    """The risk summary of weekly and of monthly returns; `days` counts periods."""
    x = _series(spark, d)
    return evaluation.performance(x.where("period = 'week'"), "ret", "bret", ["period"], year=52).unionByName(evaluation.performance(x.where("period = 'month'"), "ret", "bret", ["period"], year=12))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_SERIES}, {_PERIODS} SELECT period, date, {_rounded('exp(sum(ln(1 + ret)) OVER (PARTITION BY period ORDER BY p)) AS nav', 'ret')} FROM pc""")
def period_navs(spark, d):
    """Value of the portfolio at the end of each week and month, from 1, and the return since the one before."""
    w = Window.partitionBy("period").orderBy("p")  # one row a week
    return _series(spark, d).select("period", "date", F.exp(F.sum(F.log1p("ret")).over(w)).alias("nav"), "ret")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_SERIES}, ye AS (SELECT year(date) AS year, date, ret, bench AS bret FROM sr), yq AS (SELECT *, exp(sum(ln(1 + ret)) OVER h) AS e, exp(sum(ln(1 + ret) - ln(1 + bret)) OVER h) AS x FROM ye WINDOW h AS (PARTITION BY year ORDER BY date)), yp AS (SELECT *, greatest(1, max(e) OVER h) AS pe, greatest(1, max(x) OVER h) AS px FROM yq WINDOW h AS (PARTITION BY year ORDER BY date))
SELECT year, count(*) AS days, {_risk_sql('252')}, {_rounded('exp(sum(ln(1 + ret))) - 1 AS total', 'exp(sum(ln(1 + ret) - ln(1 + bret))) - 1 AS geometric_excess', 'max(1 - e / pe) AS max_drawdown', 'max(1 - x / px) AS excess_max_drawdown', digits=5)} FROM yp GROUP BY year""", digits=5)
def yearly_indicators(spark, d):
    b = market.benchmark(spark, d).select("date", (R.ratio(F.lead("bench").over(Window.orderBy("date")), F.col("bench")) - 1).alias("bret"))  # one row a day
    x = _portfolio(spark, d).join(b, "date").where("bret is not null").select(F.year("date").alias("year"), "date", (F.col("ret") / 1000).alias("ret"), (F.col("bret") / 1000).alias("bret"))
    w = Window.partitionBy("year").orderBy("date")  # a year of rows
    x = x.withColumn("_e", F.exp(F.sum(F.log1p("ret")).over(w))).withColumn("_x", F.exp(F.sum(F.log1p("ret") - F.log1p("bret")).over(w)))
    x = x.withColumn("_pe", F.greatest(F.lit(1.0), F.max("_e").over(w))).withColumn("_px", F.greatest(F.lit(1.0), F.max("_x").over(w)))
    more = x.groupBy("year").agg(F.expm1(F.sum(F.log1p("ret"))).alias("total"), F.expm1(F.sum(F.log1p("ret") - F.log1p("bret"))).alias("geometric_excess"), F.max(1 - F.col("_e") / F.col("_pe")).alias("max_drawdown"), F.max(1 - F.col("_x") / F.col("_px")).alias("excess_max_drawdown"))
    return evaluation.performance(x, "ret", "bret", ["year"]).join(more, "year")


@query(f"""{BARS} SELECT id, date, {_rounded(*(f'CASE WHEN count(close) OVER w{n} >= {n} THEN avg(close) OVER w{n} END AS ma{n}' for n in (5, 10, 20, 60)), digits=4)} FROM bars WINDOW {', '.join(f'w{n} AS (PARTITION BY id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)' for n in (5, 10, 20, 60))}""", digits=4)
def moving_means(spark, d):
    return market.bars(spark, d).select("id", "date", *(R.mean("close", n).alias(f"ma{n}") for n in (5, 10, 20, 60)))


@query("""t AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS v, o_orderstatus = 'F' AS buy FROM orders), s AS (SELECT median(v) * 0.2 AS small FROM t) SELECT date, count(*) AS orders, count_if(v < small)::BIGINT AS small_orders, round(sum(CASE WHEN buy THEN v ELSE 0 END), 4) AS bought, round(sum(CASE WHEN buy THEN 0 ELSE v END), 4) AS sold, round(sum(v) / 2, 4) AS turnover, round(max(v) / sum(v), 4) AS largest_share FROM t, s GROUP BY date""", digits=4)
def order_turnover(spark, d):
    """Per date: orders, those below a fifth of the median value, values bought and sold, half their sum, and the share of the largest."""
    t = market.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"), (F.col("o_orderstatus") == "F").alias("buy"))
    x = t.crossJoin(F.broadcast(t.agg((F.median("v") * 0.2).alias("small"))))  # one row
    side = lambda cond: F.sum(F.when(cond, F.col("v")).otherwise(0.0))
    return x.groupBy("date").agg(F.count("*").alias("orders"), F.count_if(F.col("v") < F.col("small")).alias("small_orders"), side(F.col("buy")).alias("bought"), side(~F.col("buy")).alias("sold"), (F.sum("v") / 2).alias("turnover"), (F.max("v") / F.sum("v")).alias("largest_share"))

"""Queries of portfolios, ledgers and rolling scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import construction, diagnostics, features, labels, ledgers, portfolio, scoring
from quantloom.queries import _PORT, BARS, FWD, WEIGHTS, _portfolio, _rounded, _top_weights, query
from quantloom.sources import market

_KINDS = """kd AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'etf' ELSE 'stock' END AS asset_type, industry, sector FROM inst)"""


def _kinds(spark, d):
    return market.instruments(spark, d).withColumn("asset_type", F.when(F.col("id") % 3 == 0, "etf").otherwise("stock"))


_MOVES = """dn AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM wts)), a0 AS (SELECT n, id, weight FROM wts JOIN dn USING (date)),
mv AS (SELECT coalesce(x.n, y.n + 1) AS n, coalesce(x.id, y.id) AS id, coalesce(x.weight, 0) - coalesce(y.weight, 0) AS mv FROM a0 x FULL JOIN a0 y ON x.n = y.n + 1 AND x.id = y.id)"""
_COST = f"""{_KINDS}, {_MOVES}, pc AS (SELECT date, sum(greatest(mv, 0) * CASE asset_type WHEN 'etf' THEN 0.0003 ELSE 0.0008 END + greatest(-mv, 0) * CASE asset_type WHEN 'etf' THEN 0.0003 ELSE 0.0018 END) AS cost, sum(abs(mv)) / 2 AS turnover FROM mv JOIN dn USING (n) JOIN kd USING (id) GROUP BY date)"""


def _cost(spark, d):
    w = _top_weights(spark, d).join(_kinds(spark, d), "id")
    return construction.period_cost(w, {"etf": 0.0003}, {"etf": 0.0003}, (0.0008, 0.0018))


@query(f"{BARS}, {FWD}, {WEIGHTS}, {_COST} SELECT date, {_rounded('cost', 'turnover')} FROM pc")
def period_costs(spark, d):
    return _cost(spark, d)


@query(f"{BARS}, {FWD}, {WEIGHTS} SELECT w.date, {_rounded('sum(weight * fwd1) AS ret', 'sum(abs(weight)) AS gross')} FROM wts w LEFT JOIN fwd USING (id, date) GROUP BY w.date HAVING bool_and(fwd1 IS NOT NULL)")
def complete_portfolio_returns(spark, d):
    return construction.complete_returns(_top_weights(spark, d), labels.forward_returns(market.bars(spark, d)), "fwd1")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_KINDS}, g AS (SELECT date, industry, sum(abs(weight)) AS x, count_if(weight > 0.15 + 1e-12) AS s, count_if(weight > 1e-12) AS h FROM wts JOIN kd USING (id) GROUP BY ALL), y AS (SELECT date, sum(s) AS s, sum(h) AS h, sum(x) AS x, count_if(x > 0.25 + 1e-12) AS o FROM g GROUP BY date)
SELECT sum(s)::BIGINT AS single, sum(o)::BIGINT AS grouped, count_if(x > 0.9 + 1e-8)::BIGINT AS gross_over, count_if(x < 0.9 - 1e-8)::BIGINT AS gross_short, count_if(h < 8)::BIGINT AS too_few, count_if(h > 9)::BIGINT AS too_many FROM y""")
def constraint_violations(spark, d):
    return construction.violations(_top_weights(spark, d).join(_kinds(spark, d), "id"), "industry", 0.15, 0.25, 0.9, (8, 9))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_KINDS}, g AS (SELECT date, layer, budget FROM (SELECT DISTINCT date FROM wts), (VALUES ('etf', 0.4), ('stock', 0.5)) t(layer, budget)), h AS (SELECT date, asset_type AS layer, sum(weight) AS x FROM wts JOIN kd USING (id) GROUP BY ALL), j AS (SELECT layer, budget, coalesce(x, 0) AS x FROM g LEFT JOIN h USING (date, layer))
SELECT layer, {_rounded('avg(x) AS weight_mean', 'max(x) AS weight_max', 'avg(abs(x - budget)) AS deviation_mean', 'max(abs(x - budget)) AS deviation_max')}, count(*) AS dates FROM j GROUP BY layer""")
def layer_drift(spark, d):
    return construction.layer_drift(_top_weights(spark, d).join(_kinds(spark, d), "id"), "asset_type", {"etf": 0.4, "stock": 0.5})


_NET = f"{_COST}, net AS (SELECT p.date, ret, cost, turnover, ret - cost AS net FROM port p JOIN pc USING (date))"


def _net(spark, d):
    return _portfolio(spark, d).join(_cost(spark, d), "date").withColumn("net", F.col("ret") - F.col("cost"))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_NET}, bb AS (SELECT date, lead(bench) OVER (ORDER BY date) / bench - 1 AS b FROM bench), x AS (SELECT date, net / 1000 AS ret, b / 1000 AS b, (net - b) / 1000 AS x FROM net JOIN bb USING (date) WHERE b IS NOT NULL), e AS (SELECT *, sum(ln(1 + x)) OVER (ORDER BY date) AS e, -sum(x) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS short FROM x),
f AS (SELECT *, 1 - exp(e - max(e) OVER (ORDER BY date)) AS fall FROM e)
SELECT count(*) AS dates, {_rounded('avg(x) AS excess_mean', 'avg((x > 0)::INT) AS hit_rate', 'max(fall) AS excess_drawdown', 'greatest(max(short), max(-x), 0) AS shortfall', 'stddev_pop(x) * sqrt(252) AS tracking_error', 'avg(x) / nullif(stddev_pop(x), 0) * sqrt(252) AS information_ratio', 'covar_pop(ret, b) / var_pop(b) AS beta',
    '(avg(ret) - (0.02 / 252 + covar_pop(ret, b) / var_pop(b) * (avg(b) - 0.02 / 252))) * 252 AS jensen_alpha')} FROM f""")
def benchmark_skill(spark, d):
    b = market.benchmark(spark, d).select("date", (R.ratio(F.lead("bench").over(Window.orderBy("date")), F.col("bench")) - 1).alias("bench"))  # one row a day
    return construction.benchmark_skill(_net(spark, d).select("date", (F.col("net") / 1000).alias("ret")).join(b.withColumn("bench", F.col("bench") / 1000), "date"))


@query(f"{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_NET} SELECT date, {_rounded('ret AS gross', 'cost', 'net', 'turnover', 'sum(ln(1 + ret)) OVER (ORDER BY date) AS log_gross', 'sum(ln(1 + net)) OVER (ORDER BY date) AS log_net')} FROM net")
def tradable_outcome(spark, d):
    """Gross and net return, cost, turnover and both equity curves (as logs) per date."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return _net(spark, d).select("date", F.col("ret").alias("gross"), "cost", "net", "turnover", F.sum(F.log1p("ret")).over(run).alias("log_gross"), F.sum(F.log1p("net")).over(run).alias("log_net"))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_KINDS}, {_MOVES}, r AS (SELECT asset_type, sum(weight * fwd1) AS contribution, count(*) AS positions FROM wts JOIN fwd USING (id, date) JOIN kd USING (id) WHERE fwd1 IS NOT NULL GROUP BY 1), o AS (SELECT asset_type, count_if(abs(mv) > 1e-12) AS orders, sum(abs(mv)) AS moved FROM mv JOIN dn USING (n) JOIN kd USING (id) GROUP BY 1)
SELECT coalesce(r.asset_type, o.asset_type) AS asset_type, {_rounded('contribution', 'moved')}, positions, orders FROM r FULL JOIN o ON r.asset_type = o.asset_type""")
def contribution_by_type(spark, d):
    kinds = _kinds(spark, d)
    w = _top_weights(spark, d)
    r = w.join(labels.forward_returns(market.bars(spark, d)).where("fwd1 is not null").select("id", "date", "fwd1"), ["id", "date"]).join(kinds, "id").groupBy("asset_type").agg(F.sum(F.col("weight") * F.col("fwd1")).alias("contribution"), F.count("*").alias("positions"))
    days = w.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))  # one row a day
    now = w.join(days, "date").select("n", "id", "weight")
    move = now.join(now.select((F.col("n") + 1).alias("n"), "id", F.col("weight").alias("was")), ["n", "id"], "full").join(days, "n").withColumn("move", F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))
    o = move.join(kinds, "id").groupBy("asset_type").agg(F.count_if(F.col("move") > 1e-12).alias("orders"), F.sum("move").alias("moved"))
    return r.join(o, "asset_type", "full")


@query("""o AS (SELECT CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 1 ELSE -1 END * o_totalprice AS v FROM orders WHERE o_orderstatus IN ('F', 'O')), c AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT c.date, round(coalesce(sum(abs(v)) * 0.0008, 0), 4) AS cost, round(coalesce(sum(abs(v)), 0), 4) AS traded, count(v) AS orders FROM c LEFT JOIN o USING (date) GROUP BY c.date""", digits=4)
def order_costs(spark, d):
    """Cost and amount of the orders of each trading date, 0 without orders."""
    o = market.trades(spark, d).groupBy("date").agg(F.sum("amount").alias("traded"), F.count("*").alias("orders"))
    x = market.calendar(spark, d).select("date").join(o, "date", "left")
    traded = F.coalesce("traded", F.lit(0.0))
    return x.select("date", (traded * 0.0008).alias("cost"), traded.alias("traded"), F.coalesce("orders", F.lit(0)).alias("orders"))


_TARGETS = """tg AS (SELECT coalesce(x.n, y.n + 1) AS n, coalesce(x.id, y.id) AS id, coalesce(x.weight, 0) AS target, coalesce(y.weight, 0) AS current FROM a0 x FULL JOIN a0 y ON x.n = y.n + 1 AND x.id = y.id)"""


def _targets(spark, d):
    w = _top_weights(spark, d)
    days = w.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))  # one row a day
    now = w.join(days, "date").select("n", "id", F.col("weight").alias("target"))
    was = now.select((F.col("n") + 1).alias("n"), "id", F.col("target").alias("current"))
    return now.join(was, ["n", "id"], "full").join(days, "n")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_MOVES}, {_TARGETS}, al AS (SELECT tg.n, date, id, target - current AS mv, current, abs(target - current) * abs(coalesce(mom20, 1)) AS r FROM tg JOIN dn USING (n) LEFT JOIN sig USING (date, id)),
u AS (SELECT *, coalesce(sum(abs(mv)) OVER (PARTITION BY date, sign(mv) ORDER BY r DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM al)
SELECT date, id, {_rounded('current + sign(mv) * greatest(0, least(abs(mv), 0.35 - used)) AS weight', 'sign(mv) * greatest(0, least(abs(mv), 0.35 - used)) AS moved')} FROM u""")
def turnover_budget(spark, d):
    x = _targets(spark, d).join(features.momentum(market.bars(spark, d)).select("date", "id", F.col("mom20").alias("alpha")), ["date", "id"], "left")
    return construction.within_budget(x, 0.35)


@query(f"""{BARS}, {FWD}, {WEIGHTS}, p AS (SELECT date, id, weight, close AS price, (id % 7) * 1000 AS current FROM wts JOIN bars USING (date, id)), s AS (SELECT *, (CASE WHEN weight * 1e8 / price - current < 0 THEN -1 ELSE 1 END * floor(abs(weight * 1e8 / price - current) / 100 + 0.5) * 100)::BIGINT AS s0 FROM p),
t AS (SELECT *, CASE WHEN abs(s0 * price) < 5000 THEN 0 ELSE s0 END AS s1 FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY (s1 = 0)::INT, (s1 < 0)::INT DESC, abs(s0 * price) DESC, id) AS k FROM t)
SELECT date, id, CASE WHEN k <= 6 THEN s1 ELSE 0 END AS shares, round(CASE WHEN k <= 6 THEN s1 ELSE 0 END * price, 4) AS amount, (current + CASE WHEN k <= 6 THEN s1 ELSE 0 END)::BIGINT AS target_shares FROM r""", digits=4)
def lot_orders(spark, d):
    x = _top_weights(spark, d).join(market.bars(spark, d).select("date", "id", F.col("close").alias("price")), ["date", "id"]).withColumn("current", (F.col("id") % 7) * 1000)
    return construction.orders(x, 1e8, 100, 5000.0, 6)


@query()
def equally_capped_weights(spark, d):
    """Checked against a loop in the tests."""
    best = features.momentum(market.bars(spark, d)).where("mom20 > 0")
    return construction.capped_equally(best.select("date", "id", (F.col("mom20") / F.sum("mom20").over(Window.partitionBy("date"))).alias("weight")), 0.1)


@query()
def smoothed_weights(spark, d):
    """Checked against a loop in the tests."""
    return construction.smoothed_weights(_top_weights(spark, d).withColumn("book", F.lit(1)), 5)


_SERIES = f"{_PORT}, bb AS (SELECT date, lead(bench) OVER (ORDER BY date) / bench - 1 AS bench FROM bench), sr AS (SELECT date, ret / 1000 AS ret, bench / 1000 AS bench FROM port JOIN bb USING (date) WHERE bench IS NOT NULL)"
_WINDOWS = """mm AS (SELECT *, year(date) * 12 + month(date) - 1 AS m FROM sr), ab AS (SELECT min(m) AS a, max(m) AS b FROM mm), wn AS (SELECT unnest(range(0, (b - a) // 3 + 1)) AS win, a, b FROM ab), wr AS (SELECT * FROM wn JOIN mm ON m BETWEEN a + win * 3 AND a + win * 3 + 11 WHERE a + win * 3 + 11 <= b),
we AS (SELECT *, exp(sum(ln(1 + ret)) OVER h) AS e, exp(sum(ln(1 + bench)) OVER h) AS be, row_number() OVER h AS i FROM wr WINDOW h AS (PARTITION BY win ORDER BY date)), wp AS MATERIALIZED (SELECT *, max(e) OVER h AS peak, e / be AS x, greatest(1, max(e / be) OVER h) AS xpeak, e - coalesce(lag(e) OVER h, 1) AS gain, lag(date) OVER h AS before FROM we WINDOW h AS (PARTITION BY win ORDER BY date)),
hi AS (SELECT win, i, count_if(e > coalesce(p, e)) OVER (PARTITION BY win ORDER BY i) AS ep FROM (SELECT *, max(e) OVER (PARTITION BY win ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM wp)),
dp AS (SELECT win, ep, min(CASE WHEN e < peak THEN i END) AS f, arg_min(before, i) FILTER (WHERE e < peak) AS since, max(i) AS l, max(date) AS until, arg_max(e < peak, i) AS low FROM wp JOIN hi USING (win, i) GROUP BY win, ep),
dl AS (SELECT *, l - f + 1 + CASE WHEN ep < max(ep) OVER (PARTITION BY win) THEN 1 WHEN low THEN 0 END AS n FROM dp), dd AS (SELECT win, until - since AS dur FROM dl WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY win ORDER BY n DESC, f) = 1),
mo AS (SELECT win, avg(w::INT) AS mw FROM (SELECT win, m, sum(ln(1 + ret)) > sum(ln(1 + bench)) AS w FROM wr GROUP BY ALL) GROUP BY win),
wi AS (SELECT wp.win, min(a + wp.win * 3) AS st, count(*) AS days, count_if(ret <> 0) AS active_days, min(CASE WHEN ret <> 0 THEN date END) AS first_active, min(date) AS first_date, exp(sum(ln(1 + ret))) - 1 AS total_returns, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS annualized_returns,
exp((sum(ln(1 + ret)) - sum(ln(1 + bench))) * 252 / count(*)) - 1 AS excess_annual_returns, max(1 - e / greatest(1, peak)) AS max_drawdown, coalesce(any_value(dur), 0) AS max_drawdown_duration_days, max(1 - x / xpeak) AS excess_max_drawdown, stddev_samp(ret - bench) * sqrt(252) AS tracking_error,
avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252) AS sortino, avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt(252) AS information_ratio, avg((ret > 0)::INT) AS win_rate,
avg(CASE WHEN gain > 0 THEN gain END) / avg(CASE WHEN gain < 0 THEN -gain END) AS profit_loss_rate, any_value(mw) AS monthly_excess_win_rate FROM wp LEFT JOIN dd ON dd.win = wp.win LEFT JOIN mo ON mo.win = wp.win GROUP BY wp.win)"""
# Fixed values of the SQL: indicator, coefficients from the constant up, range, slopes beyond it, sign, weight.
_POINTS = """cu AS (SELECT * FROM (VALUES
('total_returns', 0.0, 385.873016, 36.772487, -5579.365079, 16243.386243, -0.15, 0.3, 144.4444, 655.7937, 1, 0.12),
('annualized_returns', -17.142857, 306.190476, 1033.333333, -6476.190476, 9523.809524, -0.1, 0.4, 130.0, 462.381, 1, 0.12),
('excess_annual_returns', 19.312452, 329.895595, -690.603514, 8041.762159, -13750.954927, -0.1, 0.2, 764.273, 578.6351, 1, 0.06),
('max_drawdown', 166.875, 1702.916667, 8391.666667, 22833.333333, 23333.333333, -0.35, -0.05, 218.3333, 1023.3333, -1, 0.10),
('max_drawdown_duration_days', 549.2455242967089, 9.365380789997912, 0.06447013829687052, 0.00019543904518330954, 2.1194468125416533e-07, -350, -90, 0.25, 1.8919, -1, 0.075),
('excess_max_drawdown', 229.705882, 6249.509804, 76062.091503, 419934.640523, 816993.464052, -0.2, -0.03, 382.3529, 2731.3725, -1, 0.0375),
('tracking_error', 160.0, 1423.333333, 4633.333333, 2666.666667, -13333.333333, -0.3, -0.05, 803.3333, 986.6667, -1, 0.0375),
('sharpe', 0.0, 70.434783, -80.942029, 55.652174, -10.144928, -0.3, 2.0, 135.1217, 89.8551, 1, 0.10),
('sortino', 0.0, 73.145743, -77.676768, 37.822671, -5.451339, -0.3, 3.0, 130.5527, 39.5527, 1, 0.10),
('information_ratio', 0.0, 76.260684, -59.850427, 59.496676, -15.906933, -0.3, 1.5, 129.953, 83.5684, 1, 0.05),
('win_rate', -1920.0, 13426.666667, -34366.666667, 37333.333333, -13333.333333, 0.35, 0.6, 803.3333, 986.6667, 1, 0.04),
('profit_loss_rate', -121.671068, 253.344465, -164.707265, 52.293645, -5.776856, 0.5, 3.0, 124.969, 53.1288, 1, 0.06),
('monthly_excess_win_rate', -111.666667, 215.15873, 1013.492063, -2825.396825, 2222.222222, 0.25, 0.7, 331.0317, 529.6032, 1, 0.10)) t(name, c0, c1, c2, c3, c4, lo, hi, sl, sr, sgn, wgt))"""
_NAMES = ("total_returns", "annualized_returns", "excess_annual_returns", "max_drawdown", "max_drawdown_duration_days", "excess_max_drawdown", "tracking_error", "sharpe", "sortino", "information_ratio", "win_rate", "profit_loss_rate", "monthly_excess_win_rate")
_SCORED = f"""{_SERIES}, {_WINDOWS}, {_POINTS}, lo AS (UNPIVOT (SELECT win, {', '.join(f'{c}::DOUBLE AS {c}' for c in _NAMES)} FROM wi) ON {', '.join(_NAMES)} INTO NAME name VALUE v),
pv AS (SELECT win, wgt, sgn * v AS v, greatest(lo, least(hi, sgn * v))::DOUBLE AS k, c0, c1, c2, c3, c4, CASE WHEN sgn * v < lo THEN sl * (sgn * v - lo) WHEN sgn * v > hi THEN sr * (sgn * v - hi) ELSE 0 END AS beyond FROM lo JOIN cu USING (name)),
ps AS (SELECT win, sum(wgt * (c0 + k * (c1 + k * (c2 + k * (c3 + k * c4))) + beyond)) AS score FROM pv GROUP BY win), sc AS (SELECT wi.*, coalesce(score, 0) AS score, st // 3 AS q0, (st + 11) // 3 AS q1 FROM wi LEFT JOIN ps ON ps.win = wi.win)"""
_CORE = ("annualized_returns", "max_drawdown", "sharpe", "win_rate")
_QUARTERS = f"{_SCORED}, qt AS (SELECT q AS quarter, avg(score) AS score, {', '.join(f'coalesce(avg({c}), 0) AS {c}' for c in _CORE)}, count(*) AS windows FROM (SELECT *, unnest(range(q0, q1 + 1)) AS q FROM sc) GROUP BY q)"


def _windows(spark, d):
    b = market.benchmark(spark, d).select("date", (R.ratio(F.lead("bench").over(Window.orderBy("date")), F.col("bench")) - 1).alias("bench"))  # one row a day
    daily = _portfolio(spark, d).join(b, "date").where("bench is not null").select("date", (F.col("ret") / 1000).alias("ret"), (F.col("bench") / 1000).alias("bench"))
    return scoring.window_scores(scoring.windows(daily))


def _quarters(spark, d):
    return scoring.quarters(_windows(spark, d), scoring.CORE)


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_SCORED} SELECT win::INT AS "window", days, active_days, first_active, first_date, (first_active - first_date)::INT AS delay, q0::INT AS start_quarter, q1::INT AS end_quarter, {_rounded(*_NAMES, 'score', digits=4)} FROM sc""", digits=4)
def window_scores(spark, d):
    return _windows(spark, d)


@query(f"{BARS}, {FWD}, {WEIGHTS}, {_QUARTERS} SELECT quarter::INT AS quarter, windows, {_rounded('score', *_CORE, digits=4)} FROM qt", digits=4)
def quarter_scores(spark, d):
    return _quarters(spark, d)


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_QUARTERS}, x AS (SELECT *, exp(-0.03 * (row_number() OVER (ORDER BY quarter DESC) - 1)) AS w FROM qt) SELECT {_rounded(*(f'sum({c} * w) / sum(w) AS {c}' for c in ('score', *_CORE)), digits=4)}, count(*) AS quarters FROM x""", digits=4)
def composite_score(spark, d):
    return scoring.composite(_quarters(spark, d), scoring.CORE)


_LONGEST = "lr AS (SELECT score < 30 AS low, row_number() OVER (ORDER BY quarter) - row_number() OVER (PARTITION BY score < 30 ORDER BY quarter) AS g FROM qt), lg AS (SELECT coalesce(max(c), 0) AS longest FROM (SELECT count(*) AS c FROM lr WHERE low GROUP BY g))"


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_QUARTERS}, {_LONGEST}, s AS (SELECT count(*) AS quarters, CASE WHEN abs(avg(score)) < 1e-6 THEN 'inf'::DOUBLE ELSE stddev_pop(score) / abs(avg(score)) END AS cv, min(score) AS worst FROM qt)
SELECT quarters, longest, {_rounded('cv AS variation', 'worst', '0.5 * CASE WHEN cv >= 0.5 THEN 0 WHEN cv >= 0.25 THEN (0.5 - cv) / 0.25 * 50 WHEN cv >= 0.1 THEN 50 + (0.25 - cv) / 0.15 * 50 ELSE 100 END + 0.3 * CASE WHEN worst <= -10 THEN 0 WHEN worst <= 25 THEN (worst + 10) / 35 * 50 WHEN worst <= 50 THEN 50 + (worst - 25) / 25 * 50 ELSE 100 END + 0.2 * CASE WHEN longest >= 5 THEN 0 WHEN longest >= 2 THEN (5 - longest) / 3 * 50 ELSE 50 + (2 - longest) / 2 * 50 END AS stability', digits=4)} FROM s, lg""", digits=4)
def score_stability(spark, d):
    return scoring.stability_score(_quarters(spark, d))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_QUARTERS}, {_LONGEST}, i AS (SELECT score, row_number() OVER (ORDER BY quarter) AS i, count(*) OVER () AS n, row_number() OVER (ORDER BY score DESC, quarter) AS k FROM qt),
s AS (SELECT max(n) AS n, avg(CASE WHEN i <= n // 2 THEN score END) - avg(CASE WHEN i > n // 2 THEN score END) AS decay, max(score) - median(score) AS gap, avg(CASE WHEN k <= least(n, greatest(3, n // 5)) THEN score END) - median(score) AS head, CASE WHEN abs(avg(score)) < 1e-6 THEN 'inf'::DOUBLE ELSE stddev_pop(score) / abs(avg(score)) END AS cv, min(score) AS worst FROM i),
a AS (SELECT 'performance_decay' AS code, CASE WHEN decay >= 25 THEN 'high' ELSE 'medium' END AS severity FROM s WHERE n >= 4 AND decay >= 15 UNION ALL SELECT 'return_concentration', CASE WHEN gap >= 60 OR head >= 35 THEN 'high' ELSE 'medium' END FROM s WHERE n >= 4 AND (gap >= 45 OR gap >= 30 AND head >= 20)
UNION ALL SELECT 'score_volatility', CASE WHEN cv >= 0.8 THEN 'high' ELSE 'medium' END FROM s WHERE n >= 4 AND cv >= 0.55 UNION ALL SELECT 'prolonged_slump', CASE WHEN longest >= 5 THEN 'high' ELSE 'medium' END FROM s, lg WHERE n >= 4 AND longest >= 3 UNION ALL SELECT 'weak_tail', CASE WHEN worst <= 0 THEN 'high' ELSE 'medium' END FROM s WHERE n >= 4 AND worst <= 10)
SELECT * FROM a""")
def risk_alerts(spark, d):
    return scoring.alerts(_quarters(spark, d))


_FILLS = """fl AS (SELECT l_suppkey AS id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS seq, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::BIGINT AS quantity, l_extendedprice / l_quantity AS price FROM lineitem)"""


def _fills(spark, d):
    line = market.table(spark, d, "lineitem")
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return line.select(F.col("l_suppkey").alias("id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey")).alias("seq"), quantity.alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.to_date("l_shipdate").alias("date"))


@query(f"""{_FILLS}, r AS (SELECT *, sum(greatest(quantity, 0)) OVER h AS b, sum(quantity) OVER h AS n, sum(greatest(-quantity, 0)) OVER h AS s FROM fl WINDOW h AS (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, s - greatest(0, max(-n) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS sold FROM r), t AS (SELECT *, max(sold) OVER (PARTITION BY id) AS total FROM l)
SELECT id, seq, least(quantity, greatest(0, b - total))::BIGINT AS quantity FROM t WHERE quantity > 0 AND b - total > 0""")
def open_lots(spark, d):
    return ledgers.open_lots(_fills(spark, d), ["id"], ["seq"])


@query()
def average_cost_ledger(spark, d):
    """Checked against a loop in the tests."""
    return ledgers.average_cost(_fills(spark, d).withColumn("fee", F.lit(1.0)))


@query("""f AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_partkey % 4 AS product, l_quantity AS lots, l_extendedprice AS amount, CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'close' END AS effect, l_quantity * l_tax * 10 AS today FROM lineitem), r AS (SELECT * FROM (VALUES (0, 'money', 0.0001, 0.0002, 0.0004), (1, 'volume', 1.5, 2.0, 3.0), (2, 'money', 0.00005, 0.00005, 0.0)) t(product, kind, o, c, ct)),
x AS (SELECT f.*, CASE kind WHEN 'money' THEN amount ELSE lots END AS base, CASE WHEN lots <> 0 THEN least(today, lots) / lots ELSE 0 END AS share, o, c, ct FROM f LEFT JOIN r USING (product))
SELECT seq, round(coalesce(CASE effect WHEN 'open' THEN base * o ELSE base * (share * ct + (1 - share) * c) END, 0), 4) AS commission FROM x""", digits=4)
def futures_commissions(spark, d):
    line = market.table(spark, d, "lineitem")
    fills = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 4).alias("product"), F.col("l_quantity").alias("lots"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linestatus") == "O", "open").otherwise("close").alias("effect"), (F.col("l_quantity") * F.col("l_tax") * 10).alias("today"),
    )
    rates = spark.createDataFrame([(0, "money", 0.0001, 0.0002, 0.0004), (1, "volume", 1.5, 2.0, 3.0), (2, "money", 0.00005, 0.00005, 0.0)], "product long, kind string, open_rate double, close_rate double, close_today_rate double")
    return ledgers.futures_fees(fills, rates).select("seq", "commission")


@query(f"""{BARS}, {_FILLS}, t AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END)::BIGINT AS q, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS a FROM lineitem GROUP BY ALL)
SELECT id, date, round(close, 4) AS close, (sum(q) OVER h)::BIGINT AS quantity, round(sum(a) OVER h, 4) AS spent, round(close * (sum(q) OVER h), 4) AS value FROM bars JOIN t USING (id, date) WINDOW h AS (PARTITION BY id ORDER BY date)""", digits=4)
def position_values(spark, d):
    f = _fills(spark, d).withColumn("amount", F.col("quantity") * F.col("price")).withColumn("book", F.lit(1))
    return ledgers.valuation(f, market.bars(spark, d), ["book"]).drop("book")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, l AS (SELECT date, ret < 0 AS low, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY ret < 0 ORDER BY date) AS g FROM port) SELECT coalesce(max(c), 0) AS longest FROM (SELECT count(*) AS c FROM l WHERE low GROUP BY g)""")
def longest_losing_run(spark, d):
    return diagnostics.longest_run(_portfolio(spark, d), F.col("ret") < 0, "date").select("longest")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, e AS (SELECT date, sum(ln(1 + ret)) OVER (ORDER BY date) AS e FROM port), p AS (SELECT *, max(greatest(e, 0)) OVER (ORDER BY date) AS peak, row_number() OVER (ORDER BY date) AS i FROM e), g AS (SELECT *, count_if(e >= peak) OVER (ORDER BY date) AS top FROM p)
SELECT max(c) AS days FROM (SELECT count_if(e < peak) AS c FROM g GROUP BY top)""")
def longest_drawdown(spark, d):
    return portfolio.drawdown_duration(_portfolio(spark, d), "ret")

"""Queries of market regimes, of models of the cross-section's risk and of point-in-time joins, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import features, pointintime, regime, risk
from quantloom.queries import _FACTORS, BARS, FWD, INDUSTRY, WEIGHTS, _industry, _rounded, _top_weights, query
from quantloom.sources import market


def _market(spark, d):
    line = market.table(spark, d, "lineitem").select(
        F.lit(1).alias("market"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amount"),
    )
    return market.roll_up(line, ["market", "date"], "px", "seq", "qty", "amount")


def _breadth(spark, d):
    return features.with_returns(market.bars(spark, d)).groupBy("date").agg(F.count_if(F.col("ret") > 0).alias("advancing"), F.count_if(F.col("ret") < 0).alias("declining"))


def _industry_close(spark, d):
    b = market.bars(spark, d).join(market.instruments(spark, d), "id")
    return b.groupBy("industry", "date").agg((F.sum("turnover") / F.sum("volume")).alias("close"))


def _l(n: int) -> str:
    return f"(ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _f(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {_l(n)} >= {least or n} THEN {agg}({x}) OVER {_l(n)} END"


def _seeded(x: str, n: str, a: float) -> str:
    """Closed form of the recursion over rows numbered from 1 by `n`, whose first value is the seed."""
    return f"(sum(CASE WHEN {n} = 1 THEN {x} ELSE {a!r} * {x} END * pow({1 - a!r}, -{n})) OVER (ORDER BY {n} ROWS UNBOUNDED PRECEDING) * pow({1 - a!r}, {n}))"


def _clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0, least(1, {x})) END"


def _mean_of(parts: dict[str, float]) -> str:
    return f"({' + '.join(f'coalesce({c} * {w}, 0)' for c, w in parts.items())}) / nullif({' + '.join(f'CASE WHEN {c} IS NOT NULL THEN {w} ELSE 0 END' for c, w in parts.items())}, 0)"


_LOGS = [math.log(k) for k in regime.LAGS]
_MID = sum(_LOGS) / len(_LOGS)
_SPREAD = sum((v - _MID) ** 2 for v in _LOGS)
_A = 1 / 14
_MARKET = f"""m0 AS (SELECT date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume FROM line GROUP BY date),
m1 AS (SELECT *, row_number() OVER (ORDER BY date) AS n, lag(close) OVER (ORDER BY date) AS prev, high - lag(high) OVER (ORDER BY date) AS up, lag(low) OVER (ORDER BY date) - low AS dn FROM m0),
m2 AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM m1),
m3 AS (SELECT *, n - 13 AS s, CASE WHEN n = 14 THEN avg(tr) OVER {_l(14)} ELSE tr END AS tr_, CASE WHEN n = 14 THEN avg(pdm) OVER {_l(14)} ELSE pdm END AS p_, CASE WHEN n = 14 THEN avg(mdm) OVER {_l(14)} ELSE mdm END AS m_ FROM m2),
m4 AS (SELECT n, {_seeded('tr_', 's', _A)} AS atr, {_seeded('p_', 's', _A)} AS sp, {_seeded('m_', 's', _A)} AS sm, s FROM m3 WHERE s > 0),
m5 AS (SELECT n, atr, s, CASE WHEN sp + sm > 0 THEN 100 * abs(sp - sm) / (sp + sm) ELSE 0 END AS dx FROM m4), m6 AS (SELECT n, atr, {_seeded('CASE WHEN s = 1 THEN dx / 14 ELSE dx END', 's', _A)} AS adx FROM m5),
m7 AS (SELECT *, {_seeded('close', 'n', 2 / 13)} - {_seeded('close', 'n', 2 / 27)} AS dif FROM m2), m8 AS (SELECT n, dif - {_seeded('dif', 'n', 2 / 10)} AS hist FROM m7),
m9 AS (SELECT m2.*, atr, adx, hist, close / prev - 1 AS ret, volume / nullif(lag(volume) OVER (ORDER BY date), 0) - 1 AS chg, 4 * ({_f('stddev_pop', 'close', 20)}) / ({_f('avg', 'close', 20)}) AS width,
CASE WHEN count(*) OVER {_l(18)} >= 18 THEN covar_pop(high, low) OVER {_l(18)} / nullif(var_pop(low) OVER {_l(18)}, 0) END AS slope, {', '.join(f'close - lag(close, {k}) OVER (ORDER BY date) AS d{k}' for k in regime.LAGS)} FROM m2 LEFT JOIN m6 USING (n) LEFT JOIN m8 USING (n)),
ma AS (SELECT *, CASE WHEN chg IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN chg END AS y, list(width) OVER {_l(60)} AS ws, {' + '.join(f'CASE WHEN stddev_pop(d{k}) OVER {_l(100 - k)} > 0 THEN ln(stddev_pop(d{k}) OVER {_l(100 - k)}) * {(v - _MID) / _SPREAD!r} END' for k, v in zip(regime.LAGS, _LOGS, strict=True))} AS ex FROM m9),
mb AS (SELECT *, CASE WHEN n >= 100 THEN {_clamp('2 * ex')} END AS hurst, CASE WHEN count(x) OVER {_l(20)} >= 16 AND stddev_pop(x) OVER {_l(20)} > 1e-12 AND stddev_pop(y) OVER {_l(20)} > 1e-12 THEN covar_pop(x, y) OVER {_l(20)} / (stddev_pop(x) OVER {_l(20)} * stddev_pop(y) OVER {_l(20)}) END AS pv,
atr / nullif({_f('avg', 'atr', 60)}, 0) AS ar, CASE WHEN n >= 270 THEN (slope - ({_f('avg', 'slope', 252, 202)})) / nullif({_f('stddev_pop', 'slope', 252, 202)}, 0) END AS z, {_f('avg', 'close', 5)} AS a5, {_f('avg', 'close', 20)} AS a20, {_f('avg', 'close', 60)} AS a60, {_f('max', 'close', 60)} AS hi, {_f('min', 'close', 60)} AS lo,
lag(hist) OVER (ORDER BY date) AS h1, lag(hist, 2) OVER (ORDER BY date) AS h2, sign(close / lag(close, 20) OVER (ORDER BY date) - 1) AS return_sign FROM ma),
mc AS (SELECT date, CASE WHEN n >= 16 THEN adx END AS adx, {_clamp('(CASE WHEN n >= 16 THEN adx END - 20) / 15')} AS adx_score, {_clamp('abs(hurst - 0.5) * 2')} AS hurst_score, CASE WHEN width IS NOT NULL THEN len(list_filter(ws, lambda v: v <= width))::DOUBLE / len(list_filter(ws, lambda v: v IS NOT NULL)) END AS width_score,
CASE WHEN n >= 76 THEN {_clamp('(ar - 0.7) / 0.8')} END AS atr_score, {_clamp('pv')} AS volume_score, CASE WHEN a5 > a20 AND a20 > a60 THEN 1.0 WHEN a5 < a20 AND a20 < a60 THEN -1.0 WHEN a60 IS NOT NULL THEN 0.0 END AS arrangement,
CASE WHEN h2 IS NULL THEN NULL WHEN hist > 0 AND h1 > 0 AND h2 > 0 THEN 1.0 WHEN hist < 0 AND h1 < 0 AND h2 < 0 THEN -1.0 ELSE 0.0 END AS macd_sign, return_sign, CASE WHEN hi > lo THEN ({_clamp('(close - lo) / (hi - lo)')}) * 2 - 1 END AS place, sign(z) AS rsrs_sign FROM mb),
md AS (SELECT *, {_mean_of(regime.TREND)} AS trendiness, {_mean_of(regime.DIRECTION)} AS direction FROM mc), me AS (SELECT *, CASE WHEN trendiness IS NULL OR direction IS NULL OR trendiness < 0.45 THEN 'range' WHEN direction > 0.35 THEN 'bull' WHEN direction < -0.35 THEN 'bear' ELSE 'range' END AS label FROM md)"""


@query(f"{BARS}, {_MARKET} SELECT 1 AS market, date, label, {_rounded('adx', *regime.TREND, *regime.DIRECTION, 'trendiness', 'direction', digits=5)} FROM me", digits=5)
def trend_and_direction(spark, d):
    return regime.trend_and_direction(_market(spark, d))


_ROTATION = f"""ic AS (SELECT industry, date, sum(turnover) / sum(volume) AS close FROM bars JOIN inst USING (id) GROUP BY ALL), ir AS (SELECT *, close / lag(close, 5) OVER (PARTITION BY industry ORDER BY date) - 1 AS r FROM ic),
ik AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(r) DESC, industry) AS k FROM ir WHERE r IS NOT NULL), ij AS (SELECT date, count(*) AS n, stddev_pop(r) AS dd, CASE WHEN count(*) > 2 THEN skewness(r) END AS ss, sum(CASE WHEN k <= 3 THEN abs(r) END) / nullif(sum(abs(r)), 0) AS cc FROM ik GROUP BY date),
br AS (SELECT date, count_if(ret > 0)::DOUBLE AS adv, count_if(ret < 0)::DOUBLE AS dec FROM rets GROUP BY date), dy AS (SELECT *, list(dd) OVER {_l(60)} AS ds FROM br LEFT JOIN ij USING (date)),
dz AS (SELECT date, CASE WHEN n >= 5 THEN len(list_filter(ds, lambda v: v <= dd))::DOUBLE / len(list_filter(ds, lambda v: v IS NOT NULL)) END AS dispersion, CASE WHEN n >= 5 AND NOT isnan(ss) THEN {_clamp('abs(ss) / 2')} END AS skew, CASE WHEN n >= 5 THEN {_clamp('(cc - 0.25) / 0.25')} END AS concentration,
CASE WHEN adv > 0 AND dec > 0 THEN {_clamp('1 - abs(ln(adv / dec)) / ln(2)')} END AS neutrality FROM dy), rt AS (SELECT *, {_mean_of(regime.ROTATION)} AS rotation FROM dz), ru AS (SELECT *, CASE WHEN rotation >= 0.4 THEN 'rotation' ELSE 'co_move' END AS structure FROM rt)"""


@query(f"{BARS}, {_ROTATION} SELECT date, structure, {_rounded(*regime.ROTATION, 'rotation', digits=5)} FROM ru", digits=5)
def rotation_structure(spark, d):
    return regime.rotation(_industry_close(spark, d), _breadth(spark, d))


@query(f"""{BARS}, {_MARKET}, {_ROTATION}, j AS (SELECT me.date, label || '_' || coalesce(structure, 'co_move') AS regime, {_clamp("CASE WHEN label <> 'range' THEN trendiness ELSE 1 - trendiness END")} AS a, {_clamp("CASE WHEN structure = 'rotation' THEN rotation ELSE 1 - rotation END")} AS b, trendiness, direction, rotation FROM me LEFT JOIN ru USING (date))
SELECT date, regime, {_rounded('coalesce(sqrt(a * b), 0) AS strength', 'trendiness', 'direction', 'rotation', digits=5)} FROM j""", digits=5)
def market_regimes(spark, d):
    return regime.regimes(regime.trend_and_direction(_market(spark, d)), regime.rotation(_industry_close(spark, d), _breadth(spark, d)))


@query(f"""{BARS}, {INDUSTRY}, dt AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM ind WHERE iret IS NOT NULL)), w AS (SELECT industry, date, iret FROM ind JOIN dt USING (date) WHERE age < 252)
SELECT x.industry AS a, y.industry AS b, count(*) AS n, round(covar_samp(x.iret, y.iret) * CASE WHEN x.industry = y.industry THEN 1 ELSE 0.9 END, 6) AS cov FROM w x JOIN w y USING (date) WHERE x.industry <= y.industry GROUP BY 1, 2 HAVING count(*) >= 20""")
def shrunk_covariance(spark, d):
    return risk.shrunk_covariance(_industry(spark, d), "industry", "iret")


_EWM = """dt AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM ind WHERE iret IS NOT NULL)), w AS (SELECT industry, date, iret, pow(0.5, age / 60) AS w FROM ind JOIN dt USING (date)),
p AS (SELECT x.industry AS a, y.industry AS b, x.w, x.iret AS x, y.iret AS y FROM w x JOIN w y USING (date) WHERE x.industry <= y.industry), ew AS (SELECT a, b, count(*) AS n, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) * sum(w) * sum(w) / nullif(sum(w) * sum(w) - sum(w * w), 0) AS cov FROM p GROUP BY ALL HAVING count(*) >= 20)"""


@query(f"{BARS}, {INDUSTRY}, {_EWM} SELECT a, b, n, round(cov, 6) AS cov FROM ew")
def ewm_covariance(spark, d):
    return risk.ewm_covariance(_industry(spark, d), "industry", "iret")


@query(f"""{BARS}, {INDUSTRY}, dt AS (SELECT date FROM (SELECT DISTINCT date FROM ind WHERE iret IS NOT NULL) ORDER BY date DESC LIMIT 252), ks AS (SELECT DISTINCT industry AS k FROM ind JOIN dt USING (date)), g0 AS (SELECT date, k, coalesce(iret, 0) AS x FROM dt CROSS JOIN ks LEFT JOIN (SELECT date, industry AS k, iret FROM ind) i USING (date, k)),
g AS (SELECT date, k, x - avg(x) OVER (PARTITION BY k) AS x FROM g0), n AS (SELECT count(DISTINCT date)::DOUBLE AS n, count(DISTINCT k)::DOUBLE AS p FROM g), s AS (SELECT x.k AS a, y.k AS b, sum(x.x * y.x) / any_value(n) AS s FROM g x JOIN g y USING (date), n GROUP BY ALL),
f AS (SELECT sum(CASE WHEN a = b THEN s END) / any_value(p) AS mu, sum(s * s) AS ff FROM s, n), d AS (SELECT mu, (SELECT sum(pow(s - CASE WHEN a = b THEN mu ELSE 0 END, 2)) FROM s) / p AS delta, (SELECT sum(o) FROM (SELECT sum(pow(x.x * y.x - s.s, 2)) AS o FROM g x JOIN g y USING (date) JOIN s ON s.a = x.k AND s.b = y.k GROUP BY date)) / (n * n * p) AS beta FROM f, n),
i AS (SELECT mu, CASE WHEN delta = 0 THEN 1 ELSE least(beta, delta) / delta END AS al FROM d)
SELECT a, b, {_rounded('al AS intensity', '(al * CASE WHEN a = b THEN mu ELSE 0 END + (1 - al) * s) * n / (n - 1) AS cov')} FROM s, i, n WHERE a <= b""")
def ledoit_wolf_covariance(spark, d):
    return risk.ledoit_wolf(_industry(spark, d), "industry", "iret")


@query(f"""{BARS}, {FWD}, {INDUSTRY}, {WEIGHTS}, {_EWM}, iw AS (SELECT date, industry AS k, sum(weight) AS v FROM wts JOIN inst USING (id) GROUP BY ALL), pv AS (SELECT x.date, sqrt(greatest(sum(x.v * y.v * cov * CASE WHEN a = b THEN 1 ELSE 2 END), 0) * 252) AS vol FROM ew JOIN iw x ON x.k = a JOIN iw y ON y.k = b AND y.date = x.date GROUP BY x.date)
SELECT date, {_rounded('vol AS volatility', 'CASE WHEN vol > 5 THEN 5 / vol ELSE 1 END AS scale', digits=4)} FROM pv""", digits=4)
def portfolio_volatility(spark, d):
    w = _top_weights(spark, d).join(market.instruments(spark, d), "id").groupBy("date", F.col("industry").alias("k")).agg(F.sum("weight").alias("weight"))
    return risk.volatility(w, risk.ewm_covariance(_industry(spark, d), "industry", "iret"), 5.0)


_LISTED = "ls AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1995-01-01' + (s_suppkey % 400)::INT END AS listed_date FROM supplier)"


def _listed(spark, d):
    s = market.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return s.withColumn("listed_date", F.when(F.col("id") % 5 != 0, F.date_add(F.lit("1995-01-01").cast("date"), (F.col("id") % 400).cast("int"))))


@query(f"{BARS}, {_LISTED} SELECT id, date, {_rounded('close')} FROM bars LEFT JOIN ls USING (id) WHERE listed_date IS NULL OR (date - listed_date)::INT >= 365")
def seasoned_bars(spark, d):
    return pointintime.listed_long_enough(market.bars(spark, d).select("id", "date", "close"), _listed(spark, d), 365)


@query(f"""{BARS}, {_LISTED}, iv AS (SELECT id % 20 AS code, min(id) AS name, min(listed_date) AS listed_date, CASE WHEN min(id) % 3 = 0 THEN DATE '1996-06-01' END AS de FROM ls WHERE listed_date IS NOT NULL GROUP BY 1), pn AS (SELECT id % 20 AS code, id, date FROM bars)
SELECT code, id, date, name FROM pn JOIN iv USING (code) WHERE listed_date <= date AND (de IS NULL OR date < de)""")
def codes_at_date(spark, d):
    """Bars with the instrument that carried their code on the date."""
    iv = _listed(spark, d).where("listed_date is not null").groupBy((F.col("id") % 20).alias("code")).agg(F.min("id").alias("name"), F.min("listed_date").alias("listed_date"))
    iv = iv.withColumn("de_listed_date", F.when(F.col("name") % 3 == 0, F.lit("1996-06-01").cast("date")))
    return pointintime.valid_at(market.bars(spark, d).select((F.col("id") % 20).alias("code"), "id", "date"), iv)


@query(f"""{BARS}, mc AS (SELECT date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS known, sum(o_totalprice) AS macro FROM orders GROUP BY 1) SELECT cal.date, round(macro, 4) AS macro FROM cal ASOF LEFT JOIN mc ON cal.date >= mc.known""", digits=4)
def macro_by_day(spark, d):
    m = market.table(spark, d, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date")).agg(F.sum("o_totalprice").alias("macro"))
    return pointintime.filled(market.calendar(spark, d), m, ["macro"])


@query(f"""{BARS}, mt AS (SELECT id, CASE WHEN id % 2 = 0 THEN industry END AS industry FROM inst) SELECT b.id, date, coalesce(m.industry, CASE WHEN b.id % 3 = 0 THEN 'PANEL' END, 'Unknown') AS industry, 'stock' AS asset_type FROM bars b LEFT JOIN mt m USING (id)""")
def overlaid_metadata(spark, d):
    meta = market.instruments(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("industry")).alias("industry"))
    p = market.bars(spark, d).select("id", "date", F.when(F.col("id") % 3 == 0, "PANEL").alias("industry"))
    return pointintime.overlaid(p, meta, {"industry": "Unknown", "asset_type": "stock"})


@query(f"""{BARS}, cv AS (SELECT date, unnest([0, 30, 90, 365, 730, 3650]) AS tenor_days, bench FROM bench), c2 AS (SELECT date, tenor_days, CASE WHEN tenor_days = 730 THEN NULL ELSE bench / 10000 + tenor_days / 1e6 END AS rate FROM cv), k AS (SELECT * FROM c2 WHERE date <= DATE '1996-01-06' AND rate IS NOT NULL),
l AS (SELECT * FROM k WHERE date = (SELECT max(date) FROM k) AND tenor_days <= 900) SELECT round(arg_max(rate, tenor_days), 6) AS rate, max(tenor_days)::INT AS tenor_days, '1Y' AS tenor FROM l""")
def risk_free_rate(spark, d):
    days = F.array(*(F.lit(n) for n in (0, 30, 90, 365, 730, 3650)))
    c = market.benchmark(spark, d).select("date", "bench", F.explode(days).alias("tenor_days"))
    c = c.select("date", "tenor_days", F.when(F.col("tenor_days") != 730, F.col("bench") / 10000 + F.col("tenor_days") / 1e6).alias("rate"))
    return pointintime.risk_free(c, "1996-01-06", "1998-06-24")


@query(f"""{BARS}, {INDUSTRY}, nm AS (SELECT min(industry) AS a, max(industry) AS b FROM ind), r AS (SELECT date, CASE industry WHEN a THEN 'a' ELSE 'b' END AS k, iret AS ret FROM ind, nm WHERE industry IN (a, b) AND iret IS NOT NULL)
SELECT date, round(sum(CASE k WHEN 'a' THEN 0.6 ELSE 0.4 END * ret) / sum(CASE k WHEN 'a' THEN 0.6 ELSE 0.4 END), 6) AS ret, count(*) = 2 AS complete FROM r GROUP BY date""")
def blended_benchmark(spark, d):
    i = _industry(spark, d)
    ends = i.agg(F.min("industry").alias("_a"), F.max("industry").alias("_b"))
    x = i.crossJoin(F.broadcast(ends)).where("industry in (_a, _b)").select("date", F.when(F.col("industry") == F.col("_a"), "a").otherwise("b").alias("k"), F.col("iret").alias("ret"))  # one row
    return pointintime.blended(x, {"a": 0.6, "b": 0.4})


@query(f"""{BARS}, sh AS (SELECT event_id, ts, (CAST(ts AS DATE) + CASE WHEN hour(ts) >= 20 THEN 1 ELSE 0 END)::DATE AS dd FROM events), cc AS (SELECT (SELECT min(CAST(ts AS DATE)) FROM events) + (date - (SELECT min(date) FROM cal))::INT AS date FROM cal WHERE dayofweek(date) NOT IN (0, 6)), nx AS (SELECT event_id, min(date) AS trading_date FROM sh JOIN cc ON date >= dd AND date < dd + 40 GROUP BY 1)
SELECT event_id, trading_date FROM sh LEFT JOIN nx USING (event_id) WHERE trading_date IS NOT NULL""")
def event_trading_days(spark, d):
    """Trading date of each event, evenings counted to the next one, on a calendar moved to the events."""
    ev = market.table(spark, d, "events").select("event_id", "ts")
    first = ev.agg(F.min(F.to_date("ts")).alias("_e"))
    cal = market.calendar(spark, d)
    start = cal.agg(F.min("date").alias("_c"))
    moved = cal.where(~F.dayofweek("date").isin(1, 7)).crossJoin(F.broadcast(first)).crossJoin(F.broadcast(start)).select(F.expr("date_add(_e, datediff(date, _c))").alias("date"))  # one row each
    return pointintime.trading_day(ev, moved).where("trading_date is not null").select("event_id", "trading_date")


@query(f"{BARS}, {_FACTORS}, p AS (SELECT id, date, close, lag(close) OVER h * lag(f) OVER h / f AS previous_close FROM adj WINDOW h AS (PARTITION BY id ORDER BY date)) SELECT id, date, {_rounded('close', 'previous_close')} FROM p")
def previous_closes(spark, d):
    return pointintime.previous_close(market.bars(spark, d), market.ex_factors(spark, d))


@query(f"{BARS} SELECT date, seq::INT AS seq FROM cal WHERE (seq - 1) % 20 = 0")
def rebalance_days(spark, d):
    return pointintime.rebalance_days(market.calendar(spark, d), 20)


@query(f"""{BARS}, k AS (SELECT DISTINCT o_custkey AS book, CAST(o_orderdate AS DATE) AS date FROM orders), h AS (SELECT *, lag(date) OVER (PARTITION BY book ORDER BY date) AS last, row_number() OVER (PARTITION BY book ORDER BY date) % 4 AS holdings FROM k), j AS (SELECT h.*, a.seq AS s, b.seq AS t FROM h LEFT JOIN cal a ON a.date = h.date LEFT JOIN cal b ON b.date = h.last)
SELECT book, date, last AS last_rebalance, holdings::INT AS holdings, (s - t)::INT AS days_since, CASE WHEN t IS NULL OR holdings = 0 OR coalesce(s - t >= 20, false) THEN 0 ELSE 20 - (s - t) END::INT AS days_left, CASE WHEN t IS NULL OR holdings = 0 THEN true ELSE s - t >= 20 END AS due FROM j""")
def rebalance_due(spark, d):
    """Each customer's order days as visits to a portfolio last rebalanced at the visit before, empty on every fourth."""
    w = Window.partitionBy("book").orderBy("date")
    k = market.table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.to_date("o_orderdate").alias("date")).distinct()
    books = k.withColumn("last_rebalance", F.lag("date").over(w)).withColumn("holdings", F.row_number().over(w) % 4)
    return pointintime.rebalance_due(books, market.calendar(spark, d), 20)


@query(f"""{BARS}, l AS (SELECT 'bars' AS source, max(date) AS last FROM bars UNION ALL SELECT 'early', max(date) FROM bars WHERE date < DATE '1998-01-01' UNION ALL SELECT 'near', max(date) FROM cal WHERE seq <= (SELECT max(seq) FROM cal) - 4), g AS (SELECT source, last, ((SELECT max(seq) FROM cal) - seq)::INT AS days FROM l JOIN cal ON date = last)
SELECT source, last, days, CASE WHEN days > 5 THEN 'expired' WHEN days > 3 THEN 'stale' ELSE 'fresh' END AS state FROM g""")
def source_freshness(spark, d):
    b, c = market.bars(spark, d), market.calendar(spark, d)
    last = c.agg(F.max("seq").alias("_m"))
    return pointintime.freshness({"bars": b, "early": b.where("date < '1998-01-01'"), "near": c.crossJoin(F.broadcast(last)).where("seq <= _m - 4")}, c)  # one row


@query(f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, date_trunc('month', date) ORDER BY date DESC) AS k FROM bars) SELECT id, date_trunc('month', date)::DATE AS month, date, {_rounded('close')} FROM r WHERE k = 1""")
def last_of_month(spark, d):
    b = market.bars(spark, d).select("id", F.trunc("date", "month").alias("month"), "date", "close")
    return pointintime.deduplicated(b, ["id", "month"], "date")


@query()
def bars_fingerprint(spark, d):
    """Digest of all bars; equal for any order of the rows, checked in the tests."""
    return pointintime.fingerprint(market.bars(spark, d))

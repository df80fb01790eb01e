"""Every operator as a query over the driver's tables, and the SQL that must give the same rows.

Doubles are rounded to 6 digits on both sides; windows have total orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import cross_section, diagnostics, evaluation, features, labels, panel, portfolio
from quantloom.plans import research
from quantloom.sources import market
from quantloom.streaming import ticks as tick_ops

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Common table expressions of the SQL versions.
BARS = """line AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS px, l_orderkey * 10 + l_linenumber AS k, l_quantity AS q, l_extendedprice AS m FROM lineitem),
bars AS (SELECT id, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume, sum(m) AS turnover FROM line GROUP BY id, date),
rets AS (SELECT *, close / lag(close) OVER h - 1 AS ret, lag(close) OVER h AS prev FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT date FROM line)),
bench AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS bench FROM lineitem GROUP BY 1),
inst AS (SELECT s_suppkey AS id, n_name AS industry, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
FWD = """fwd AS (SELECT id, date, lead(close, 2) OVER h / lead(close, 1) OVER h - 1 AS fwd1, lead(close, 6) OVER h / lead(close, 1) OVER h - 1 AS fwd5, lead(close, 11) OVER h / lead(close, 1) OVER h - 1 AS fwd10,
lead(date, 1) OVER h AS entry_date, lead(date, 11) OVER h AS exit_date,
CASE WHEN count(ret) OVER f >= 10 THEN stddev_samp(ret) OVER f END AS fwd_vol
FROM rets WINDOW h AS (PARTITION BY id ORDER BY date), f AS (PARTITION BY id ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 11 FOLLOWING)),
sig AS (SELECT *, -(close / lag(close, 5) OVER h - 1) AS reversal, close / lag(close, 20) OVER h - 1 AS mom20 FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)),
pan AS (SELECT sig.*, fwd1, fwd5, fwd10 FROM sig JOIN fwd USING (id, date))"""
INDUSTRY = """ind AS (SELECT industry, date, avg(ret) AS iret FROM rets JOIN inst USING (id) WHERE ret IS NOT NULL GROUP BY industry, date)"""
WEIGHTS = """top AS (SELECT date, id, mom20, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, id) AS r FROM sig WHERE mom20 IS NOT NULL),
wts AS (SELECT date, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM top WHERE r <= 10)"""


def w(n: int) -> str:
    return f"(PARTITION BY id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {n if least is None else least} THEN {agg}({x}) OVER {w(n)} END"


def _half_away(c: str, digits: int) -> Column:
    """Rounded as SQL engines round binary doubles, so that both sides agree on ties such as 0.0000005; `F.round` goes by the decimal form."""
    x, unit = F.col(c), 10.0**digits
    small = F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit
    return F.when(F.abs(x) * unit < 2.0**52, small).otherwise(x * unit / unit)  # beyond, the scaled double is whole


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query; all its double columns are rounded."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(_half_away(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = f"WITH {sql}"
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {digits}) AS {n.split(' AS ')[-1]}" for n in names)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query(f"{BARS} SELECT id, date, {_rounded('open', 'high', 'low', 'close', 'volume', 'turnover')} FROM bars")
def day_bars(spark, d):
    return market.bars(spark, d)


@query(f"{BARS} SELECT id, min(date) AS first, max(date) AS last, count(*) AS n FROM bars GROUP BY id")
def date_ranges(spark, d):
    return market.bars(spark, d).groupBy("id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


@query(f"""{BARS}, wk AS (SELECT id, CAST(date_trunc('week', date + 2) + INTERVAL 4 DAY AS DATE) AS week, * EXCLUDE (id) FROM bars),
lab AS (SELECT CAST(date_trunc('week', date + 2) + INTERVAL 4 DAY AS DATE) AS week, max(date) AS label FROM cal GROUP BY 1)
SELECT id, label AS date, {_rounded('arg_min(open, date) AS open', 'max(high) AS high', 'min(low) AS low', 'arg_max(close, date) AS close', 'sum(volume) AS volume')}, count(*) AS days FROM wk JOIN lab USING (week) GROUP BY id, week, label""")
def weekly_bars(spark, d):
    return panel.weekly(market.bars(spark, d), market.calendar(spark, d))


@query(f"""{BARS}, p AS (SELECT date, seq::INT AS seq, coalesce(lag(date, 3) OVER (ORDER BY date), (SELECT min(date) FROM cal)) AS prev, coalesce(lead(date, 3) OVER (ORDER BY date), (SELECT max(date) FROM cal)) AS next,
row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY date)::INT AS week_day, row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY date DESC)::INT AS week_day_back,
row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date)::INT AS month_day, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC)::INT AS month_day_back FROM cal) SELECT * FROM p""")
def trading_days(spark, d):
    return panel.neighbours(market.calendar(spark, d), 3)


@query(f"""{BARS}, s AS (SELECT id, seq, lag(seq) OVER (PARTITION BY id ORDER BY seq) AS b FROM bars JOIN cal USING (date))
SELECT id, (b + 1)::INT AS first_seq, (seq - 1)::INT AS last_seq, (seq - b - 1)::INT AS days FROM s WHERE seq > b + 1""")
def missing_day_runs(spark, d):
    return panel.missing_runs(market.bars(spark, d), market.calendar(spark, d))


_FACTORS = """fac AS (SELECT DISTINCT l_suppkey AS id, CAST(l_shipdate AS DATE) AS ex_date FROM lineitem WHERE l_orderkey % 97 = 0),
fx AS (SELECT *, pow(1.1, row_number() OVER (PARTITION BY id ORDER BY ex_date)) AS factor FROM fac),
adj AS (SELECT b.*, coalesce(fx.factor, 1.0) AS f FROM bars b ASOF LEFT JOIN fx ON b.id = fx.id AND b.date >= fx.ex_date)"""


@query(f"{BARS}, {_FACTORS} SELECT id, date, {_rounded('open * f AS open', 'high * f AS high', 'low * f AS low', 'close * f AS close', 'volume / f AS volume', 'f')} FROM adj", digits=6)
def bars_post_adjusted(spark, d):
    return panel.adjusted(market.bars(spark, d), market.ex_factors(spark, d))


@query(f"""{BARS}, {_FACTORS}, o AS (SELECT id, arg_max(factor, ex_date) AS base FROM fx WHERE ex_date <= DATE '1995-06-30' GROUP BY id), g AS (SELECT adj.* EXCLUDE (f), f / coalesce(base, 1.0) AS f FROM adj LEFT JOIN o USING (id))
SELECT id, date, {_rounded('open * f AS open', 'high * f AS high', 'low * f AS low', 'close * f AS close', 'volume / f AS volume', 'f')} FROM g""")
def bars_pre_adjusted(spark, d):
    return panel.adjusted(market.bars(spark, d), market.ex_factors(spark, d), "pre", "1995-06-30")


@query(f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC)::INT AS back FROM bars)
SELECT id, date, {_rounded('close', 'volume')}, back FROM r WHERE back <= 5""")
def last_five_bars(spark, d):
    return panel.last_bars(market.bars(spark, d), 5).select("id", "date", "close", "volume", "back")


@query(f"""{BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS back FROM bars)
SELECT id, {_rounded('avg(turnover) AS mean_turnover', 'median(volume) AS median_volume')}, count(*) AS n FROM r WHERE back <= 60 AND date > (SELECT max(date) FROM bars) - 120 GROUP BY id HAVING count(*) >= 30 ORDER BY avg(turnover) DESC, id LIMIT 50""", digits=6)
def liquid_universe(spark, d):
    return panel.liquid(market.bars(spark, d), 60, 50)


@query(f"""{BARS}, k AS (SELECT count(*) AS repeated_keys FROM (SELECT 1 FROM bars GROUP BY id, date HAVING count(*) > 1))
SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT date) AS dates, count_if(close IS NULL)::BIGINT AS missing, count_if(close <= 0)::BIGINT AS not_positive, count_if(abs(ret) > 0.5)::BIGINT AS jumps, any_value(repeated_keys) AS repeated_keys FROM rets, k""")
def data_quality(spark, d):
    return panel.quality(market.bars(spark, d))


@query(f"""{BARS} SELECT id, date, {_rounded(
    'close - lag(close, 10) OVER h AS mom', 'close / lag(close, 10) OVER h - 1 AS roc', f"close / ({full('avg', 'close', 6)}) - 1 AS bias", '-(close / lag(close, 5) OVER h - 1) AS reversal',
    'close / lag(close, 20) OVER h - 1 AS mom20', 'close / lag(close, 40) OVER h - 1 AS mom40', 'close / lag(close, 60) OVER h - 1 AS mom60', f"close / ({full('avg', 'close', 20)}) - 1 AS ma_gap20", f"close / ({full('avg', 'close', 60)}) - 1 AS ma_gap60",
    f"({full('avg', 'close', 10)}) / ({full('avg', 'close', 40)}) - 1 AS ma_cross", *(f"coalesce((close - ({full('min', 'close', n)})) / nullif(({full('max', 'close', n)}) - ({full('min', 'close', n)}), 0), 0.5) AS place{n}" for n in (20, 60)), f"close / ({full('max', 'close', 60)}) - 1 AS to_high60")} FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)""")
def factors_momentum(spark, d):
    return features.momentum(market.bars(spark, d))


@query(f"""{BARS}, p AS (SELECT *, CASE WHEN ret IS NOT NULL THEN pow(least(ret, 0), 2) END AS down, {full('max', 'close', 20)} AS peak FROM rets), q AS (SELECT *, close / peak - 1 AS dd, {full('stddev_pop', 'close', 20)} AS sd, {full('avg', 'close', 20)} AS mid, {full('max', 'high', 20)} AS hi, {full('min', 'low', 20)} AS lo FROM p)
SELECT id, date, {_rounded(f"({full('stddev_samp', 'ret', 20)}) * sqrt(252) AS vol20", f"sqrt(({full('avg', 'down', 20)}) * 252) AS down_vol20", f"{full('skewness', 'ret', 20)} AS skew20", f"{full('min', 'dd', 20)} AS drawdown20",
    'mid + 2 * sd AS boll_up', 'mid AS boll_mid', 'mid - 2 * sd AS boll_low', '4 * sd / mid AS boll_width', 'hi AS don_up', 'lo AS don_low', '(hi + lo) / 2 AS don_mid')} FROM q""")
def factors_volatility(spark, d):
    return features.volatility(market.bars(spark, d))


@query(f"""{BARS}, p AS (SELECT *, (high + low + close) / 3 AS typical, coalesce(sign(close - prev), 0) * volume AS signed, abs(ret) / greatest(turnover, 1) AS impact FROM rets),
q AS (SELECT *, typical - lag(typical) OVER (PARTITION BY id ORDER BY date) AS rise, typical * volume AS flow FROM p),
r AS (SELECT *, sum(CASE WHEN rise > 0 THEN flow ELSE 0 END) OVER {w(14)} AS up, sum(CASE WHEN rise < 0 THEN flow ELSE 0 END) OVER {w(14)} AS dn, greatest(turnover, 1) AS proxy, sum(signed) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM q)
SELECT id, date, {_rounded(f"volume / ({full('avg', 'volume', 20)}) AS volume_ratio", f"({full('avg', 'volume', 5)}) / ({full('avg', 'volume', 20)}) - 1 AS volume_trend", f"proxy / ({full('avg', 'proxy', 20)}) AS turnover_ratio", f"({full('avg', 'proxy', 20)}) / nullif({full('stddev_samp', 'proxy', 20)}, 0) AS turnover_stability",
    f"ln(1 + ({full('avg', 'proxy', 20)})) AS log_turnover", f"ln(1 + ({full('avg', 'proxy', 20)})) / nullif(({full('stddev_samp', 'ret', 20)}) * sqrt(252), 0) AS vol_turnover", f"({full('avg', 'impact', 20)}) * 1e6 AS amihud", 'obv', f"{full('avg', 'obv', 20)} AS obv_mean", f"CASE WHEN count(*) OVER {w(14)} >= 14 THEN 100 - 100 / (1 + up / nullif(dn, 0)) END AS mfi")} FROM r""")
def factors_liquidity(spark, d):
    return features.liquidity(market.bars(spark, d))


@query(f"""{BARS}, p AS (SELECT *, (high + low + close) / 3 AS typical, ({full('avg', 'high', 18)}) / ({full('avg', 'low', 18)}) AS rsrs FROM bars), q AS (SELECT *, {full('avg', 'typical', 20)} AS ma FROM p), r AS (SELECT *, abs(typical - ma) AS away FROM q)
SELECT id, date, {_rounded(f"(typical - ma) / nullif(0.015 * ({full('avg', 'away', 20)}), 0) AS cci", 'rsrs', f"(rsrs - ({full('avg', 'rsrs', 600)})) / nullif({full('stddev_pop', 'rsrs', 600)}, 0) AS rsrs_z")} FROM r""")
def factors_oscillators(spark, d):
    return features.oscillators(market.bars(spark, d))


@query(f"""{BARS}, p AS (SELECT *, CASE WHEN count(*) OVER {w(18)} >= 18 THEN covar_pop(high, low) OVER {w(18)} / nullif(var_pop(low) OVER {w(18)}, 0) END AS slope, volume / nullif(lag(volume) OVER (PARTITION BY id ORDER BY date), 0) - 1 AS change,
4 * ({full('stddev_pop', 'close', 20)}) / ({full('avg', 'close', 20)}) AS width FROM rets), q AS (SELECT *, CASE WHEN change IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN change END AS y, list(width) OVER {w(60)} AS ws FROM p),
r AS (SELECT *, stddev_pop(x) OVER {w(20)} * stddev_pop(y) OVER {w(20)} AS sxy FROM q)
SELECT id, date, {_rounded('slope', f"(slope - ({full('avg', 'slope', 252, 202)})) / nullif({full('stddev_pop', 'slope', 252, 202)}, 0) AS slope_z", f"CASE WHEN count(x) OVER {w(20)} >= 16 AND sxy > 1e-12 THEN covar_pop(x, y) OVER {w(20)} / sxy END AS pv_corr", 'CASE WHEN width IS NOT NULL THEN len(list_filter(ws, lambda v: v <= width))::DOUBLE / len(list_filter(ws, lambda v: v IS NOT NULL)) END AS width_pct')} FROM r""")
def factors_regression(spark, d):
    return features.regression_slope(market.bars(spark, d))


@query(f"""{BARS}, b AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS bret, bench / lag(bench, 20) OVER (ORDER BY date) - 1 AS bmom20, bench / lag(bench, 60) OVER (ORDER BY date) - 1 AS bmom60 FROM bench),
p AS (SELECT *, CASE WHEN bret IS NOT NULL THEN ret END AS x, CASE WHEN ret IS NOT NULL THEN bret END AS y FROM rets JOIN b USING (date))
SELECT id, date, {_rounded(f"CASE WHEN count(x) OVER {w(60)} >= 60 THEN covar_samp(x, y) OVER {w(60)} / nullif(var_samp(y) OVER {w(60)}, 0) END AS beta", *(f'close / lag(close, {n}) OVER (PARTITION BY id ORDER BY date) - 1 - bmom{n} AS excess_mom{n}' for n in (20, 60)))} FROM p""")
def factors_beta(spark, d):
    return features.beta(market.bars(spark, d), market.benchmark(spark, d))


def _ema(x: str, a: float, n: str = "n", key: str = "id") -> str:
    """Closed form of the recursion from its first value, by powers of 1 - a."""
    r = 1 - a
    return f"(sum(CASE WHEN {n} = 1 THEN {x} ELSE {a!r} * {x} END * pow({r!r}, -{n})) OVER (PARTITION BY {key} ORDER BY {n} ROWS UNBOUNDED PRECEDING) * pow({r!r}, {n}))"


@query(f"""{BARS}, p AS (SELECT id, date, row_number() OVER (PARTITION BY id ORDER BY date) AS n, close, prev, greatest(close - prev, 0) AS gain, greatest(prev - close, 0) AS loss, CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS rng,
greatest(coalesce(high - lag(high) OVER (PARTITION BY id ORDER BY date), 0), 0) AS up, greatest(coalesce(lag(low) OVER (PARTITION BY id ORDER BY date) - low, 0), 0) AS down, 100 * (close - ({full('min', 'low', 9)})) / nullif(({full('max', 'high', 9)}) - ({full('min', 'low', 9)}), 0) AS rsv FROM rets),
g AS (SELECT id, date, n - 1 AS m, gain, loss FROM p WHERE n > 1), g2 AS (SELECT id, date, m, {_ema('gain', 1 / 14, 'm')} AS g, {_ema('loss', 1 / 14, 'm')} AS l FROM g),
e AS (SELECT *, {_ema('rng', 1 / 14)} AS atr, {_ema('up', 1 / 14)} AS pu, {_ema('down', 1 / 14)} AS pd, {_ema('close', 2 / 13)} AS e12, {_ema('close', 2 / 27)} AS e26 FROM p), f AS (SELECT *, e12 - e26 AS dif, n - 13 AS n14, n - 8 AS n9, 100 * abs(pu - pd) / nullif(pu + pd, 0) AS dx FROM e),
m AS (SELECT *, {_ema('dif', 2 / 10)} AS dea FROM f), x AS (SELECT id, date, n14, {_ema('dx', 1 / 14, 'n14')} AS adx FROM f WHERE n14 > 0), kk AS (SELECT id, date, n9, {_ema('rsv', 1 / 3, 'n9')} AS k FROM f WHERE n9 > 0), kd AS (SELECT id, date, k, {_ema('k', 1 / 3, 'n9')} AS d FROM kk)
SELECT m.id, m.date, {_rounded('CASE WHEN g2.m >= 14 THEN 100 - 100 / (1 + g / nullif(l, 0)) END AS rsi', 'CASE WHEN n >= 14 THEN atr END AS atr', 'e12', 'e26', '2 * (dif - dea) AS macd', 'CASE WHEN x.n14 >= 14 THEN adx END AS adx', 'k', 'd', '3 * k - 2 * d AS j', digits=4)} FROM m LEFT JOIN g2 ON m.id = g2.id AND m.date = g2.date LEFT JOIN x ON m.id = x.id AND m.date = x.date LEFT JOIN kd ON m.id = kd.id AND m.date = kd.date""", digits=4)
def factors_smoothed(spark, d):
    return features.smoothed(market.bars(spark, d))


@query(f"""{BARS}, p AS (SELECT *, list(ret) OVER {w(730)} AS ls FROM rets), q AS (SELECT id, date, ret, list_filter(ls, lambda v: v IS NOT NULL) AS ls FROM p)
SELECT id, date, round(CASE WHEN ret IS NOT NULL AND len(ls) >= 1 THEN (len(list_filter(ls, lambda v: v < ret)) + (len(list_filter(ls, lambda v: v = ret)) + 1) / 2 - 0.5) / len(ls) END, 6) AS pct FROM q""")
def return_percentile(spark, d):
    return features.percentile_of_last(features.with_returns(market.bars(spark, d)), "ret", 730, 1)


@query(f"""{BARS}, p AS (SELECT *, ({full('avg', 'close', 5)}) - ({full('avg', 'close', 20)}) AS gap,
CASE WHEN count(high) OVER a >= 55 THEN max(high) OVER a END AS top, CASE WHEN count(low) OVER b >= 20 THEN min(low) OVER b END AS bottom,
CASE WHEN count(high) OVER c >= 2 THEN greatest(max(high) OVER c - min(close) OVER c, max(close) OVER c - min(low) OVER c) END AS span FROM bars
WINDOW a AS (PARTITION BY id ORDER BY date ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), c AS (PARTITION BY id ORDER BY date ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, lag(gap) OVER (PARTITION BY id ORDER BY date) AS was FROM p)
SELECT id, date, CASE WHEN gap > 0 AND was <= 0 THEN 1 WHEN gap < 0 AND was >= 0 THEN -1 ELSE 0 END AS "cross", CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END AS breakout, {_rounded('open + 0.5 * span AS buy_above', 'open - 0.5 * span AS sell_below')} FROM q""")
def crossing_signals(spark, d):
    return features.crossings(market.bars(spark, d))


@query(f"{BARS}, {FWD} SELECT id, date, {_rounded('fwd1', 'fwd5', 'fwd10', 'fwd_vol')}, entry_date, exit_date FROM fwd")
def forward_labels(spark, d):
    return labels.forward_returns(market.bars(spark, d))


@query(f"""{BARS}, bb AS (SELECT date, lead(bench, 20) OVER (ORDER BY date) / bench - 1 AS b FROM bench), x AS (SELECT *, lead(close, 20) OVER h / close - 1 AS fwd, stddev_samp(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 2 FOLLOWING AND 20 FOLLOWING) * sqrt(252) AS v, list(close) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS n FROM rets WINDOW h AS (PARTITION BY id ORDER BY date))
SELECT id, date, {_rounded('fwd - b AS excess', 'CASE WHEN len(n) = 20 THEN v END AS volatility', 'CASE WHEN len(n) = 20 THEN list_max(list_transform(range(1, 21), lambda j: 1 - n[j] / list_max(n[1:j]))) END AS fall')} FROM x LEFT JOIN bb USING (date)""")
def horizon_labels(spark, d):
    return labels.horizon_labels(market.bars(spark, d), market.benchmark(spark, d), 20)


@query(f"""{BARS}, {FWD}, e AS (SELECT date, quantile_cont(fwd5, 0.05) AS lo, quantile_cont(fwd5, 0.95) AS hi FROM fwd GROUP BY date),
c AS (SELECT id, date, industry, CASE WHEN fwd5 IS NOT NULL THEN greatest(lo, least(hi, fwd5)) END AS cut FROM fwd JOIN e USING (date) JOIN inst USING (id))
SELECT id, date, round(cut - CASE WHEN count(cut) OVER g >= 3 THEN avg(cut) OVER g ELSE avg(cut) OVER dd END, 6) AS relative FROM c WINDOW g AS (PARTITION BY date, industry), dd AS (PARTITION BY date)""")
def peer_label(spark, d):
    df = labels.forward_returns(market.bars(spark, d)).join(market.instruments(spark, d), "id")
    return labels.peer_relative(df, "fwd5", "industry").select("id", "date", "relative")


@query(f"""{BARS}, n AS (SELECT max(seq) AS n FROM cal), s AS (SELECT unnest(range(0, n - 360 + 1, 60)) AS a FROM n WHERE n >= 360),
f AS (SELECT (a // 60 + 1)::INT AS fold, 'train' AS part, a + 1 AS first, a + 250 AS last FROM s UNION ALL SELECT (a // 60 + 1)::INT, 'valid', a + 256, a + 300 FROM s UNION ALL SELECT (a // 60 + 1)::INT, 'test', a + 306, a + 360 FROM s)
SELECT fold, part, date FROM f JOIN cal ON seq BETWEEN first AND last""")
def walk_forward_days(spark, d):
    cal = market.calendar(spark, d)
    return labels.fold_days(cal, labels.folds(cal, 250, 45, 55, 5, 60))


@query(f"""{BARS}, {FWD}, m AS (SELECT date, median(mom20) AS mid FROM sig GROUP BY date), a AS (SELECT id, date, mom20, mid FROM sig JOIN m USING (date)), v AS (SELECT date, median(abs(mom20 - mid)) AS mad FROM a GROUP BY date),
c AS (SELECT id, date, CASE WHEN mom20 IS NOT NULL THEN greatest(mid - 5 * 1.4826 * mad, least(mid + 5 * 1.4826 * mad, mom20)) END AS winsorised FROM a JOIN v USING (date))
SELECT id, date, {_rounded('winsorised', '(winsorised - avg(winsorised) OVER d) / nullif(stddev_samp(winsorised) OVER d, 0) AS z')} FROM c WINDOW d AS (PARTITION BY date)""")
def winsorised_signal(spark, d):
    return cross_section.winsorised(features.momentum(market.bars(spark, d)), "mom20", ["date"]).select("id", "date", "winsorised", "z")


@query(f"""{BARS}, {FWD}, p AS (SELECT id, date, industry, mom20, ln(close) AS c FROM sig JOIN inst USING (id) WHERE mom20 IS NOT NULL AND close > 0),
q AS (SELECT id, date, mom20 - avg(mom20) OVER g AS y, c - avg(c) OVER g AS c FROM p WINDOW g AS (PARTITION BY date, industry)), r AS (SELECT *, coalesce(sum(y * c) OVER d / nullif(sum(c * c) OVER d, 0), 0) AS slope, count(*) OVER d AS n FROM q WINDOW d AS (PARTITION BY date))
SELECT id, date, round(CASE WHEN n >= 5 THEN y - slope * c END, 6) AS neutral FROM r""")
def neutral_signal(spark, d):
    df = features.momentum(market.bars(spark, d)).join(market.bars(spark, d).select("id", "date", "close"), ["id", "date"]).join(market.instruments(spark, d), "id")
    return cross_section.neutralised(df, "mom20", "industry", "close").select("id", "date", "neutral")


_RANKS = """both_ AS (SELECT date, id, reversal, fwd5 FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY reversal) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, fwd5) - 1) / 2.0 AS b,
row_number() OVER (PARTITION BY date ORDER BY reversal DESC, id) AS t, row_number() OVER (PARTITION BY date ORDER BY reversal, id) AS u FROM both_),
ic0 AS (SELECT date, count(*) AS n, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk GROUP BY date HAVING count(*) >= 5),
sp AS (SELECT date, avg(CASE WHEN t <= 5 THEN fwd5 END) - avg(CASE WHEN u <= 5 THEN fwd5 END) AS spread, avg(CASE WHEN t <= 5 THEN (fwd5 > 0)::INT END) AS hit_rate FROM rk GROUP BY date)"""


@query(f"{BARS}, {FWD}, {_RANKS} SELECT date, round(ic, 6) AS ic, n FROM ic0")
def rank_ic_by_date(spark, d):
    return evaluation.rank_ic(research.panel(market.bars(spark, d)), "reversal", "fwd5")


@query(f"{BARS}, {FWD}, {_RANKS} SELECT date, {_rounded('spread', 'hit_rate')} FROM sp")
def spread_by_date(spark, d):
    return evaluation.spread(research.panel(market.bars(spark, d)), "reversal", "fwd5", 5)


@query(f"{BARS}, {FWD}, {_RANKS} SELECT count(ic) AS dates, {_rounded('avg(ic) AS ic_mean', 'avg(ic) / nullif(stddev_pop(ic), 0) AS ic_ir', 'avg(spread) AS spread_mean', 'avg(hit_rate) AS hit_rate')} FROM ic0 JOIN sp USING (date)")
def signal_quality(spark, d):
    return research.signal_quality(market.bars(spark, d))


@query(f"""{BARS}, {FWD}, x AS (SELECT *, CASE WHEN reversal IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY reversal NULLS LAST) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0) / count(reversal) OVER (PARTITION BY date) END AS pct FROM pan),
y AS (SELECT *, least(ceil(pct * 5), 5)::INT AS bucket FROM x)
SELECT b AS bucket, count(fwd5) AS n, {_rounded('avg(fwd5) AS mean', 'median(fwd5) AS median', 'avg((fwd5 > 0)::INT) AS win_rate', 'quantile_cont(fwd5, 0.1) AS q10', 'quantile_cont(fwd5, 0.25) AS q25', 'quantile_cont(fwd5, 0.5) AS q50', 'quantile_cont(fwd5, 0.75) AS q75', 'quantile_cont(fwd5, 0.9) AS q90')} FROM (SELECT unnest(range(1, 6))::INT AS b) LEFT JOIN y ON bucket = b AND fwd5 IS NOT NULL GROUP BY b""")
def bucket_calibration(spark, d):
    return evaluation.bucket_returns(cross_section.ranked(research.panel(market.bars(spark, d)), "reversal", ["date"]), "bucket", "fwd5", 5)


def _top_weights(spark, d):
    best = cross_section.top_bottom(features.momentum(market.bars(spark, d)), "mom20", 10).where("from_top <= 10")
    return best.select("date", "id", (F.lit(1.0) / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, n AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM wts)), a AS (SELECT n, id, weight FROM wts JOIN n USING (date)),
j AS (SELECT coalesce(x.n, y.n + 1) AS n, coalesce(x.weight, 0) AS a, coalesce(y.weight, 0) AS b FROM a x FULL JOIN a y ON x.n = y.n + 1 AND x.id = y.id)
SELECT date, {_rounded('sum(abs(a - b)) / 2 AS turnover', 'count_if(a > 0 AND b > 0)::DOUBLE / count_if(a > 0 OR b > 0) AS overlap')} FROM j JOIN n USING (n) GROUP BY date""")
def portfolio_turnover(spark, d):
    return evaluation.turnover(_top_weights(spark, d))


_PORT = """port AS (SELECT w.date, sum(weight * fwd1) AS ret FROM wts w JOIN fwd USING (id, date) WHERE fwd1 IS NOT NULL GROUP BY w.date)"""


def _portfolio(spark, d):
    returns = labels.forward_returns(market.bars(spark, d)).select("id", "date", "fwd1").where("fwd1 is not null")
    return _top_weights(spark, d).join(returns, ["id", "date"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("fwd1")).alias("ret"))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, e AS (SELECT date, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM port), p AS (SELECT *, greatest(1, max(equity) OVER (ORDER BY date)) AS peak FROM e)
SELECT date, {_rounded('ln(equity) AS log_equity', 'equity / peak - 1 AS drawdown')} FROM p""")
def equity_curve(spark, d):
    e = evaluation.equity(_portfolio(spark, d).withColumn("book", F.lit(1)), "ret", ["book"])
    return e.select("date", F.ln("equity").alias("log_equity"), "drawdown")


@query(f"""{BARS}, b AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS bret FROM bench), x AS (SELECT id, ret, bret, ret - bret AS ex FROM rets JOIN b USING (date) WHERE ret IS NOT NULL AND bret IS NOT NULL)
SELECT id, count(*) AS days, {_rounded('exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS annual_return', 'stddev_samp(ret) * sqrt(252) AS annual_vol', 'avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe', 'avg(ret) / nullif(sqrt(avg(pow(least(ret, 0), 2))), 0) * sqrt(252) AS sortino',
    'covar_samp(ret, bret) / nullif(var_samp(bret), 0) AS beta', '(avg(ret) - covar_samp(ret, bret) / nullif(var_samp(bret), 0) * avg(bret)) * 252 AS alpha', 'stddev_samp(ex) * sqrt(252) AS tracking_error', 'avg(ex) / nullif(stddev_samp(ex), 0) * sqrt(252) AS info_ratio', 'quantile_cont(ret, 0.05) AS var5', 'avg((ret > 0)::INT) AS win_rate')} FROM x GROUP BY id""")
def risk_summary(spark, d):
    b = market.benchmark(spark, d).withColumn("bret", R.ratio(F.col("bench"), F.lag("bench").over(Window.orderBy("date"))) - 1).select("date", "bret")
    return evaluation.performance(features.with_returns(market.bars(spark, d)).join(b, "date"), "ret", "bret", ["id"])


def _industry(spark, d):
    df = features.with_returns(market.bars(spark, d)).where("ret is not null").join(market.instruments(spark, d), "id")
    return df.groupBy("industry", "date").agg(F.avg("ret").alias("iret"))


@query(f"{BARS}, {INDUSTRY} SELECT x.industry AS a, y.industry AS b, count(*) AS n, {_rounded('covar_samp(x.iret, y.iret) AS cov', 'corr(x.iret, y.iret) AS corr')} FROM ind x JOIN ind y USING (date) WHERE x.industry <= y.industry GROUP BY 1, 2 HAVING count(*) >= 20")
def industry_covariance(spark, d):
    return evaluation.pair_correlations(_industry(spark, d), "industry", "iret")


@query(f"{BARS}, {INDUSTRY}, c AS (SELECT x.industry AS a, y.industry AS b, corr(x.iret, y.iret) AS c FROM ind x JOIN ind y USING (date) WHERE x.industry <= y.industry GROUP BY 1, 2 HAVING count(*) >= 20) SELECT count_if(a = b)::BIGINT AS series, round(pow(count_if(a = b), 2) / sum(c * c * CASE WHEN a = b THEN 1 ELSE 2 END), 6) AS breadth FROM c")
def effective_breadth(spark, d):
    pairs = evaluation.pair_correlations(_industry(spark, d), "industry", "iret")
    same = F.col("a") == F.col("b")
    return pairs.agg(F.count_if(same).alias("series"), (F.pow(F.count_if(same), 2) / F.sum(F.col("corr") * F.col("corr") * F.when(same, 1).otherwise(2))).alias("breadth"))


@query(f"""{BARS}, {INDUSTRY}, x AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY iret DESC, industry) AS t FROM ind)
SELECT date, count(*) AS n, {_rounded('stddev_pop(iret) AS dispersion', 'count_if(iret > 0)::DOUBLE / count(*) AS advancing', 'avg(CASE WHEN t <= 3 THEN iret END) - avg(iret) AS top3')} FROM x GROUP BY date""")
def industry_rotation(spark, d):
    df = _industry(spark, d).withColumn("t", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("iret"), "industry")))
    return df.groupBy("date").agg(F.count("*").alias("n"), F.stddev_pop("iret").alias("dispersion"), (F.count_if(F.col("iret") > 0) / F.count("*")).alias("advancing"), (F.avg(F.when(F.col("t") <= 3, F.col("iret"))) - F.avg("iret")).alias("top3"))


@query(f"""{BARS}, {FWD}, {WEIGHTS} SELECT date, industry, sector, round(sum(weight), 6) AS exposure, grouping_id(date, industry, sector)::BIGINT AS level FROM wts JOIN inst USING (id) GROUP BY GROUPING SETS ((date, industry, sector), (date, sector), (date))""")
def exposure_ledger(spark, d):
    df = _top_weights(spark, d).join(market.instruments(spark, d), "id")
    return df.groupingSets([["date", "industry", "sector"], ["date", "sector"], ["date"]], "date", "industry", "sector").agg(F.sum("weight").alias("exposure"), F.grouping_id("date", "industry", "sector").alias("level"))


@query("""t AS (SELECT o_custkey AS account, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side, o_totalprice AS amount FROM orders WHERE o_orderstatus IN ('F', 'O')),
p AS (SELECT *, greatest(sum(amount * 0.0001) OVER w, 5) AS paid FROM t WINDOW w AS (PARTITION BY account, date ORDER BY order_id ROWS UNBOUNDED PRECEDING))
SELECT account, order_id, date, side, round(paid - coalesce(lag(paid) OVER (PARTITION BY account, date ORDER BY order_id), 0), 6) AS commission, round(CASE WHEN side = 'SELL' THEN amount * CASE WHEN date < DATE '2023-08-28' THEN 0.001 ELSE 0.0005 END ELSE 0 END, 6) AS tax FROM p""")
def trade_fees(spark, d):
    return panel.order_fees(market.trades(spark, d).withColumn("day", F.col("date")), 0.0001, 5.0).select("account", "order_id", "date", "side", "commission", "tax")


@query("""t AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS s, o_totalprice AS amount FROM orders)
SELECT date_trunc('month', date)::DATE AS month, count(*) AS orders, count_if(s = 'F')::BIGINT AS buys, count_if(s = 'O')::BIGINT AS sells, round(avg(amount), 4) AS mean_value, round(median(amount), 4) AS median_value, round(max(amount), 4) AS max_value, round(count(*)::DOUBLE / count(DISTINCT date), 4) AS per_day FROM t GROUP BY 1""", digits=4)
def order_statistics(spark, d):
    t = market.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("amount"))
    return t.groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("orders"), F.count_if(F.col("s") == "F").alias("buys"), F.count_if(F.col("s") == "O").alias("sells"), F.avg("amount").alias("mean_value"), F.median("amount").alias("median_value"), F.max("amount").alias("max_value"), (F.count("*") / F.countDistinct("date")).alias("per_day"))


@query("""t AS (SELECT user_id AS id, date_trunc('hour', ts) AS start, value, (ts, event_id) AS k FROM events)
SELECT id, start, round(arg_min(value, k), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, k), 6) AS close, count(*) AS n FROM t GROUP BY id, start""")
def hourly_tick_bars(spark, d):
    return tick_ops.tick_bars(market.ticks(spark, d))


@query("""t AS (SELECT user_id AS id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut, event_id FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM t)
SELECT id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY id, session""", digits=4)
def tick_sessions(spark, d):
    return tick_ops.sessions(market.ticks(spark, d))


@query(f"""{BARS}, n AS (SELECT s_suppkey AS id, CAST(o_orderdate AS DATE) AS date, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE sum(o_totalprice) END AS close, count(*)::DOUBLE AS volume FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier) GROUP BY ALL)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.date, n.date) AS date, round(coalesce(n.close, o.close), 6) AS close, round(coalesce(n.volume, o.volume), 6) AS volume FROM bars o FULL JOIN n ON o.id = n.id AND o.date = n.date""")
def field_upsert(spark, d):
    """Day totals of all orders upserted into all bars."""
    s = market.table(spark, d, "supplier").select("s_suppkey")
    of = s.agg(F.count("*").alias("_n"))
    o = market.table(spark, d, "orders").crossJoin(F.broadcast(of)).withColumn("s_suppkey", F.col("o_custkey") % F.col("_n"))  # one row
    new = o.join(s, "s_suppkey").groupBy(F.col("s_suppkey").alias("id"), F.to_date("o_orderdate").alias("date"))
    new = new.agg(F.when(F.count("*") % 3 != 0, F.sum("o_totalprice")).alias("close"), F.count("*").cast("double").alias("volume"))
    return panel.upserted(market.bars(spark, d).select("id", "date", "close", "volume"), new, ["id", "date"])


@query(f"""{BARS}, c AS (SELECT id, date_trunc('month', date)::DATE AS month, arg_max(close, date) AS nav FROM bars GROUP BY 1, 2)
SELECT id, month, {_rounded('nav', 'nav / lag(nav) OVER (PARTITION BY id ORDER BY month) - 1 AS ret')} FROM c""")
def monthly_nav(spark, d):
    m = market.bars(spark, d).groupBy("id", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("nav"))
    return m.withColumn("ret", R.ratio(F.col("nav"), F.lag("nav").over(R.history(order="month"))) - 1)


@query("""f AS (SELECT o_custkey AS account, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey AS account, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT p.account, p.date, p.l_orderkey, p.l_linenumber, p.l_partkey, p.l_suppkey, round(f.amount, 4) AS last_amount FROM p ASOF LEFT JOIN f ON p.account = f.account AND p.date > f.date""", digits=4)
def point_in_time_orders(spark, d):
    """The account's latest day total of orders known the day before each shipped line."""
    o = market.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    facts = o.groupBy("account", F.date_add("date", 1).alias("visible")).agg(F.sum("o_totalprice").alias("last_amount"))
    lines = market.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"))
    probes = lines.join(o.select("o_orderkey", "account"), lines["l_orderkey"] == F.col("o_orderkey")).drop("o_orderkey")
    return R.asof(probes, facts, ["account"], "date", "visible", ["last_amount"])


@query(f"""{BARS} SELECT id, date, {_rounded(f'avg(close) OVER {w(5)} AS mavg', f'coalesce(sum(close * volume) OVER {w(5)} / nullif(sum(volume) OVER {w(5)}, 0), 0) AS vwap')} FROM bars""")
def trailing_averages(spark, d):
    n = R.last_n(5)
    vwap = F.coalesce(R.ratio(F.sum(F.col("close") * F.col("volume")).over(n), F.sum("volume").over(n)), F.lit(0.0))
    return market.bars(spark, d).select("id", "date", F.avg("close").over(n).alias("mavg"), vwap.alias("vwap"))


_TURN = """n AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM wts)), a AS (SELECT n, id, weight FROM wts JOIN n USING (date)),
j AS (SELECT coalesce(x.n, y.n + 1) AS n, coalesce(x.weight, 0) AS a, coalesce(y.weight, 0) AS b FROM a x FULL JOIN a y ON x.n = y.n + 1 AND x.id = y.id),
trn AS (SELECT date, sum(abs(a - b)) / 2 AS turnover, count_if(a > 0 AND b > 0)::DOUBLE / count_if(a > 0 OR b > 0) AS overlap FROM j JOIN n USING (n) GROUP BY date)"""


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_TURN}, g AS (SELECT avg(turnover) AS t, avg(ret) AS g, avg(ret - turnover * 0.002) AS n FROM port JOIN trn USING (date))
SELECT {_rounded('t * 252 AS annual_turnover', 't AS mean_turnover', 't * 0.002 * 252 AS annual_drag', "CASE WHEN abs(g) <= 1e-12 THEN 0 WHEN g > 0 THEN 1 - n / g ELSE 'inf'::DOUBLE END AS erosion", 'n AS net_mean', 'CASE WHEN t > 1e-12 AND g > 0 THEN g / t * 10000 ELSE 0 END AS breakeven_bps')} FROM g""")
def cost_layer(spark, d):
    return portfolio.cost_summary(_portfolio(spark, d).join(evaluation.turnover(_top_weights(spark, d)), "date"), 0.002)


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_TURN}, e AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS equity FROM port), p AS (SELECT *, equity / greatest(1, max(equity) OVER (ORDER BY date)) - 1 AS drawdown FROM e)
SELECT {_rounded('avg(ret) AS mean_return', 'min(drawdown) AS max_drawdown', 'stddev_pop(ret) * sqrt(252) AS volatility', 'avg(ret) / nullif(stddev_pop(ret), 0) AS ir', 'avg(turnover) AS turnover', 'avg(overlap) AS overlap')} FROM p JOIN trn USING (date)""")
def portfolio_summary(spark, d):
    curve = evaluation.equity(_portfolio(spark, d).withColumn("book", F.lit(1)), "ret", ["book"])
    return portfolio.summary(curve.join(evaluation.turnover(_top_weights(spark, d)), "date"))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, p AS (SELECT year(date)::INT AS year, month(date) AS m, ln(1 + ret) AS g FROM port)
SELECT year, {', '.join(f'round(exp(sum(CASE WHEN m = {k} THEN g END)) - 1, 6) AS m{k:02d}' for k in range(1, 13))}, round(exp(sum(g)) - 1, 6) AS total FROM p GROUP BY year""")
def monthly_returns(spark, d):
    return portfolio.calendar_returns(_portfolio(spark, d), "ret")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, x AS (SELECT date, industry, sum(weight) AS w FROM wts JOIN inst USING (id) GROUP BY 1, 2)
SELECT date, count(*) AS n, {_rounded('avg(w) AS mean', 'stddev_samp(w) AS std', 'min(w) AS lo', 'quantile_cont(w, 0.25) AS q25', 'quantile_cont(w, 0.5) AS q50', 'quantile_cont(w, 0.75) AS q75', 'max(w) AS hi')} FROM x GROUP BY date""")
def weight_distribution(spark, d):
    x = _top_weights(spark, d).join(market.instruments(spark, d), "id").groupBy("date", "industry").agg(F.sum("weight").alias("w"))
    q = F.percentile("w", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = x.groupBy("date").agg(F.count("*").alias("n"), F.avg("w").alias("mean"), F.stddev_samp("w").alias("std"), F.min("w").alias("lo"), F.max("w").alias("hi"), q.alias("q"))
    return g.select("date", "n", "mean", "std", "lo", "hi", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))))


@query(f"""{BARS}, p AS (SELECT date, close / first_value(close) OVER (PARTITION BY id ORDER BY date) AS rel, volume FROM bars) SELECT date, {_rounded('avg(rel) * 100 AS close', 'sum(volume) AS volume')} FROM p GROUP BY date""")
def equal_weight_index(spark, d):
    rel = F.col("close") / F.first("close", ignorenulls=True).over(R.history().rowsBetween(Window.unboundedPreceding, 0))
    return market.bars(spark, d).select("date", rel.alias("rel"), "volume").groupBy("date").agg((F.avg("rel") * 100).alias("close"), F.sum("volume").alias("volume"))


@query(f"""{BARS}, {FWD}, s AS (SELECT date, min(mom20) AS lo, max(mom20) AS hi, avg(mom20) AS mean, stddev_pop(mom20) AS std, quantile_cont(mom20, 0.05) AS p05, quantile_cont(mom20, 0.5) AS p50, quantile_cont(mom20, 0.95) AS p95 FROM sig WHERE mom20 IS NOT NULL GROUP BY date), t AS (SELECT *, p95 - p50 AS lead FROM s)
SELECT {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS {c}_p50' for c in ('lo', 'hi', 'mean', 'p05', 'p50', 'p95'))}, {', '.join(f'round(quantile_cont({c}, {p / 100}), 6) AS {c}_p{p:02d}' for c in ('std', 'lead') for p in (1, 5))}, count(*) AS n_days FROM t""")
def score_sanity(spark, d):
    return diagnostics.score_ranges(features.momentum(market.bars(spark, d)), "mom20")


_LONG = "lng AS (SELECT date, id, 'mom20' AS feature, mom20 AS v, fwd5 FROM pan UNION ALL SELECT date, id, 'reversal', reversal, fwd5 FROM pan)"


@query(f"""{BARS}, {FWD}, {_LONG}, ok AS (SELECT * FROM lng WHERE v IS NOT NULL AND fwd5 IS NOT NULL), rk AS (SELECT feature, date, rank() OVER (PARTITION BY feature, date ORDER BY v) + (count(*) OVER (PARTITION BY feature, date, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature, date ORDER BY fwd5) + (count(*) OVER (PARTITION BY feature, date, fwd5) - 1) / 2.0 AS b FROM ok),
i AS (SELECT feature, corr(a, b) AS ic FROM rk GROUP BY feature, date HAVING count(*) >= 10) SELECT feature, count(*) AS dates, {_rounded('avg(ic) AS ic_mean', 'stddev_pop(ic) AS ic_std', 'coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0) AS ic_ir')} FROM i WHERE ic IS NOT NULL AND NOT isnan(ic) GROUP BY feature""")
def factor_ic_table(spark, d):
    return diagnostics.factor_ic(research.panel(market.bars(spark, d)), ["mom20", "reversal"], "fwd5")


@query(f"""{BARS}, {FWD}, v AS (SELECT id, date, mom20, reversal, volume FROM sig), pr AS (SELECT date, 'mom20' AS a, 'reversal' AS b, mom20 AS x, reversal AS y FROM v UNION ALL SELECT date, 'mom20', 'volume', mom20, volume FROM v UNION ALL SELECT date, 'reversal', 'volume', reversal, volume FROM v),
cnt AS (SELECT date FROM v GROUP BY date HAVING count(*) >= 20), ok AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL), rk AS (SELECT a, b, date, rank() OVER (PARTITION BY a, b, date ORDER BY x) + (count(*) OVER (PARTITION BY a, b, date, x) - 1) / 2.0 AS p, rank() OVER (PARTITION BY a, b, date ORDER BY y) + (count(*) OVER (PARTITION BY a, b, date, y) - 1) / 2.0 AS q FROM ok),
c AS (SELECT a, b, date, corr(p, q) AS c FROM rk GROUP BY a, b, date), k AS (SELECT DISTINCT a, b FROM pr)
SELECT a, b, count(*) AS dates, round(avg(CASE WHEN c IS NULL OR isnan(c) THEN 0 ELSE c END), 6) AS agreement FROM cnt CROSS JOIN k LEFT JOIN c USING (a, b, date) GROUP BY a, b""")
def factor_agreement(spark, d):
    b = market.bars(spark, d)
    return diagnostics.rank_agreement(features.momentum(b).join(b.select("id", "date", "volume"), ["id", "date"]), ["mom20", "reversal", "volume"])


@query(f"""{BARS}, {FWD}, l AS (SELECT 'mom20' AS feature, mom20 AS v FROM sig UNION ALL SELECT 'reversal', reversal FROM sig) SELECT feature, count(*) AS n, count_if(v IS NULL)::BIGINT AS missing, round(count_if(v IS NULL)::DOUBLE / count(*), 6) AS share FROM l GROUP BY feature""")
def feature_missingness(spark, d):
    return diagnostics.missingness(features.momentum(market.bars(spark, d)), ["mom20", "reversal"])


@query(f"""{BARS}, {FWD} SELECT id, date, concat_ws(',', CASE WHEN mom20 IS NULL THEN 'mom20' END, CASE WHEN reversal IS NULL THEN 'reversal' END) AS reasons FROM sig WHERE mom20 IS NULL OR reversal IS NULL""")
def incomplete_rows(spark, d):
    df = features.momentum(market.bars(spark, d)).withColumn("reasons", diagnostics.missing_reasons(["mom20", "reversal"]))
    return df.where(F.size("reasons") > 0).select("id", "date", F.array_join("reasons", ",").alias("reasons"))


@query(f"""{BARS}, {FWD}, m AS (SELECT date, median(mom20) AS a, median(volume) AS b FROM sig GROUP BY date) SELECT id, date, {_rounded('mom20', 'volume')} FROM sig JOIN m USING (date) WHERE (a IS NULL OR mom20 > a) AND (b IS NULL OR volume > b)""")
def above_median(spark, d):
    b = market.bars(spark, d)
    df = features.momentum(b).select("id", "date", "mom20").join(b.select("id", "date", "volume"), ["id", "date"])
    return diagnostics.above_median(df, ["mom20", "volume"])


@query(f"""{BARS}, p AS (SELECT id, date, (volume - ({full('avg', 'volume', 60, 20)})) / nullif({full('stddev_pop', 'volume', 60, 20)}, 0) AS z FROM bars) SELECT id, date, round(greatest(-4, least(4, coalesce(z, 0))), 6) AS z FROM p""")
def volume_zscore(spark, d):
    z = R.ratio(F.col("volume") - R.mean("volume", 60, 20), R.std0("volume", 60, 20))
    return market.bars(spark, d).select("id", "date", R.clip(F.coalesce(z, F.lit(0.0)), -4.0, 4.0).alias("z"))


@query(f"""{BARS}, b AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS bret FROM bench), x AS (SELECT id, date, bret - ret AS s FROM rets JOIN b USING (date) WHERE ret IS NOT NULL AND bret IS NOT NULL), y AS (SELECT id, {full('sum', 's', 20)} AS t FROM x) SELECT id, round(max(t), 6) AS shortfall FROM y GROUP BY id""")
def worst_shortfall(spark, d):
    b = market.benchmark(spark, d).withColumn("bret", R.ratio(F.col("bench"), F.lag("bench").over(Window.orderBy("date"))) - 1).select("date", "bret")
    return portfolio.worst_shortfall(features.with_returns(market.bars(spark, d)).join(b, "date"), "ret", "bret")


@query(f"""{BARS}, p AS (SELECT id, date, close, max(close) OVER h AS peak FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)), q AS (SELECT id, date, close / peak - 1 AS dd, max(CASE WHEN close = peak THEN date END) OVER (PARTITION BY id ORDER BY date) AS peak_at FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dd, date) AS k FROM q)
SELECT id, peak_at AS peak_date, date AS trough_date, round(dd, 6) AS drawdown FROM r WHERE k = 1""")
def drawdown_intervals(spark, d):
    return portfolio.drawdown_interval(market.bars(spark, d), "close")


@query(f"""{BARS} SELECT id, date, {_rounded('lead(open, 1) OVER h AS execution_price', 'ret')}, lead(date, 1) OVER h AS execution_date, coalesce(abs(ret) > 0.2, false) AS jump FROM rets WINDOW h AS (PARTITION BY id ORDER BY date)""")
def execution_prices(spark, d):
    h = R.history()
    df = features.with_returns(market.bars(spark, d))
    return df.select("id", "date", F.lead("open").over(h).alias("execution_price"), "ret", F.lead("date").over(h).alias("execution_date"), F.coalesce(F.abs("ret") > 0.2, F.lit(False)).alias("jump"))


@query(f"""{BARS}, s AS (SELECT a.id, date, a.close - b.close AS spread FROM bars a JOIN bars b USING (date) WHERE b.id = a.id + 1)
SELECT id, date, {_rounded('spread', f"({full('avg', 'spread', 60)}) - 2 * ({full('stddev_pop', 'spread', 60)}) AS low", f"({full('avg', 'spread', 60)}) + 2 * ({full('stddev_pop', 'spread', 60)}) AS high")} FROM s""")
def pair_bands(spark, d):
    b = market.bars(spark, d).select("id", "date", "close")
    other = b.select((F.col("id") - 1).alias("id"), "date", F.col("close").alias("other"))
    s = b.join(other, ["id", "date"]).withColumn("spread", F.col("close") - F.col("other"))
    mid, half = R.mean("spread", 60), 2 * R.std0("spread", 60)
    return s.select("id", "date", "spread", (mid - half).alias("low"), (mid + half).alias("high"))


@query("""t AS (SELECT user_id AS id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1) SELECT id, ts, round(last, 6) AS last, n FROM t""")
def tick_snapshot(spark, d):
    return market.ticks(spark, d).groupBy("id").agg(F.max("ts").alias("ts"), F.max_by("price", F.struct("ts", "event_id")).alias("last"), F.count("*").alias("n"))


@query(f"""{BARS}, r AS (SELECT id, date, close, row_number() OVER b AS k, first(close) OVER b AS now FROM bars WINDOW b AS (PARTITION BY id ORDER BY date DESC)) SELECT id, round(max(now), 6) AS value, round(CASE WHEN count(*) >= 20 THEN avg((close <= now)::INT) END, 6) AS percentile FROM r WHERE k <= 252 GROUP BY id""")
def latest_percentile(spark, d):
    return features.latest_percentile(market.bars(spark, d), "close")


@query(f"""{BARS}, r AS (SELECT id, date, close, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS k FROM bars), d AS (SELECT id, lag, close - lag(close, lag::INT) OVER (PARTITION BY id, lag ORDER BY date) AS v FROM r, range(2, 21) AS g(lag) WHERE k <= 100),
s AS (SELECT id, lag, count(*) AS n, stddev_pop(v) AS sd FROM d GROUP BY id, lag) SELECT id, CASE WHEN min(n) >= 100 AND min(sd) > 0 THEN round(greatest(0, least(1, 2 * regr_slope(ln(nullif(sd, 0)), ln(lag)))), 6) END AS hurst FROM s GROUP BY id""")
def hurst_exponent(spark, d):
    return features.hurst(market.bars(spark, d), "close")


@query(f"""{BARS}, v AS (SELECT *, close * volume AS dv, coalesce(abs(ret), 0) / nullif(close * volume, 0) AS impact FROM rets), f AS (SELECT id, date, close / lag(close, 5) OVER h - 1 AS momentum5, {', '.join(f'{full("stddev_samp", "ret", n, k)} AS vol{n}' for n, k in ((5, 2), (10, 3), (20, 5), (60, 10)))}, ln(1 + dv) AS dollar_volume,
greatest(0, least(1, coalesce({full('avg', 'dv', 20, 3)}, 0) / 5e6)) AS liquidity, coalesce({full('avg', 'impact', 20, 5)}, 0) AS illiquidity, coalesce({full('skewness', 'ret', 20, 5)}, 0) AS skew FROM v WINDOW h AS (PARTITION BY id ORDER BY date))
SELECT id, date, {_rounded('momentum5', 'vol5', 'vol10', 'vol20', 'vol60', 'dollar_volume', 'liquidity', 'coalesce(vol20, 0) AS risk', '0.0001 + (1 - liquidity) * 0.0015 AS cost', 'illiquidity', 'skew')} FROM f""")
def common_factors(spark, d):
    return features.common(market.bars(spark, d), full_liquidity=5e6)


@query(f"""{BARS}, {FWD}, {WEIGHTS}, b AS (SELECT date, id, turnover / sum(turnover) OVER (PARTITION BY date) AS share FROM bars), j AS (SELECT date, weight, share FROM wts FULL JOIN b USING (date, id)) SELECT date, round(sum(abs(coalesce(weight, 0) - coalesce(share, 0))) / 2, 6) AS active_share FROM j GROUP BY date HAVING count(weight) > 0 AND count(share) > 0""")
def active_share(spark, d):
    share = R.ratio(F.col("turnover"), F.sum("turnover").over(Window.partitionBy("date")))
    return portfolio.active_share(_top_weights(spark, d), market.bars(spark, d).select("date", "id", share.alias("weight")))


@query(f"""{BARS}, {FWD}, g AS (SELECT date, sum(CASE WHEN mom20 IS NULL THEN 0 ELSE greatest(0, least(1, mom20)) END / 10) AS g FROM sig GROUP BY date) SELECT {_rounded('avg(g) AS gross_mean', 'max(g) AS gross_max', 'avg((g > 1e-12)::INT) AS active_days', 'avg((g <= 1e-12)::INT) AS idle_days', 'avg(greatest(1 - g, 0)) AS mean_cash')} FROM g""")
def activity(spark, d):
    return portfolio.activity(features.momentum(market.bars(spark, d)).select("date", (R.clip(F.col("mom20"), 0.0, 1.0) / 10).alias("weight")))


@query("""b AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem GROUP BY 1), r AS (SELECT year(date) AS fold, px / lag(px) OVER (ORDER BY date) - 1 AS ret FROM b), ok AS (SELECT * FROM r WHERE ret IS NOT NULL), f AS (SELECT fold, avg(ret) AS m FROM ok GROUP BY fold)
SELECT count_if(ret > 0)::BIGINT AS up_periods, count_if(ret <= 0)::BIGINT AS down_periods, round(coalesce(sum(ret) FILTER (ret > 0), 0), 6) AS up_total, round(coalesce(sum(ret) FILTER (ret <= 0), 0), 6) AS down_total, (SELECT count_if(m > 0)::BIGINT FROM f) AS positive_folds, (SELECT count(*) FROM f) AS folds,
round(coalesce(avg(ret) FILTER (ret > 0), 0), 6) AS up_mean, round(coalesce(avg(ret) FILTER (ret <= 0), 0), 6) AS down_mean FROM ok""")
def up_down_periods(spark, d):
    days = market.benchmark(spark, d).withColumn("ret", R.ratio(F.col("bench"), F.lag("bench").over(Window.orderBy("date"))) - 1)
    return portfolio.up_down(days.withColumn("fold", F.year("date")), "ret", "fold")

"""Queries of models, of cross-section transforms, of signals and of styles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.models import baselines
from quantloom.operators import cross_section, features, labels, styles
from quantloom.plans import research
from quantloom.queries import BARS, FWD, _ema, _rounded, full, query, w
from quantloom.sources import market
from quantloom.sources.shared import written

_XY = "xy AS MATERIALIZED (SELECT date, id, reversal, mom20, fwd5 AS y FROM pan WHERE reversal IS NOT NULL AND mom20 IS NOT NULL AND fwd5 IS NOT NULL), tr AS MATERIALIZED (SELECT * FROM xy WHERE date < DATE '1996-01-01'), te AS MATERIALIZED (SELECT * FROM xy WHERE date >= DATE '1996-01-01')"


def _split(spark, d):
    p = research.panel(market.bars(spark, d)).where("reversal is not null and mom20 is not null and fwd5 is not null").select("date", "id", "reversal", "mom20", F.col("fwd5").alias("y"))
    p = written(p, "panel")  # fits and predictions read it several times
    return p.where("date < '1996-01-01'"), p.where("date >= '1996-01-01'")


@query(f"""{BARS}, {FWD}, {_XY}, m AS MATERIALIZED (SELECT avg(reversal) AS a, avg(mom20) AS b, avg(y) AS c, var_pop(reversal) AS aa, var_pop(mom20) AS bb, covar_pop(reversal, mom20) AS ab, covar_pop(reversal, y) AS ay, covar_pop(mom20, y) AS byy FROM tr), k AS MATERIALIZED (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS k1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS k2 FROM m)
SELECT date, id, round(c - k1 * a - k2 * b + k1 * reversal + k2 * mom20, 5) AS prediction FROM te, k""", digits=5)
def linear_baseline(spark, d):
    train, test = _split(spark, d)
    return baselines.linear(test, baselines.least_squares(train, ["reversal", "mom20"], "y")).select("date", "id", "prediction")


_Q = ", ".join(f"{(i + 1) / 51!r}" for i in range(50))


@query(f"""{BARS}, {FWD}, {_XY}, e AS (SELECT 1 AS o, unnest(quantile_cont(reversal, [{_Q}])) AS t FROM tr UNION SELECT 2, unnest(quantile_cont(mom20, [{_Q}])) FROM tr), s AS (SELECT o, t, count_if(x <= t) AS n, sum(CASE WHEN x <= t THEN y END) AS s, count(*) AS n1, sum(y) AS s1 FROM e JOIN (SELECT 1 AS o, reversal AS x, y FROM tr UNION ALL SELECT 2, mom20, y FROM tr) USING (o) GROUP BY o, t),
b AS (SELECT *, s / n AS l, (s1 - s) / (n1 - n) AS r FROM s WHERE n > 0 AND n < n1 ORDER BY s * s / n + (s1 - s) * (s1 - s) / (n1 - n) DESC, o, t LIMIT 1)
SELECT date, id, round(CASE WHEN CASE o WHEN 1 THEN reversal ELSE mom20 END <= t THEN l ELSE r END, 5) AS prediction FROM te, b""", digits=5)
def one_split_baseline(spark, d):
    train, test = _split(spark, d)
    return baselines.split_prediction(test, baselines.one_split(train, ["reversal", "mom20"], "y")).select("date", "id", "prediction")


@query()
def boosted_trees(spark, d):
    """Checked in the tests for its error against the mean."""
    train, test = _split(spark, d)
    model = baselines.boosted(train, ["reversal", "mom20"], "y", F.col("date") >= "1995-07-01", trees=5)
    return baselines.predicted(test, model, ["reversal", "mom20"]).select("date", "id", "prediction")


@query(f"""{BARS}, {FWD}, h AS MATERIALIZED (SELECT date, id, reversal, fwd1, fwd5 FROM pan WHERE reversal IS NOT NULL), t1 AS MATERIALIZED (SELECT covar_pop(reversal, fwd1) / var_pop(reversal) AS k, avg(fwd1) - covar_pop(reversal, fwd1) / var_pop(reversal) * avg(reversal) AS c FROM h WHERE date < DATE '1996-01-01' AND fwd1 IS NOT NULL), t5 AS MATERIALIZED (SELECT covar_pop(reversal, fwd5) / var_pop(reversal) AS k, avg(fwd5) - covar_pop(reversal, fwd5) / var_pop(reversal) * avg(reversal) AS c FROM h WHERE date < DATE '1996-01-01' AND fwd5 IS NOT NULL)
SELECT date, id, round(t1.c + t1.k * reversal, 5) AS head_fwd1, round(t5.c + t5.k * reversal, 5) AS head_fwd5 FROM h, t1, t5 WHERE date >= DATE '1996-01-01'""", digits=5)
def model_heads(spark, d):
    p = written(research.panel(market.bars(spark, d)).where("reversal is not null").select("date", "id", "reversal", "fwd1", "fwd5"), "panel")  # each fit reads it
    out = baselines.heads(p.where("date < '1996-01-01'"), p.where("date >= '1996-01-01'"), ["reversal"], ["fwd1", "fwd5"])
    return out.select("date", "id", "head_fwd1", "head_fwd5")


@query(f"""{BARS}, {FWD}, n AS (SELECT max(seq) AS n FROM cal), s AS (SELECT unnest(range(0, n - 720 + 1, 400)) AS a FROM n WHERE n >= 720), f AS (SELECT (a // 400 + 1)::INT AS fold, a + 1 AS t0, a + 500 AS t1, a + 606 AS v0, a + 720 AS v1 FROM s), x AS MATERIALIZED (SELECT p.*, seq FROM pan p JOIN cal USING (date)),
d AS MATERIALIZED (SELECT fold, unnest(range(t0, t1 + 1)) AS seq FROM f), e AS MATERIALIZED (SELECT fold, unnest(range(v0, v1 + 1)) AS seq FROM f), m AS MATERIALIZED (SELECT fold, covar_pop(reversal, fwd5) / var_pop(reversal) AS k, avg(fwd5) - covar_pop(reversal, fwd5) / var_pop(reversal) * avg(reversal) AS c FROM d JOIN x USING (seq) WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL GROUP BY fold)
SELECT fold, date, id, round(c + k * reversal, 5) AS prediction FROM e JOIN m USING (fold) JOIN x USING (seq) WHERE reversal IS NOT NULL""", digits=5)
def walk_forward_predictions(spark, d):
    cal = market.calendar(spark, d)
    folds = labels.fold_days(cal, labels.folds(cal, 500, 95, 115, 5, 400))
    p = research.panel(market.bars(spark, d)).select("date", "id", "reversal", "fwd5")
    return baselines.walk_forward(p, folds, ["reversal"], "fwd5").select("fold", "date", "id", "prediction")


_PCT = "(rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date)"


@query(f"""{BARS}, {FWD}, r AS (SELECT date, id, {_PCT.format('reversal')} AS a, {_PCT.format('mom20')} AS b FROM pan WHERE reversal IS NOT NULL AND mom20 IS NOT NULL) SELECT date, id, {_rounded('(a + b) / 2 AS blend', 'greatest(0, 1 - 2 * abs(a - b) / 2) AS reliability')} FROM r""")
def blended_predictions(spark, d):
    p = research.panel(market.bars(spark, d)).where("reversal is not null and mom20 is not null").select("date", "id", "reversal", "mom20")
    return baselines.confidence(p, ["reversal", "mom20"]).select("date", "id", "blend", "reliability")


@query(f"""{BARS}, {FWD}, x AS (SELECT date, id, fwd5, {_PCT.format('fwd5')} AS p FROM fwd WHERE fwd5 IS NOT NULL), q AS (SELECT *, median(fwd5) OVER (PARTITION BY date) AS mid, quantile_cont(fwd5, 0.75) OVER (PARTITION BY date) - quantile_cont(fwd5, 0.25) OVER (PARTITION BY date) AS iqr FROM x), v AS (SELECT *, median(abs(fwd5 - mid)) OVER (PARTITION BY date) * 1.4826 AS mad FROM q)
SELECT date, id, {_rounded('p AS rank', '(least(ceil(p * 5), 5) - 0.5) / 5 AS quantile', 'sign(fwd5) * ln(1 + abs(fwd5)) AS signed_log', 'CASE WHEN iqr > 0 THEN (fwd5 - mid) / iqr WHEN mad > 0 THEN (fwd5 - mid) / mad END AS robust')} FROM v""")
def label_transforms(spark, d):
    return cross_section.transforms(labels.forward_returns(market.bars(spark, d)).where("fwd5 is not null"), "fwd5").select("date", "id", "rank", "quantile", "signed_log", "robust")


@query(f"""{BARS}, p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS n, {full('max', 'high', 20)} AS hi20, CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr, CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0) END AS dn FROM rets), e AS (SELECT *, {_ema('close', 2 / 13)} - {_ema('close', 2 / 27)} AS dif FROM p), m AS (SELECT *, dif - {_ema('dif', 2 / 10)} AS hist FROM e),
r AS (SELECT *, {full('avg', 'tr', 20)} AS atr, CASE WHEN n > 1 THEN coalesce(100 - 100 / (1 + ({full('avg', 'up', 14, 7)}) / nullif({full('avg', 'dn', 14, 7)}, 0)), 50) ELSE 50 END AS rsi, CASE WHEN count(high) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) >= 55 THEN max(high) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) END AS top FROM m),
s AS (SELECT *, lag(hist) OVER (PARTITION BY id ORDER BY date) AS h0 FROM r)
SELECT id, date, CASE WHEN hist > 0 AND h0 <= 0 THEN 1 WHEN hist < 0 AND h0 >= 0 THEN -1 ELSE 0 END AS macd_cross, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS rsi_signal, {_rounded('rsi', 'CASE WHEN close > top THEN close - 2 * atr END AS stop', '0.01 * 1e6 / nullif(atr, 0) AS unit', digits=4)} FROM s""", digits=4)
def trade_signals(spark, d):
    return features.trade_signals(market.bars(spark, d))


def _style_sql(name: str, a: int, b: int) -> str:
    """Exposure of each row of `px` to the spread of two legs, by calendar windows."""
    w = "(ORDER BY seq ROWS BETWEEN 149 PRECEDING AND CURRENT ROW)"
    return f"""{name}l AS (SELECT cal.date, cal.seq, l.ret AS l, s.ret AS s, l.ret - s.ret AS spread FROM cal LEFT JOIN (SELECT * FROM px WHERE id = {a}) l USING (date) LEFT JOIN (SELECT * FROM px WHERE id = {b}) s USING (date)),
{name}v AS MATERIALIZED (SELECT date, seq, spread, CASE WHEN count(spread) OVER {w} >= 20 THEN nullif(var_samp(spread) OVER {w}, 0) END AS v, CASE WHEN count(l * spread) OVER {w} >= 20 THEN covar_samp(l, spread) OVER {w} END AS cl, CASE WHEN count(s * spread) OVER {w} >= 20 THEN covar_samp(s, spread) OVER {w} END AS cs FROM {name}l),
{name}x AS (SELECT px.id, px.date, spread, v, cl, cs, CASE WHEN count(px.ret * spread) OVER r >= 20 THEN covar_samp(px.ret, spread) OVER r END AS c FROM px JOIN {name}v USING (date) WINDOW r AS (PARTITION BY px.id ORDER BY {name}v.seq RANGE BETWEEN 149 PRECEDING AND CURRENT ROW)),
{name} AS (SELECT id, date, spread, coalesce(CASE WHEN c IS NOT NULL AND v IS NOT NULL AND cl - cs <> 0 THEN least(3, greatest(-3, 2 * (c / v - cs / v) / (cl / v - cs / v) - 1)) END, CASE id WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END) AS exposure FROM {name}x)"""


_PX = "px AS MATERIALIZED (SELECT id, date, ret, close / lag(close, 20) OVER (PARTITION BY id ORDER BY date) - 1 AS mom20 FROM rets)"


@query(f"""{BARS}, {_PX}, {_style_sql('st', 1, 2)} SELECT id, date, {_rounded('spread', 'exposure', digits=5)} FROM st""", digits=5)
def style_exposure(spark, d):
    return styles.exposure(features.with_returns(market.bars(spark, d)), market.calendar(spark, d), 1, 2, n=150)


@query(f"""{BARS}, {_PX}, {_style_sql('sa', 1, 2)}, {_style_sql('sb', 3, 4)}, ga AS (SELECT date, coalesce(max(CASE WHEN id = 1 THEN mom20 END), 0) - coalesce(max(CASE WHEN id = 2 THEN mom20 END), 0) AS g FROM px WHERE id IN (1, 2) GROUP BY date), gb AS (SELECT date, coalesce(max(CASE WHEN id = 3 THEN mom20 END), 0) - coalesce(max(CASE WHEN id = 4 THEN mom20 END), 0) AS g FROM px WHERE id IN (3, 4) GROUP BY date),
j AS (SELECT sa.id, sa.date, coalesce(ga.g, 0) * sa.exposure AS value_growth, coalesce(gb.g, 0) * sb.exposure AS large_small FROM sa JOIN sb ON sb.id = sa.id AND sb.date = sa.date LEFT JOIN ga ON ga.date = sa.date LEFT JOIN gb ON gb.date = sa.date) SELECT id, date, {_rounded('value_growth', 'large_small', '(value_growth + 0.5 * large_small) / 1.5 AS composite', digits=4)} FROM j""", digits=4)
def style_spreads(spark, d):
    x = features.with_returns(market.bars(spark, d)).withColumn("mom20", F.col("close") / F.lag("close", 20).over(R.history()) - 1)
    return styles.style_spreads(x, market.calendar(spark, d), {"value_growth": (1, 2, 1.0), "large_small": (3, 4, 0.5)}, n=150)


@query(f"""{BARS}, {FWD}, n AS (SELECT max(seq) AS n FROM cal), x AS MATERIALIZED (SELECT p.*, (SELECT n FROM n) - seq AS back FROM pan p JOIN cal USING (date)), k AS MATERIALIZED (SELECT covar_pop(reversal, fwd5) / var_pop(reversal) AS k, avg(fwd5) - covar_pop(reversal, fwd5) / var_pop(reversal) * avg(reversal) AS c FROM x WHERE back >= 65 AND back < 565 AND reversal IS NOT NULL AND fwd5 IS NOT NULL)
SELECT date, id, round(c + k * reversal, 5) AS prediction FROM x, k WHERE back < 60 AND reversal IS NOT NULL""", digits=5)
def shadow_predictions(spark, d):
    p = research.panel(market.bars(spark, d)).select("date", "id", "reversal", "fwd5")
    return baselines.shadow_fit(p, market.calendar(spark, d), ["reversal"], "fwd5").select("date", "id", "prediction")


@query(f"""{BARS}, v AS (SELECT id, date, close / lag(close, 20) OVER h - 1 AS mom20, close / lag(close, 60) OVER h - 1 AS mom60, ret * volume / nullif({full('avg', 'volume', 20)}, 0) AS flow, ({full('stddev_samp', 'ret', 10)}) / nullif({full('stddev_samp', 'ret', 60)}, 0) - 1 AS vol_shift FROM rets WINDOW h AS (PARTITION BY id ORDER BY date)), bm AS (SELECT date, bench / lag(bench, 20) OVER (ORDER BY date) - 1 AS b20, bench / lag(bench, 60) OVER (ORDER BY date) - 1 AS b60 FROM bench)
SELECT id, date, {_rounded('mom20', 'mom60', 'mom20 - b20 AS excess20', 'mom60 - b60 AS excess60', 'flow', 'vol_shift')} FROM v LEFT JOIN bm USING (date)""")
def fund_factors(spark, d):
    return styles.fund_factors(market.bars(spark, d), market.benchmark(spark, d))


@query(f"""{BARS}, x AS (SELECT id, date, close / nullif({full('avg', 'close', 250, 20)}, 0) - 1 AS ma_gap, ({full('stddev_samp', 'ret', 20)}) * sqrt(252) AS vol, volume / nullif({full('avg', 'volume', 20)}, 0) AS volume_ratio FROM rets) SELECT id, date, {_rounded('ma_gap', 'vol', 'volume_ratio')} FROM x""")
def valuation_factors(spark, d):
    return styles.valuation(market.bars(spark, d))


@query()
def hold_band_portfolio(spark, d):
    """Checked against a loop in the tests."""
    return styles.hold_band(features.momentum(market.bars(spark, d)), "mom20")

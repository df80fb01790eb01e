"""Queries of the valuation line, by sector, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import valuation as V
from quantloom.queries import _ema, _rounded, query
from quantloom.sources import market

_H = "(PARTITION BY k ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _m(x: str, n: int, least: int, agg: str = "avg") -> str:
    return f"CASE WHEN count({x}) OVER {_H.format(n - 1)} >= {least} THEN {agg}({x}) OVER {_H.format(n - 1)} END"


_RAW = f"""hist AS (SELECT r_name AS k, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, avg(l_discount) * 100 AS dy, avg(l_tax) * 100 AS bond, avg(l_quantity) AS pe, sum(l_extendedprice) / sum(l_quantity) / avg(l_extendedprice / l_quantity) - 1 AS prem
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
hr AS (SELECT *, close / lag(close) OVER h - 1 AS ret, close - lag(close) OVER h AS ch, row_number() OVER h AS rn FROM hist WINDOW h AS (PARTITION BY k ORDER BY date)),
hg AS (SELECT k, date, rn - 1 AS m, greatest(ch, 0) AS gain, greatest(-ch, 0) AS loss FROM hr WHERE rn > 1), he AS (SELECT k, date, m, {_ema('gain', 1 / 20, 'm', 'k')} AS g, {_ema('loss', 1 / 20, 'm', 'k')} AS l FROM hg),
raw AS (SELECT k, date, close, rn, round(dy, 9) AS dividend_yield_pct, round(dy - bond, 9) AS yield_spread, round(pe, 9) AS pe_percentile, round(close / ({_m('close', 250, 20)}) - 1, 9) AS ma250_deviation, round(close, 9) AS price_percentile, round(CASE WHEN m >= 20 THEN 100 - 100 / (1 + g / nullif(l, 0)) END, 9) AS rsi_20,
round(prem, 9) AS premium_rate, round({_m('prem', 20, 5)}, 9) AS premium_rate_ma20, round(({_m('ret', 20, 5, 'stddev_samp')}) * sqrt(252), 9) AS volatility_percentile, round(volume / ({_m('volume', 20, 5)}), 9) AS volume_ratio FROM hr LEFT JOIN he USING (k, date))"""
_ALL = (*V.FEATURES, *V.CONFIDENCE)


def _pct(c: str) -> str:
    """Hazen percentile and count of the last 730 rows; the newest value is the current one, or the last before it."""
    inverted = c in V.FEATURES and V.FEATURES[c][1]
    p = f"(len(list_filter(f_{c}, lambda v: v < f_{c}[-1])) + (len(list_filter(f_{c}, lambda v: v = f_{c}[-1])) + 1) / 2 - 0.5) / len(f_{c})"
    return f"CASE WHEN len(f_{c}) > 0 THEN {'1 - ' if inverted else ''}{p} END AS {c}_percentile, len(f_{c}) AS {c}_n"


_PCTS = (
    f"ls AS (SELECT k, date, close, rn, {', '.join(f'list({c}) FILTER (WHERE {c} IS NOT NULL) OVER {_H.format(729)} AS w_{c}' for c in _ALL)} FROM raw), lf AS (SELECT k, date, close, rn, {', '.join(f'coalesce(w_{c}, []) AS f_{c}' for c in _ALL)} FROM ls), "
    f"pct AS MATERIALIZED (SELECT k, date, close, rn, {', '.join(map(_pct, _ALL))} FROM lf)"
)


def _history(spark, d):
    line, supplier, nation, region = (market.table(spark, d, t) for t in ("lineitem", "supplier", "nation", "region"))
    x = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    close = F.sum("l_extendedprice") / F.sum("l_quantity")
    return x.groupBy(F.col("r_name").alias("k"), F.to_date("l_shipdate").alias("date")).agg(
        close.alias("close"), F.sum("l_quantity").alias("volume"), (F.avg("l_discount") * 100).alias("dividend_yield"), (F.avg("l_tax") * 100).alias("bond"), F.avg("l_quantity").alias("pe"),
        (close / F.avg(F.col("l_extendedprice") / F.col("l_quantity")) - 1).alias("premium"),
    )


def _normalised(spark, d):
    raw = V.raw_features(_history(spark, d))
    return raw, V.percentiles(raw).join(raw.select("k", "date", "close"), ["k", "date"])


@query(f"WITH {_RAW}, {_PCTS} SELECT k, date, {', '.join(f'round({c}_percentile, 6) AS {c}_percentile, {c}_n' for c in _ALL)} FROM pct".removeprefix("WITH "))
def valuation_percentiles(spark, d):
    return _normalised(spark, d)[1].drop("close")


# per history and number of samples known: information, weights
_F = list(V.FEATURES)
_WEIGHTS = f"""tot AS (SELECT k, max(rn) AS n FROM pct GROUP BY k), fw AS (SELECT k, rn, lead(close, 60) OVER (PARTITION BY k ORDER BY rn) / close - 1 AS gain, {', '.join(f'{c}_percentile AS {c}' for c in _F)} FROM pct),
smp AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rn) AS s FROM fw WHERE (rn - 1) % 60 = 0 AND gain IS NOT NULL),
pt AS (SELECT k, s, f, x, gain, row_number() OVER (PARTITION BY k, f ORDER BY s) AS i FROM (UNPIVOT (SELECT k, s, gain, {', '.join(_F)} FROM smp) ON {', '.join(_F)} INTO NAME f VALUE x)),
wn AS (SELECT e.k, e.f, e.s AS s, e.i AS e, p.x, p.gain FROM pt e JOIN pt p ON p.k = e.k AND p.f = e.f AND p.i BETWEEN e.i - 29 AND e.i WHERE e.i >= 6),
rk AS (SELECT k, f, s, e, rank() OVER (PARTITION BY k, f, e ORDER BY x) + (count(*) OVER (PARTITION BY k, f, e, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY k, f, e ORDER BY gain) + (count(*) OVER (PARTITION BY k, f, e, gain) - 1) / 2.0 AS b FROM wn),
ic AS (SELECT k, f, s, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk GROUP BY k, f, s, e),
st AS (SELECT DISTINCT k, s FROM smp), gr AS (SELECT st.k, st.s, pt.f, count(*) AS np FROM st JOIN pt ON pt.k = st.k AND pt.s <= st.s GROUP BY ALL),
iv AS (SELECT gr.k, gr.s, gr.f, gr.np, count(ic.ic) AS n, avg(ic.ic) AS mean, stddev_samp(ic.ic) AS sd FROM gr LEFT JOIN ic ON ic.k = gr.k AND ic.f = gr.f AND ic.s <= gr.s GROUP BY ALL),
tt AS (SELECT *, CASE WHEN sd > 0 THEN abs(mean) / sd ELSE 0 END AS ir, CASE WHEN sd > 0 THEN atan(abs(mean) / (sd / sqrt(n)) / sqrt(n - 1)) END AS th FROM iv),
pv AS (SELECT *, CASE WHEN th IS NULL THEN 1 WHEN n - 1 = 1 THEN 1 - 2 / pi() * th WHEN (n - 1) % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * list_sum(list_transform(range(0, (n - 4) // 2 + 1), lambda j: cos(th) ** (2 * j + 1) * exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)))))
  ELSE 1 - sin(th) * list_sum(list_transform(range(0, (n - 1) // 2), lambda j: cos(th) ** (2 * j) * exp(lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)))) END AS p FROM tt),
sv AS (SELECT *, np >= 6 AND n > 0 AND mean < 0 AND p <= 0.1 AND ir >= 0.3 AS ok FROM pv), dom AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{dim}', {w})" for k, (dim, _, w) in V.FEATURES.items())}) t(f, dim, prior)),
mx AS (SELECT k, s, dom.f, dim, prior, count_if(ok) OVER g AS survivors, CASE WHEN ok THEN ir ELSE 0 END / nullif(sum(CASE WHEN ok THEN ir ELSE 0 END) OVER g, 0) AS own FROM sv JOIN dom USING (f) WINDOW g AS (PARTITION BY k, s)),
bl AS (SELECT *, 0.7 * prior + 0.3 * coalesce(own, 0) AS w0 FROM mx), bn AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY k, s) AS w FROM bl), dm AS (SELECT k, s, dim, sum(w) AS dw FROM bn GROUP BY ALL),
ob AS (SELECT bn.k, bn.s, max(survivors) AS survivors, max((SELECT max(dw) FROM dm WHERE dm.k = bn.k AND dm.s = bn.s)) AS top, max((SELECT dw FROM dm WHERE dm.k = bn.k AND dm.s = bn.s AND dim = 'dividend')) AS div, sum(w * prior) / sqrt(sum(w * w) * sum(prior * prior)) AS cosine FROM bn GROUP BY ALL),
fit AS (SELECT k, s, CASE WHEN s < 6 THEN 'independent_samples_too_few' WHEN survivors < 5 THEN 'surviving_features_too_few' WHEN top > 0.6 THEN 'single_dimension_overweight' WHEN div < 0.1 THEN 'dividend_dimension_underweight' WHEN cosine < 0.5 THEN 'weight_structure_deviates_from_domain_knowledge' END AS reason FROM ob),
dt AS (SELECT pct.k, pct.date, pct.rn, CASE WHEN pct.rn > 252 THEN pct.rn - 252 ELSE pct.rn END AS trained, (SELECT count(*) FROM smp WHERE smp.k = pct.k AND smp.rn + 60 <= pct.rn - 252) AS s, {', '.join(f'(max({c}_n) OVER (PARTITION BY k ORDER BY date) > 0) AS has_{c}' for c in _F)} FROM pct),
dr AS (SELECT dt.*, CASE WHEN trained < 730 THEN 'training_history_too_short' WHEN dt.s < 6 THEN 'independent_samples_too_few' ELSE reason END AS reason, {' + '.join(f'CASE WHEN has_{k} THEN {w} ELSE 0 END' for k, (_, _, w) in V.FEATURES.items())} AS avail FROM dt LEFT JOIN fit ON fit.k = dt.k AND fit.s = dt.s),
wt AS (SELECT dr.k, dr.date, any_value(dr.reason) AS reason, any_value(dr.s) AS samples, {', '.join(f"max(CASE WHEN bn.f = '{k}' AND dr.reason IS NULL THEN bn.w WHEN dr.reason IS NOT NULL AND has_{k} THEN {w} / avail ELSE 0 END) AS w_{k}" for k, (_, _, w) in V.FEATURES.items())} FROM dr LEFT JOIN bn ON bn.k = dr.k AND bn.s = dr.s GROUP BY dr.k, dr.date)"""


@query(f"""{_RAW}, {_PCTS}, {_WEIGHTS} SELECT k, date, {', '.join(f'round(w_{c}, 6) AS w_{c}' for c in _F)}, CASE WHEN reason IS NULL THEN 'shrunk_ic_ir' ELSE 'domain_knowledge_fallback' END AS method, reason, samples::INT AS samples FROM wt""")
def valuation_weights(spark, d):
    return V.weights_by_date(_normalised(spark, d)[1])


def _scores(spark, d):
    norm = _normalised(spark, d)[1]
    return V.scores(norm, V.weights_by_date(norm))


_has = {c: f"{c}_percentile IS NOT NULL AND w_{c} > 0" for c in _F}
_dims = {dim: " OR ".join(f"({_has[k]})" for k, f in V.FEATURES.items() if f[0] == dim) for dim in ("dividend", "pe", "price", "premium")}
_SCORES = f"""sj AS (SELECT pct.*, wt.* EXCLUDE (k, date) FROM pct JOIN wt USING (k, date)), sm AS (SELECT *, {' + '.join(f'CASE WHEN {_has[c]} THEN w_{c} ELSE 0 END' for c in _F)} AS tw, {' + '.join(f'CASE WHEN {_has[c]} THEN w_{c} * 10 * {c}_percentile ELSE 0 END' for c in _F)} AS ts,
(({_dims['dividend']}) AND {' + '.join(f'({x})::INT' for x in _dims.values())} >= 3) AS enough, {' + '.join(f'coalesce(({c}_percentile <= 0.1 OR {c}_percentile >= 0.9)::INT, 0)' for c in V.CONFIDENCE)} AS extreme, ({' OR '.join(f'{c}_n < 120' for c in _F)}) AS thin FROM sj),
so AS (SELECT k, date, close, reason, CASE WHEN enough AND tw > 0 THEN round(ts / tw, 4) END AS total_score, CASE WHEN enough AND tw > 0 THEN CASE WHEN extreme >= 2 THEN 'low' WHEN extreme = 1 OR thin THEN 'lowered' ELSE 'normal' END END AS confidence FROM sm),
sl AS (SELECT *, coalesce(list(total_score) FILTER (WHERE total_score IS NOT NULL) OVER {_H.format(503)}, []) AS w FROM so), sc AS (SELECT k, date, close, total_score, confidence, CASE WHEN reason IS NULL THEN 'shrunk_ic_ir' ELSE 'domain_knowledge_fallback' END AS method, reason, len(w) AS score_n,
CASE WHEN len(w) >= 120 THEN (len(list_filter(w, lambda v: v < w[-1])) + (len(list_filter(w, lambda v: v = w[-1])) + 1) / 2 - 0.5) / len(w) END AS score_percentile FROM sl)"""


@query(f"{_RAW}, {_PCTS}, {_WEIGHTS}, {_SCORES} SELECT k, date, {_rounded('close', 'total_score', digits=3)}, confidence, method, reason, score_n FROM sc", digits=3)
def valuation_scores(spark, d):
    """Percentiles of scores are left to the test: scores that agree to 3 digits here may tie there."""
    return _scores(spark, d).drop("score_percentile")


@query()
def valuation_audit(spark, d):
    """Checked against pandas in the tests."""
    return V.score_audit(_scores(spark, d), {"1992_1994": ("1992-01-01", "1994-12-31"), "1995_1996": ("1995-01-01", "1996-12-31"), "1997_1998": ("1997-01-01", "1998-12-31")})

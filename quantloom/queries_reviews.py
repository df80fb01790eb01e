"""Queries of feature reviews, state terms, trend states, runtime gates and executable weights, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.operators import diagnostics, execution, feature_review, features, gates, regime
from quantloom.plans import research
from quantloom.queries import BARS, FWD, _rounded, query
from quantloom.queries_execution import _BEST, _FILL, _candidates
from quantloom.queries_regime import _MARKET, _ROTATION, _breadth, _clamp, _industry_close, _market
from quantloom.queries_structure import _CG, _FEATURES, _conflicts, _feature_table
from quantloom.sources import market
from quantloom.sources.shared import written

_FF = f"""ft AS MATERIALIZED (SELECT year(fe.date) AS fold, fe.date, fe.id, fwd5 AS y, {', '.join(f'round({c}, 9) AS {c}' for c in _FEATURES)} FROM fe JOIN fwd USING (id, date)), fu AS MATERIALIZED (SELECT * FROM ft UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(_FEATURES)}))),
fz AS (SELECT fold, feature, count(*) AS "rows", count(CASE WHEN x IS NOT NULL THEN y END) AS valid FROM fu GROUP BY ALL),
fo AS (SELECT *, count(*) OVER d AS n, row_number() OVER (PARTITION BY fold, feature, date ORDER BY x DESC, id) AS dn, rank() OVER (PARTITION BY fold, feature, date ORDER BY x) + (count(*) OVER (PARTITION BY fold, feature, date, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY fold, feature, date ORDER BY y) + (count(*) OVER (PARTITION BY fold, feature, date, y) - 1) / 2.0 AS b FROM fu WHERE x IS NOT NULL AND y IS NOT NULL WINDOW d AS (PARTITION BY fold, feature, date)),
fk AS (SELECT *, least(10, n // 2) AS k, least(5, n) AS g FROM fo WHERE n >= 2), fday AS (SELECT fold, feature, date, stddev_pop(x) AS std, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic, avg(CASE WHEN dn <= k THEN y END) - avg(CASE WHEN dn > n - k THEN y END) AS spread, avg(CASE WHEN dn <= k THEN (y > 0)::INT END) AS hit FROM fk GROUP BY ALL),
fd AS (SELECT fold, feature, avg(std) AS std, avg(ic) AS rank_ic, avg(spread) AS spread, avg(hit) AS hit_rate, count(ic) AS dates FROM fday GROUP BY ALL), fb AS (SELECT fold, feature, date, p, avg(y) AS m FROM (SELECT fk.*, unnest(range(0, g)) AS p FROM fk) WHERE dn - 1 >= n * p // g AND dn - 1 < n * (p + 1) // g GROUP BY ALL),
fp AS (SELECT fold, feature, p, avg(m) AS m FROM fb GROUP BY ALL), fr AS (SELECT *, rank() OVER (PARTITION BY fold, feature ORDER BY m) AS r FROM fp), fm AS (SELECT fold, feature, CASE WHEN count(*) >= 3 THEN corr(-p, r) END AS mono FROM fr GROUP BY ALL),
folds AS MATERIALIZED (SELECT fz.fold, fz.feature, "rows", valid, valid / "rows" AS coverage, coalesce(std, 0) AS std, coalesce(rank_ic, 0) AS rank_ic, coalesce(spread, 0) AS spread, coalesce(hit_rate, 0) AS hit_rate, coalesce(mono, 0) AS monotonicity, coalesce(dates, 0) AS dates FROM fz LEFT JOIN fd USING (fold, feature) LEFT JOIN fm USING (fold, feature))"""
_SUM = """su AS (SELECT feature, sum(valid) / sum("rows") AS coverage, sum(std * valid) / sum(valid) AS std, avg(rank_ic) AS rank_ic, avg(spread) AS spread, avg(hit_rate) AS hit_rate, avg(monotonicity) AS monotonicity, stddev_pop(rank_ic) AS ic_std, min(rank_ic) AS worst, avg((rank_ic > 0)::INT) AS positive, count(*) AS folds, avg(rank_ic) / (stddev_samp(rank_ic) / sqrt(count(*))) AS t_stat FROM folds GROUP BY feature),
sr AS (SELECT feature, grp, first_value(feature) OVER (PARTITION BY grp ORDER BY round(abs(ic), 9) DESC, feature) AS representative FROM co JOIN fi ON f = feature), sx AS (SELECT su.*, coalesce(representative, feature) AS lead FROM su LEFT JOIN sr USING (feature))"""


def _folds(x):
    return feature_review.fold_metrics(x.withColumn("fold", F.year("date")), list(_FEATURES), "fwd5")


def _folds_and_groups(spark, d):
    x = written(_feature_table(spark, d, whole=False), "features")  # read twice
    g = _conflicts(x.dropna())
    return _folds(x), g.select("feature", F.max(F.when(F.col("representative"), F.col("feature"))).over(Window.partitionBy("group")).alias("representative"))


@query(f"""RECURSIVE {BARS}, {FWD}, {_CG}, {_FF} SELECT fold, feature, "rows", valid, {_rounded('coverage', 'std', 'rank_ic', 'spread', 'hit_rate', 'monotonicity', digits=5)}, dates FROM folds""", digits=5)
def feature_folds(spark, d):
    return _folds(_feature_table(spark, d, whole=False))


@query(f"""RECURSIVE {BARS}, {FWD}, {_CG}, {_FF}, {_SUM}, rv AS (SELECT *, coverage < 0.5 AS lc, coverage >= 0.5 AND std <= 0.01 AS lv, rank_ic <= 0 AS ni, feature <> lead AS rd, rank_ic + 0.2 * least(1, greatest(-1, spread * 100)) + 0.1 * monotonicity AS signal_score, positive - least(CASE WHEN abs(rank_ic) > 1e-12 THEN ic_std / abs(rank_ic) ELSE 0 END, 2) * 0.1 AS stability_score FROM sx),
rw AS (SELECT *, CASE WHEN rd THEN 0.35 ELSE 0 END AS redundancy_penalty, CASE WHEN lc THEN 0.25 ELSE 0 END + CASE WHEN lv THEN 0.35 ELSE 0 END + CASE WHEN ni THEN 0.2 ELSE 0 END AS quality_penalty FROM rv)
SELECT feature, {_rounded('coverage', 'rank_ic', digits=5)}, concat_ws(',', CASE WHEN lc THEN 'low_coverage' END, CASE WHEN lv THEN 'low_variance' END, CASE WHEN ni THEN 'negative_rank_ic' END, CASE WHEN rd THEN 'redundant' END) AS reasons, CASE WHEN lv OR ni OR rd THEN 'drop_candidate' WHEN lc THEN 'review' ELSE 'keep' END AS decision, {_rounded('signal_score', 'stability_score', 'redundancy_penalty', 'quality_penalty', 'signal_score + 0.25 * stability_score - redundancy_penalty - quality_penalty AS factor_score', digits=5)} FROM rw""", digits=5)
def feature_reviews(spark, d):
    folds, groups = _folds_and_groups(spark, d)
    return feature_review.reviewed(feature_review.summary(folds), groups)


@query(f"""RECURSIVE {BARS}, {FWD}, {_CG}, {_FF}, {_SUM}, rv AS (SELECT *, concat_ws(',', CASE WHEN coverage < 0.5 THEN 'low_coverage' END, CASE WHEN coverage >= 0.5 AND std <= 0.01 THEN 'low_variance' END, CASE WHEN rank_ic <= -0.02 AND positive < 0.5 THEN 'stable_negative_ic' END, CASE WHEN feature <> lead THEN 'redundant' END) AS why, abs(t_stat) < 1.2815515655446004 AND positive < 0.67 AS weak FROM sx)
SELECT feature, CASE WHEN why <> '' THEN 'hard_exclude' WHEN weak THEN 'watch' ELSE 'keep_candidate' END AS decision, CASE WHEN why = '' AND weak THEN 'weak_evidence' ELSE why END AS reasons, {_rounded('coverage', 'rank_ic', 'positive', 't_stat', digits=4)}, folds, lead AS representative FROM rv""", digits=4)
def feature_audit(spark, d):
    """p below 0.2 is a t of 1.2816 at least; the p-value itself has no SQL function."""
    folds, groups = _folds_and_groups(spark, d)
    return feature_review.audited(feature_review.summary(folds), groups).drop("p_value")


_REGIMES = f"""{_MARKET}, {_ROTATION}, rj AS (SELECT me.date, label || '_' || coalesce(structure, 'co_move') AS regime, {_clamp("CASE WHEN label <> 'range' THEN trendiness ELSE 1 - trendiness END")} AS a, {_clamp("CASE WHEN coalesce(structure, 'co_move') = 'rotation' THEN rotation ELSE 1 - rotation END")} AS b FROM me LEFT JOIN ru USING (date)), rg AS (SELECT date, regime, coalesce(sqrt(a * b), 0) AS strength FROM rj)"""
_TERMS = {"strength": "least(1, greatest(0, coalesce(strength, 0)))", "risk_on": "(regime LIKE 'bull_%')::INT", "neutral": "(regime NOT LIKE 'bull_%' AND regime NOT LIKE 'bear_%')::INT", "risk_off": "(regime LIKE 'bear_%')::INT", "rotation": "(regime LIKE '%_rotation')::INT"}


@query(f"""{BARS}, {_REGIMES}, px AS (SELECT id, date, volume, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS s, count(volume) OVER w AS n FROM bars WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), pz AS (SELECT id, date, CASE WHEN n >= 20 THEN least(4, greatest(-4, coalesce((volume - m) / nullif(s, 0), 0))) ELSE 0 END AS z FROM px),
pr AS (SELECT id, date, z, coalesce(regime, 'range_co_move') AS regime, strength FROM pz LEFT JOIN rg USING (date)), pt AS (SELECT id, date, z, regime, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _TERMS.items())} FROM pr), pm AS (SELECT {', '.join(f'avg({k}) AS m_{k}' for k in _TERMS)} FROM pt)
SELECT id, date, regime, {_rounded('z', *_TERMS, *(f'z * ({k} - m_{k}) AS z_x_{k}' for k in _TERMS), digits=4)} FROM pt, pm""", digits=4)
def regime_interactions(spark, d):
    from quantloom.functions import rolling as R

    w = R.last_n(60)
    z = F.coalesce(R.ratio(F.col("volume") - F.avg("volume").over(w), F.stddev_pop("volume").over(w)), F.lit(0.0))
    x = market.bars(spark, d).select("id", "date", F.when(F.count("volume").over(w) >= 20, R.clip(z, -4.0, 4.0)).otherwise(0.0).alias("z"))
    states = regime.regimes(regime.trend_and_direction(_market(spark, d)), regime.rotation(_industry_close(spark, d), _breadth(spark, d)))
    return feature_review.regime_terms(x, states, ["z"])


_AV = "avg(close) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_COMP = {"close_short": "(close / m20 - 1 + 0.04) / 0.09", "close_mid": "(close / m60 - 1 + 0.08) / 0.18", "short_mid": "(m20 / m60 - 1 + 0.03) / 0.08", "mid_long": "(m60 / m120 - 1 + 0.04) / 0.10", "ret_short": "(close / l20 - 1 + 0.06) / 0.14", "ret_mid": "(close / l60 - 1 + 0.10) / 0.25", "drawdown": "(close / h60 - 1 + 0.12) / 0.12"}


@query(f"""{BARS}, tm AS (SELECT id, date, close, row_number() OVER h AS n, {_AV.format(19)} AS m20, {_AV.format(59)} AS m60, {_AV.format(119)} AS m120, lag(close, 20) OVER h AS l20, lag(close, 60) OVER h AS l60, max(close) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS h60 FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)),
tc AS (SELECT id, date, {', '.join(f'least(1, greatest(0, {v})) AS {k}' for k, v in _COMP.items())} FROM tm WHERE n >= 121), ts AS (SELECT *, (0.9 * close_short + 1.2 * close_mid + short_mid + 1.2 * mid_long + 0.8 * ret_short + ret_mid + drawdown) / 7.1 AS strength FROM tc),
tf AS (SELECT *, CASE WHEN strength <= 0.25 THEN strength / 0.25 * 0.2 WHEN strength <= 0.45 THEN 0.2 + (strength - 0.25) WHEN strength <= 0.65 THEN 0.4 + (strength - 0.45) / 0.2 * 0.22 WHEN strength <= 0.82 THEN 0.62 + (strength - 0.65) / 0.17 * 0.2 ELSE 0.82 + (strength - 0.82) END AS fl FROM ts)
SELECT id, date, {_rounded(*_COMP, 'strength', digits=5)}, CASE WHEN strength >= 0.78 THEN 'bull' WHEN strength >= 0.58 THEN 'constructive' WHEN strength >= 0.38 THEN 'neutral' ELSE 'defensive' END AS mode, {_rounded('0.2 + 0.6 * fl AS floor', digits=5)} FROM tf""", digits=5)
def trend_states(spark, d):
    return feature_review.trend_states(market.bars(spark, d))


@query(f"""{BARS}, {FWD}, gd AS (SELECT date, count(*) AS n, count_if(reversal IS NOT NULL AND mom20 IS NOT NULL) AS eligible FROM pan GROUP BY date), gh AS (SELECT *, median(eligible) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS history, lag(date) OVER (ORDER BY date) AS data_end, lag(date, 12) OVER (ORDER BY date) AS label_end, lag(date, 40) OVER (ORDER BY date) AS evidence_end FROM gd),
gg AS (SELECT *, greatest(10, coalesce(floor(history * 0.8)::INT, 10)) AS threshold, date - data_end > 3 AS ds, eligible < n * 0.9 AS mv, coalesce(date - label_end > 30, false) AS ls, coalesce(date - label_end > 15 AND date - label_end <= 30, false) AS lw, coalesce(date - evidence_end > 70, false) AS es, coalesce(date - evidence_end > 55 AND date - evidence_end <= 70, false) AS ew FROM gh)
SELECT date, eligible, threshold, concat_ws(',', CASE WHEN ds THEN 'data_stale' END, CASE WHEN mv THEN 'missing_values' END, CASE WHEN eligible < threshold THEN 'coverage_below_threshold' END, CASE WHEN ls THEN 'label_stale' END, CASE WHEN es THEN 'evidence_stale' END) AS reasons, concat_ws(',', CASE WHEN lw THEN 'label_aging' END, CASE WHEN ew THEN 'evidence_aging' END) AS warnings, NOT (coalesce(ds, false) OR mv OR eligible < threshold OR ls OR es) AS passed FROM gg""")
def runtime_gates(spark, d):
    p = research.panel(market.bars(spark, d))
    g = p.groupBy("date").agg(F.count("*").alias("n"), F.count_if(F.col("reversal").isNotNull() & F.col("mom20").isNotNull()).alias("eligible"))
    w = Window.orderBy("date")  # one row a day
    at = lambda n: F.lag("date", n).over(w)
    g = g.select("date", "eligible", F.percentile("eligible", 0.5).over(w.rowsBetween(-60, -1)).alias("history"), (F.col("eligible") < F.col("n") * 0.9).alias("missing"), F.lit(0).alias("gap"), at(1).alias("data_end"), at(12).alias("label_end"), at(40).alias("evidence_end"))
    return gates.runtime_gates(g, least=10, delay=3, model=(15, 30), evidence=(55, 70))


@query(f"""{BARS}, {FWD}, sd AS (SELECT date, stddev_pop(reversal) AS std, quantile_cont(reversal, 0.95) - quantile_cont(reversal, 0.5) AS lead FROM pan WHERE reversal IS NOT NULL GROUP BY date), sp AS (SELECT quantile_cont(std, 0.01) AS std_p01, quantile_cont(lead, 0.05) AS lead_p05 FROM sd WHERE date < DATE '1996-01-01')
SELECT date, {_rounded('std', 'lead', digits=5)}, concat_ws(',', CASE WHEN std <= std_p01 THEN 'std_below_p01' END, CASE WHEN lead <= lead_p05 THEN 'spread_below_p05' END) AS reasons, NOT (std <= std_p01 OR lead <= lead_p05) AS passed FROM sd, sp WHERE date >= DATE '1996-01-01'""", digits=5)
def score_gates(spark, d):
    p = research.panel(market.bars(spark, d)).where("reversal is not null")
    reference = diagnostics.score_ranges(p.where("date < '1996-01-01'"), "reversal")
    return gates.score_gates(p.where("date >= '1996-01-01'"), reference, "reversal")


# executable weights: the targets of a date against those of the date before, a third of which was bought on the day
_LIM = """SELECT *, CASE WHEN {t} < held THEN greatest({t}, locked) ELSE {t} END AS w1 FROM {s}"""
_CAPD = "CASE WHEN liquidity IS NULL OR abs(w1 - held) * 1e7 <= greatest(liquidity, 0) * 0.05 + 1e-12 THEN w1 - held ELSE sign(w1 - held) * greatest(liquidity, 0) * 0.05 / 1e7 END"


def _water_sql(name: str, source: str, score: str, cap: str, budget: str, by: str, key: str) -> str:
    """Shares of a budget under a cap: the least number of names at the cap that keeps the next one below it."""
    return f"""{name}a AS (SELECT *, {score} AS sc, {budget} AS bu FROM {source} WHERE {score} > 0), {name}b AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY sc DESC, {key}) AS i, count(*) OVER (PARTITION BY {by}) AS n, sum(sc) OVER (PARTITION BY {by}) AS tot FROM {name}a),
{name}c AS (SELECT *, tot - sum(sc) OVER (PARTITION BY {by} ORDER BY i) + sc AS rest, least(bu, {cap} * n) AS b FROM {name}b), {name}d AS (SELECT *, min(CASE WHEN sc / rest * (b - (i - 1) * {cap}) <= {cap} + 1e-15 THEN i - 1 END) OVER (PARTITION BY {by}) AS k0 FROM {name}c), {name}e AS (SELECT *, coalesce(k0, n) AS k FROM {name}d),
{name} AS (SELECT * EXCLUDE (sc, bu, i, n, tot, rest, b, k0, k), CASE WHEN i <= k THEN {cap} ELSE sc / sum(CASE WHEN i > k THEN sc END) OVER (PARTITION BY {by}) * (b - k * {cap}) END AS share FROM {name}e)"""


def _scaled_sql(name: str, source: str, gross: str) -> str:
    """Caps of names (0.1) and industries (0.3)."""
    return f"""{_water_sql(name + 'n', source, 'weight', '0.1', gross, 'date', 'id')}, {name}g AS (SELECT date, coalesce(industry, 'Unknown') AS ind, sum(share) AS gw, sum(sum(share)) OVER (PARTITION BY date) AS al FROM {name}n GROUP BY date, coalesce(industry, 'Unknown')), {_water_sql(name + 'h', name + 'g', 'gw', '0.3', 'al', 'date', 'ind')},
{name} AS (SELECT n.* EXCLUDE (share, weight), n.share * h.share / h.gw AS weight FROM {name}n n JOIN {name}h h ON h.date = n.date AND h.ind = coalesce(n.industry, 'Unknown'))"""


def _turn_sql(name: str, source: str, rank: str) -> str:
    """Turnover of at most 0.2 a side, by priority."""
    return f"""{name}a AS (SELECT *, weight - held AS dl, {rank} AS pr FROM {source}), {name}b AS (SELECT *, sum(abs(dl)) OVER (PARTITION BY date) / 2 AS tv, coalesce(sum(abs(dl)) OVER (PARTITION BY date, sign(dl) ORDER BY pr DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pd FROM {name}a),
{name} AS (SELECT * EXCLUDE (weight, dl, pr, tv, pd), CASE WHEN tv - 1e-12 <= 0.2 THEN weight ELSE held + sign(dl) * least(abs(dl), greatest(0, 0.2 - pd)) END AS weight FROM {name}b)"""


@query(f"""{BARS}, {FWD}, {_BEST}, {_FILL}, tg AS (SELECT cw.date, cw.id, cw.weight, cw.industry, sig.mom20 AS alpha, sig.turnover AS liquidity FROM cw JOIN sig ON sig.date = cw.date AND sig.id = cw.id WHERE cw.weight > 1e-15), dn AS (SELECT date, row_number() OVER (ORDER BY date) AS q FROM (SELECT DISTINCT date FROM tg)),
cu AS (SELECT b.date, tg.id, tg.weight AS held, CASE WHEN tg.weight > 0.05 THEN tg.weight / 3 ELSE 0 END AS locked FROM tg JOIN dn a USING (date) JOIN dn b ON b.q = a.q + 1), t0 AS (SELECT * FROM tg WHERE weight >= 0.005), {_scaled_sql('s1', 't0', '0.9')},
fj AS (SELECT coalesce(s1.date, cu.date) AS date, coalesce(s1.id, cu.id) AS id, coalesce(s1.weight, 0) AS weight, coalesce(held, 0) AS held, coalesce(locked, 0) AS locked, industry, alpha, liquidity FROM s1 FULL JOIN (SELECT cu.* FROM cu JOIN (SELECT DISTINCT date FROM s1) d USING (date)) cu ON cu.date = s1.date AND cu.id = s1.id),
g0 AS (SELECT * EXCLUDE (weight), CASE WHEN abs(weight - held) < 0.003 OR weight > held AND coalesce(alpha < 0.02, true) THEN held ELSE weight END AS weight FROM fj), g1 AS ({_LIM.format(t='weight', s='g0')}), g2 AS (SELECT * EXCLUDE (weight, w1), CASE WHEN abs({_CAPD}) * 1e7 < 20000 THEN held ELSE held + {_CAPD} END AS weight FROM g1),
{_turn_sql('g3', 'g2', 'abs(weight - held) * abs(coalesce(alpha, 0))')}, g4 AS (SELECT *, least(0.9, sum(greatest(weight, 0)) OVER (PARTITION BY date)) AS gr FROM g3), {_scaled_sql('s2', 'g4', 'gr')},
g5 AS (SELECT g3.* EXCLUDE (weight), coalesce(s2.weight, 0) AS weight FROM g3 LEFT JOIN s2 ON s2.date = g3.date AND s2.id = g3.id), g6 AS ({_LIM.format(t='weight', s='g5')}), g7 AS (SELECT * EXCLUDE (weight, w1), CASE WHEN abs({_CAPD}) * 1e7 < 20000 THEN held ELSE held + {_CAPD} END AS weight FROM g6),
g8 AS (SELECT * FROM g7 WHERE weight > 0), {_turn_sql('g9', 'g8', '0')} SELECT date, id, {_rounded('weight')}, industry FROM g9 WHERE weight > 0""")
def executable_weights(spark, d):
    """The capped momentum weights of each date, brought to what can be traded from those of the date before."""
    facts = features.momentum(market.bars(spark, d), keep=("turnover",)).select("date", "id", F.col("mom20").alias("alpha"), F.col("turnover").alias("liquidity"))
    t = written(_candidates(spark, d).select("date", "id", "industry", "weight").join(facts, ["date", "id"]), "targets")  # read three times
    days = t.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("_next"))  # one row a day
    held = t.join(days, "date").where("_next is not null").select(F.col("_next").alias("date"), "id", "weight", F.when(F.col("weight") > 0.05, F.col("weight") / 3).otherwise(0.0).alias("locked"))
    rules = execution.Rules(gross=0.9, max_weight=0.1, max_industry=0.3, min_weight=0.005, buffer=0.003, alpha=0.02, lock=True, participation=0.05, value=1e7, min_trade=20000.0, max_turnover=0.2)
    return execution.executable(t, held, rules)

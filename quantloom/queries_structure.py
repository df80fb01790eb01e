"""Queries of factor risk, resampling, chains, conflict groups, quarters, coverage and appends, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import graphs
from quantloom.operators import diagnostics, evaluation, factor_risk, features, intervals, pointintime, resampling
from quantloom.plans import research
from quantloom.queries import BARS, FWD, _rounded, query
from quantloom.sources import appends, market
from quantloom.sources.shared import fresh_path, written


def _models(spark, d):
    returns = features.with_returns(market.bars(spark, d)).select("id", "date", "ret")
    return factor_risk.factor_models(returns, market.calendar(spark, d))


@query()
def factor_risk_models(spark, d):
    """Checked against numpy's eigenvectors of the whole covariance in the tests."""
    return _models(spark, d)


@query()
def factor_risk_volatility(spark, d):
    """Of equal weights; checked against the whole covariance in the tests."""
    m = _models(spark, d)
    return factor_risk.model_volatility(m.select("asof", "id", (1 / F.count("*").over(Window.partitionBy("asof"))).alias("weight")), m)


_YEARLY = """rk0 AS (SELECT date, reversal, fwd5, rank() OVER (PARTITION BY date ORDER BY reversal) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, fwd5) - 1) / 2.0 AS b FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL),
i0 AS (SELECT date, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM rk0 GROUP BY date HAVING count(*) >= 5), fo AS (SELECT 'rank_ic' AS metric, year(date) AS fold, avg(ic) AS x FROM i0 GROUP BY ALL UNION ALL SELECT 'mean_label', year(date), avg(fwd5) FROM rk0 GROUP BY ALL)"""


def _fold_metrics(spark, d):
    p = research.panel(market.bars(spark, d)).where("reversal is not null and fwd5 is not null")
    ic = evaluation.rank_ic(p, "reversal", "fwd5").groupBy(F.lit("rank_ic").alias("metric"), F.year("date").alias("fold")).agg(F.avg("ic").alias("x"))
    return ic.unionByName(p.groupBy(F.lit("mean_label").alias("metric"), F.year("date").alias("fold")).agg(F.avg("fwd5").alias("x")))


@query(f"""{BARS}, {FWD}, {_YEARLY}, f AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY fold) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM fo WHERE x IS NOT NULL), p AS (SELECT metric, b, (('0x' || substr(md5('20260430-' || b || '-' || i), 1, 8))::BIGINT % n) AS i FROM f, (SELECT unnest(range(0, 1000)) AS b)),
m AS (SELECT metric, b, avg(x) AS m FROM p JOIN f USING (metric, i) GROUP BY ALL), c AS (SELECT metric, quantile_cont(m, 0.2) AS lo, max(m) AS hi FROM m GROUP BY metric), o AS (SELECT metric, count(*) AS observations, avg(x) AS mean FROM f GROUP BY metric)
SELECT metric, observations, {_rounded('mean', 'lo AS ci_low', 'hi AS ci_high')}, lo <= 0 AS crosses_zero FROM o JOIN c USING (metric)""")
def bootstrap_intervals(spark, d):
    return resampling.bootstrap(_fold_metrics(spark, d), "x")


@query(f"""o AS (SELECT o_orderkey AS node, lead(o_orderkey) OVER c AS next, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS "end", count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS hops, ln(1 + CASE o_orderpriority WHEN '1-URGENT' THEN 0.02 WHEN '2-HIGH' THEN 0.01 ELSE 0 END) AS r FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
x AS (SELECT o.node, o."end", o.hops, (SELECT sum(p.r) FROM o p WHERE p."end" = o."end" AND p.hops <= o.hops AND p.next IS NOT NULL) AS r FROM o WHERE o.next IS NOT NULL) SELECT node, "end", hops, {_rounded('exp(r) AS ratio')}, false AS cyclic FROM x""")
def share_successors(spark, d):
    """Each order of a customer is followed by the next, at a ratio by its priority: the last one, the steps to it and the ratios multiplied."""
    orders = market.table(spark, d, "orders")
    ratio = 1 + F.when(F.col("o_orderpriority") == "1-URGENT", 0.02).when(F.col("o_orderpriority") == "2-HIGH", 0.01).otherwise(0.0)
    links = orders.select(F.col("o_orderkey").alias("node"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"), ratio.alias("ratio"))
    return graphs.chain_ends(links, "ratio")


_FEATURES = ("high_gap", "low_gap", "mom5", "mom10", "mom20", "turn", "vol20")
_CG = f"""fe AS (SELECT id, date, high / close - 1 AS high_gap, low / close - 1 AS low_gap, close / lag(close, 5) OVER h - 1 AS mom5, close / lag(close, 10) OVER h - 1 AS mom10, close / lag(close, 20) OVER h - 1 AS mom20, volume / avg(volume) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS turn,
CASE WHEN count(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol20 FROM rets WINDOW h AS (PARTITION BY id ORDER BY date)),
cf AS (SELECT fe.*, fwd5 FROM fe JOIN fwd USING (id, date) WHERE {' AND '.join(f'round({c}, 9) IS NOT NULL' for c in _FEATURES)} AND fwd5 IS NOT NULL), lg AS (UNPIVOT (SELECT date, id, fwd5, {', '.join(f'round({c}, 9) AS {c}' for c in _FEATURES)} FROM cf) ON {', '.join(_FEATURES)} INTO NAME f VALUE x),
rf AS (SELECT date, id, f, rank() OVER (PARTITION BY date, f ORDER BY x) + (count(*) OVER (PARTITION BY date, f, x) - 1) / 2.0 AS r, rank() OVER (PARTITION BY date, f ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, f, fwd5) - 1) / 2.0 AS q, count(*) OVER (PARTITION BY date, f) AS n FROM lg),
pc AS (SELECT a.date, a.f AS a, b.f AS b, CASE WHEN stddev_pop(a.r) > 0 AND stddev_pop(b.r) > 0 THEN corr(a.r, b.r) ELSE 0 END AS c FROM rf a JOIN rf b ON a.date = b.date AND a.id = b.id AND a.f < b.f WHERE a.n >= 3 GROUP BY ALL), ed AS (SELECT a, b FROM pc GROUP BY a, b HAVING abs(avg(c)) >= 0.3),
di AS (SELECT f, date, CASE WHEN stddev_pop(r) > 0 AND stddev_pop(q) > 0 THEN corr(r, q) END AS ic FROM rf WHERE n >= 3 GROUP BY ALL), fi AS (SELECT f, avg(ic) AS ic FROM di GROUP BY f),
un AS (SELECT a AS x, b AS y FROM ed UNION SELECT b, a FROM ed), re AS (SELECT DISTINCT x AS a, x AS b FROM un UNION SELECT re.a, un.y FROM re JOIN un ON un.x = re.b), co AS (SELECT a AS feature, min(b) AS grp FROM re GROUP BY a)"""


def _feature_table(spark, d, whole: bool = True):
    h = Window.partitionBy("id").orderBy("date")
    w = h.rowsBetween(-19, 0)
    x = features.with_returns(market.bars(spark, d))
    change = lambda n: F.col("close") / F.lag("close", n).over(h) - 1
    x = x.select(
        "id", "date", (F.lead("close", 6).over(h) / F.lead("close", 1).over(h) - 1).alias("fwd5"), (F.col("high") / F.col("close") - 1).alias("high_gap"), (F.col("low") / F.col("close") - 1).alias("low_gap"), change(5).alias("mom5"), change(10).alias("mom10"), change(20).alias("mom20"),
        (F.col("volume") / F.avg("volume").over(w)).alias("turn"), F.when(F.count("ret").over(w) >= 20, F.stddev_samp("ret").over(w)).alias("vol20"),
    )
    x = x.select("id", "date", "fwd5", *(F.round(c, 9).alias(c) for c in _FEATURES))
    return x.dropna() if whole else x


def _conflicts(x):
    daily = written(diagnostics.daily_rank_correlations(x, [*_FEATURES, "fwd5"]), "daily")  # a row a date and pair, read twice
    pairs = diagnostics.agreement_of(daily.where("b <> 'fwd5'"), least=3).where(F.abs("agreement") >= 0.3)
    return diagnostics.conflict_groups(pairs, diagnostics.ic_of(daily, "fwd5", least=3))


@query(f"""RECURSIVE {BARS}, {FWD}, {_CG} SELECT grp AS "group", feature, count(*) OVER (PARTITION BY grp) AS size, {_rounded('ic AS ic_mean')}, row_number() OVER (PARTITION BY grp ORDER BY round(abs(ic), 9) DESC, feature) = 1 AS representative FROM co JOIN fi ON f = feature""")
def conflict_groups(spark, d):
    return _conflicts(_feature_table(spark, d))


_FACTS = """fa AS (SELECT o_custkey AS id, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS quarter, CAST(o_orderdate AS DATE) + (30 + floor(o_totalprice / 5000))::INT AS info_date, sum(o_totalprice) AS value FROM orders GROUP BY ALL), pb AS (SELECT DISTINCT o_custkey AS id, last_day(o_orderdate) AS day FROM orders)"""


def _facts(spark, d):
    orders = market.table(spark, d, "orders")
    facts = orders.groupBy(F.col("o_custkey").alias("id"), pointintime.quarter_of("o_orderdate").alias("quarter"), F.date_add(F.to_date("o_orderdate"), (30 + F.floor(F.col("o_totalprice") / 5000)).cast("int")).alias("info_date")).agg(F.sum("o_totalprice").alias("value"))
    return facts, orders.select(F.col("o_custkey").alias("id"), F.last_day("o_orderdate").alias("day")).distinct()


@query(f"""{_FACTS}, q AS (SELECT pb.*, unnest(range(year(day) * 4 + quarter(day) - 6, year(day) * 4 + quarter(day))) AS quarter FROM pb), k AS (SELECT q.*, fa.info_date, fa.value, row_number() OVER (PARTITION BY q.id, q.day ORDER BY q.quarter DESC) AS place FROM q ASOF JOIN fa ON fa.id = q.id AND fa.quarter = q.quarter AND fa.info_date <= q.day)
SELECT id, day, quarter::INT AS quarter, info_date, {_rounded('value', digits=2)}, place::INT AS place FROM k WHERE place <= 4""", digits=2)
def latest_quarters(spark, d):
    """The last four quarters of each customer's orders as published by the end of each month with an order; a later publication restates the quarter."""
    facts, probes = _facts(spark, d)
    return pointintime.latest_quarters(probes, facts, ["value"], date="day")


@query(f"""{_FACTS}, q AS (SELECT pb.*, fa.quarter, fa.info_date, fa.value FROM pb JOIN fa ON fa.id = pb.id AND fa.info_date <= day AND fa.quarter BETWEEN year(day) * 4 + quarter(day) - 6 AND year(day) * 4 + quarter(day) - 1)
SELECT id, day, quarter::INT AS quarter, info_date, {_rounded('value', digits=2)}, row_number() OVER (PARTITION BY id, day ORDER BY quarter DESC, info_date DESC)::INT AS place FROM q""", digits=2)
def all_statements(spark, d):
    facts, probes = _facts(spark, d)
    return pointintime.latest_quarters(probes, facts, ["value"], statements="all", date="day")


_RANGES = "rg AS (SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS s, CAST(l_shipdate AS DATE) + floor(l_quantity / 5)::INT AS e FROM lineitem)"


def _ranges(spark, d):
    return market.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("start"), F.date_add(F.to_date("l_shipdate"), F.floor(F.col("l_quantity") / 5).cast("int")).alias("end"), F.date_add(F.to_date("l_shipdate"), F.floor(F.col("l_extendedprice") / 10000).cast("int")).alias("date"))


@query(f"""{_RANGES}, b AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg), g AS (SELECT *, sum((reach IS NULL OR s > reach + 1)::INT) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT key, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY key, run""")
def coverage_ranges(spark, d):
    return intervals.merged(_ranges(spark, d), ["key"])


@query(f"""{_RANGES}, a AS (SELECT DISTINCT l_suppkey AS key, CAST(l_shipdate AS DATE) + floor(l_extendedprice / 10000)::INT AS date FROM lineitem) SELECT key, date, EXISTS (SELECT 1 FROM rg WHERE rg.key = a.key AND a.date BETWEEN s AND e) AS covered FROM a""")
def covered_dates(spark, d):
    x = _ranges(spark, d)
    return intervals.covered(x.select("key", "date").distinct(), x, ["key"])


_LISTED = "li AS (SELECT o_orderkey AS id, o_custkey AS code, CAST(o_orderdate AS DATE) AS listed, CAST(o_orderdate AS DATE) + (30 + floor(o_totalprice / 1000))::INT AS delisted FROM orders)"


def _listings(spark, d):
    o = market.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("listed"), F.date_add(F.to_date("o_orderdate"), (30 + F.floor(F.col("o_totalprice") / 1000)).cast("int")).alias("delisted"))


@query(f"""{_LISTED}, x AS (SELECT *, max(delisted - 1) OVER (PARTITION BY code ORDER BY listed, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS taken_until FROM li) SELECT code, id, listed, delisted, taken_until, (least(taken_until, delisted - 1) - listed + 1)::INT AS days FROM x WHERE taken_until >= listed""")
def code_clashes(spark, d):
    return intervals.clashes(_listings(spark, d))


@query(f"""{_LISTED}, p AS (SELECT DISTINCT o_custkey AS code, last_day(o_orderdate) AS date FROM orders), j AS (SELECT p.code, p.date, count(li.id) AS active, max(li.id) AS top FROM p LEFT JOIN li ON li.code = p.code AND listed <= date AND date < delisted GROUP BY ALL)
SELECT code, date, active, CASE WHEN active = 1 THEN top END AS id, CASE active WHEN 1 THEN 'found' WHEN 0 THEN 'none' ELSE 'several' END AS status FROM j""")
def active_instruments(spark, d):
    o = market.table(spark, d, "orders")
    return intervals.active_on(o.select(F.col("o_custkey").alias("code"), F.last_day("o_orderdate").alias("date")).distinct(), _listings(spark, d))


@query(f"""{BARS}, m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS i, count(*) OVER (PARTITION BY id) AS n FROM bars), l AS (SELECT id, max(CASE WHEN i <= n // 2 THEN date END) AS last FROM m GROUP BY id) SELECT id, date, {_rounded('CASE WHEN last IS NULL OR date > last THEN 2 * close ELSE close END AS close', digits=4)} FROM m JOIN l USING (id)""", digits=4)
def incremental_bars(spark, d):
    """A first load of the older half of each instrument's bars, then twice a feed of all bars at doubled prices: only what follows an instrument's own last date is added, and once."""
    path = fresh_path(spark, "bars")
    bars = written(market.bars(spark, d).select("id", "date", "close"), "bars")  # the source of all deliveries
    older = bars.withColumn("_i", F.row_number().over(Window.partitionBy("id").orderBy("date"))).withColumn("_n", F.count("*").over(Window.partitionBy("id"))).where(F.col("_i") <= F.floor(F.col("_n") / 2)).drop("_i", "_n")
    feed = bars.withColumn("close", F.col("close") * 2)
    for number, batch in enumerate((older, feed, feed)):
        appends.append_batch(batch, number, path, ["id", "date"], "date")
    appends.append_batch(feed, 1, path, ["id", "date"], "date")  # delivered again
    return appends.appended(spark, path)

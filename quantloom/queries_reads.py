"""Queries of panel reads, universes and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import evaluation, features, reads, regime, universe
from quantloom.plans import research
from quantloom.queries import _FACTORS, BARS, FWD, WEIGHTS, _rounded, _top_weights, query
from quantloom.queries_portfolio import _KINDS, _kinds
from quantloom.queries_regime import _breadth, _industry_close, _market
from quantloom.queries_reviews import _REGIMES
from quantloom.queries_structure import _LISTED, _listings
from quantloom.sources import market


@query(f"""{BARS}, {_FACTORS}, o AS (SELECT id, arg_max(factor, ex_date) AS base FROM fx WHERE ex_date <= DATE '1996-06-30' GROUP BY id), g AS (SELECT adj.* EXCLUDE (f), f / coalesce(base, 1.0) AS f FROM adj LEFT JOIN o USING (id))
SELECT id, date, {_rounded('close * f AS close', 'volume / f AS volume')} FROM g WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND volume > 0""")
def price_panel(spark, d):
    """Half a year of pre-adjusted closes and volumes of all instruments."""
    return reads.prices(market.bars(spark, d), market.ex_factors(spark, d), None, "1996-01-01", "1996-06-30", ["close", "volume"], "pre", skip_suspended=True)


@query(f"""{BARS}, {_FACTORS}, g AS (SELECT id, date_trunc('month', date) AS p, date, open * f AS open, high * f AS high, low * f AS low, close * f AS close, volume / f AS volume FROM adj WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31')
SELECT id, max(date) AS date, {_rounded('arg_min(open, date) AS open', 'max(high) AS high', 'min(low) AS low', 'arg_max(close, date) AS close', 'sum(volume) AS volume', digits=4)} FROM g GROUP BY id, p""", digits=4)
def monthly_prices(spark, d):
    """Three years of post-adjusted bars by month, up to the day before the first of 1998."""
    return reads.prices(market.bars(spark, d), market.ex_factors(spark, d), None, "1995-01-01", None, ["open", "high", "low", "close", "volume"], "post", frequency="1m", today="1998-01-01")


@query(f"""{BARS}, c AS (SELECT date FROM cal WHERE date < DATE '1997-03-03' ORDER BY date DESC LIMIT 20) SELECT id, date, {_rounded('volume / nullif(avg(volume) OVER w, 0) AS turnover_rate', 'ret AS price_change')} FROM rets JOIN c USING (date) WINDOW w AS (PARTITION BY id)""")
def counted_panel(spark, d):
    """Turnover against its mean and price changes of the 20 trading days before a date."""
    x = features.with_returns(market.bars(spark, d)).select("id", "date", "volume", F.col("ret").alias("price_change"))
    y = reads.counted(x, market.calendar(spark, d), "1997-03-03", 20)
    return y.select("id", "date", R.ratio(F.col("volume"), F.avg("volume").over(Window.partitionBy("id"))).alias("turnover_rate"), "price_change")


_ASKS = "ak AS (SELECT DISTINCT s_suppkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier))"


def _asks(spark, d):
    """The instrument that a customer looks at and the day of each order."""
    s = market.table(spark, d, "supplier").select("s_suppkey")
    n = s.agg(F.count("*").alias("_n"))
    o = market.table(spark, d, "orders").crossJoin(F.broadcast(n)).withColumn("s_suppkey", F.col("o_custkey") % F.col("_n"))  # one row
    return o.join(s, "s_suppkey").select(F.col("s_suppkey").alias("id"), F.to_date("o_orderdate").alias("date")).distinct()


@query(f"{BARS}, {_ASKS} SELECT ak.id, ak.date, {_rounded('open', 'close', 'volume', digits=4)} FROM ak LEFT JOIN bars ON bars.id = ak.id AND bars.date = ak.date", digits=4)
def bars_on_dates(spark, d):
    return reads.bars_on(market.bars(spark, d), _asks(spark, d), ["open", "close", "volume"])


@query(f"{BARS}, {_ASKS} SELECT ak.id, ak.date, {_rounded('open', 'volume', 'turnover', 'open AS last', digits=4)}, limit_up IS NULL AS no_limits FROM ak LEFT JOIN (SELECT *, NULL AS limit_up FROM bars) b ON b.id = ak.id AND b.date = ak.date", digits=4)
def auction_bars(spark, d):
    """NaN, which these bars have no limits for, is shown as null."""
    x = reads.auction_bars(market.bars(spark, d), _asks(spark, d))
    null = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return x.select("id", "date", null("open"), null("volume"), null("turnover"), null("last"), F.isnan("limit_up").alias("no_limits"))


_DIV = "dv AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS ex_date, sum(l_extendedprice * l_discount) / sum(l_quantity) AS dividend FROM lineitem WHERE l_discount >= 0.09 GROUP BY ALL)"


@query(f"""{_DIV}, ls AS (SELECT id, date FROM (SELECT l_suppkey AS id, max(CAST(l_shipdate AS DATE)) - 365 AS date FROM lineitem GROUP BY 1)) SELECT dv.id, date AS as_of, ex_date, round(dividend, 5) AS dividend, row_number() OVER (PARTITION BY dv.id ORDER BY ex_date)::INT AS place FROM dv JOIN ls ON ls.id = dv.id AND ex_date <= date AND ex_date >= DATE '1993-01-01'""", digits=5)
def dividends_until(spark, d):
    """Dividends, the discounts of at least nine percent by day, that each instrument paid up to a year before its last day, from 1993 on."""
    line = market.table(spark, d, "lineitem").withColumn("ex_date", F.to_date("l_shipdate"))
    events = line.where("l_discount >= 0.09").groupBy(F.col("l_suppkey").alias("id"), "ex_date").agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.sum("l_quantity")).alias("dividend"))
    asks = line.groupBy(F.col("l_suppkey").alias("id")).agg(F.date_sub(F.max("ex_date"), 365).alias("date"))
    return reads.events_until(events, asks, start="1993-01-01")


@query(f"""{BARS}, {_FACTORS}, ls AS (SELECT id, max(date) AS date FROM bars GROUP BY id), sp AS (SELECT id, ex_date, factor / coalesce(lag(factor) OVER (PARTITION BY id ORDER BY ex_date), 1) AS ratio FROM fx) SELECT sp.id, date AS as_of, ex_date, round(ratio, 6) AS ratio, row_number() OVER (PARTITION BY sp.id ORDER BY ex_date)::INT AS place FROM sp JOIN ls ON ls.id = sp.id AND ex_date <= date""")
def splits_until(spark, d):
    f = market.ex_factors(spark, d)
    ratio = F.col("factor") / F.coalesce(F.lag("factor").over(Window.partitionBy("id").orderBy("ex_date")), F.lit(1.0))
    asks = market.bars(spark, d).groupBy("id").agg(F.max("date").alias("date"))
    return reads.events_until(f.select("id", "ex_date", ratio.alias("ratio")), asks)


_SUSP = "sf AS (SELECT DISTINCT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08)"


@query(f"{_SUSP}, {_ASKS} SELECT ak.id, ak.date, CASE WHEN ak.id IN (SELECT id FROM sf) THEN sf.id IS NOT NULL END AS flag FROM ak LEFT JOIN sf ON sf.id = ak.id AND sf.date = ak.date")
def suspended_on_dates(spark, d):
    flags = market.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.08").select(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date"))
    return reads.flagged(flags, _asks(spark, d))


@query(f"""{_LISTED}, p AS (SELECT id, unnest([listed - 1, listed, delisted, delisted + 1]) AS date FROM li) SELECT p.id, p.date, listed <= p.date AS listed, p.date > delisted AS delisted, listed <= p.date AND p.date <= delisted AS active FROM p JOIN li USING (id)""")
def listing_states(spark, d):
    """The days around each future's first and last."""
    li = _listings(spark, d)
    days = F.array(F.date_sub("listed", 1), "listed", "delisted", F.date_add("delisted", 1))
    return reads.listing_state(li.select("id", F.explode(days).alias("date")), li, futures=True)


@query(f"{BARS} SELECT date, seq::INT AS seq FROM cal WHERE date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' ORDER BY date DESC LIMIT 250")
def last_trading_days(spark, d):
    return reads.calendar_slice(market.calendar(spark, d), "1994-01-01", "1996-12-31", 250)


@query(f"""{BARS}, sz AS (SELECT l_suppkey AS id, CAST(l_shipdate AS DATE) AS at, sum(l_extendedprice) AS size FROM lineitem WHERE l_tax >= 0.06 GROUP BY ALL), a AS (SELECT bars.id, bars.date, close, size FROM bars ASOF LEFT JOIN sz ON sz.id = bars.id AND sz.at <= bars.date) SELECT id, date, round(close, 4) AS close FROM a WHERE size IS NULL OR size >= 30000""", digits=4)
def large_funds(spark, d):
    sizes = market.table(spark, d, "lineitem").where("l_tax >= 0.06").groupBy(F.col("l_suppkey").alias("id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("size"))
    return universe.large_enough(market.bars(spark, d).select("id", "date", "close"), sizes, 30000.0)


@query(f"""{BARS}, lc AS (SELECT l_suppkey AS id, min(CAST(l_shipdate AS DATE)) + 100 AS listed, CASE WHEN l_suppkey % 2 = 0 THEN max(CAST(l_shipdate AS DATE)) - 200 END AS delisted FROM lineitem GROUP BY 1) SELECT bars.id, date, round(close, 4) AS close FROM bars JOIN lc ON lc.id = bars.id WHERE listed <= date AND (delisted IS NULL OR date < delisted)""", digits=4)
def point_in_time_members(spark, d):
    """Bars within an instrument's listed life, those of the delisted included."""
    g = market.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.date_add(F.min(F.to_date("l_shipdate")), 100).alias("listed"), F.date_sub(F.max(F.to_date("l_shipdate")), 200).alias("_d"))
    listings = g.select("id", "listed", F.when(F.col("id") % 2 == 0, F.col("_d")).alias("delisted"))
    return universe.members_at(market.bars(spark, d).select("id", "date", "close"), listings)


@query(f"""{BARS}, {_KINDS}, x AS (SELECT inst.id, asset_type, CASE WHEN inst.id = 3 THEN 'core' WHEN inst.sector IN ('ASIA', 'EUROPE') THEN lower(inst.sector) WHEN asset_type = 'etf' THEN 'core' ELSE 'satellite' END AS layer FROM inst JOIN kd USING (id)) SELECT id, layer FROM x QUALIFY row_number() OVER (PARTITION BY layer ORDER BY id) <= CASE layer WHEN 'asia' THEN 5 WHEN 'core' THEN 20 ELSE 1000000 END""")
def layered_universe(spark, d):
    x = market.instruments(spark, d).join(_kinds(spark, d).select("id", "asset_type"), "id").withColumn("layer", F.col("sector"))
    limits = {"asia": 5, "europe": None, "core": 20, "satellite": None}
    return universe.layered_universe(x, {3: "core"}, {"etf": "core", "stock": "satellite"}, limits).select("id", "layer")


@query(f"""{BARS}, {FWD}, {_KINDS}, m AS (SELECT id, date, CASE WHEN asset_type = 'etf' THEN mom20 END AS mom20, reversal FROM sig JOIN kd USING (id)) SELECT id, date, {_rounded('mom20', 'reversal')} FROM m""")
def masked_feature(spark, d):
    x = features.momentum(market.bars(spark, d)).join(_kinds(spark, d), "id").select("id", "date", "asset_type", "mom20", "reversal")
    return universe.masked(x, ["mom20"], "etf").drop("asset_type")


# Which two families of factors a regime reads.
FAMILIES = {"bull_co_move": ("trend", "volume"), "bull_rotation": ("momentum", "trend"), "range_co_move": ("oscillator", "volatility"), "range_rotation": ("momentum", "oscillator"), "bear_co_move": ("volatility", "volume"), "bear_rotation": ("momentum", "volatility")}


def _on(family: str) -> str:
    return "rr IN (" + ", ".join(f"'{r}'" for r, fs in FAMILIES.items() if family in fs) + ")"


@query(f"""{BARS}, {_REGIMES}, fx AS (SELECT id, date, close - lag(close, 10) OVER h AS mom, close / avg(close) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS trend, volume / avg(volume) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol FROM bars WINDOW h AS (PARTITION BY id ORDER BY date)), j AS (SELECT fx.*, coalesce(regime, 'range_co_move') AS rr FROM fx LEFT JOIN rg USING (date))
SELECT id, date, rr AS regime, {_rounded(f"CASE WHEN {_on('momentum')} THEN mom END AS mom", f"CASE WHEN {_on('trend')} THEN trend END AS trend", f"CASE WHEN {_on('volume')} THEN vol END AS vol", digits=4)} FROM j""", digits=4)
def factors_by_regime(spark, d):
    h = Window.partitionBy("id").orderBy("date")
    w = h.rowsBetween(-19, 0)
    x = market.bars(spark, d).select("id", "date", (F.col("close") - F.lag("close", 10).over(h)).alias("mom"), (F.col("close") / F.avg("close").over(w) - 1).alias("trend"), (F.col("volume") / F.avg("volume").over(w)).alias("vol"))
    states = regime.regimes(regime.trend_and_direction(_market(spark, d)), regime.rotation(_industry_close(spark, d), _breadth(spark, d)))
    return universe.by_regime(x, states, FAMILIES, {"momentum": ["mom"], "trend": ["trend"], "volume": ["vol"]}, "range_co_move")


@query(f"{BARS} SELECT id FROM inst WHERE sector = 'EUROPE'")
def sector_members(spark, d):
    return universe.members_of(market.instruments(spark, d), "sector", "Europe")


@query(f"""{BARS}, {FWD}, v AS (SELECT id, date, CASE WHEN count(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol20 FROM rets), o AS (SELECT s_suppkey AS id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS flow FROM orders JOIN supplier ON s_suppkey = o_custkey % (SELECT count(*) FROM supplier) GROUP BY ALL)
SELECT coalesce(v.id, o.id) AS id, coalesce(v.date, o.date) AS date, {_rounded('vol20', 'mom20', 'flow', digits=4)} FROM v LEFT JOIN sig ON sig.id = v.id AND sig.date = v.date FULL JOIN o ON o.id = v.id AND o.date = v.date""", digits=4)
def merged_panels(spark, d):
    """Volatility, momentum and order flow in one panel, whichever of them a day has."""
    w = R.last_n(20)
    vol = features.with_returns(market.bars(spark, d)).select("id", "date", F.when(F.count("ret").over(w) >= 20, F.stddev_samp("ret").over(w)).alias("vol20"))
    mom = features.momentum(market.bars(spark, d)).select("id", "date", "mom20")
    n = market.table(spark, d, "supplier").agg(F.count("*").alias("_n"))
    flow = market.table(spark, d, "orders").crossJoin(F.broadcast(n)).groupBy((F.col("o_custkey") % F.col("_n")).alias("id"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("flow"))  # one row
    return universe.merged_panels([vol, mom, flow])


@query(f"{BARS}, {FWD}, {WEIGHTS} SELECT w.date, w.id, {_rounded('weight', 'fwd5')} FROM wts w JOIN fwd USING (id, date) WHERE fwd5 IS NOT NULL")
def labelled_weights(spark, d):
    """Weights of the dates on which every one has its label, which the strict join asks for."""
    labels = research.panel(market.bars(spark, d)).select("date", "id", "fwd5").where("fwd5 is not null")
    known = _top_weights(spark, d).join(labels, ["date", "id"], "left_semi")
    return universe.labelled(known, labels, "fwd5")


@query(f"""{BARS}, {FWD}, r AS (SELECT date, year(date) AS y, rank() OVER (PARTITION BY date ORDER BY reversal) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, fwd5) - 1) / 2.0 AS b FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL),
q AS (SELECT date, year(date) AS y, rank() OVER (PARTITION BY date ORDER BY mom20) + (count(*) OVER (PARTITION BY date, mom20) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, fwd5) - 1) / 2.0 AS b FROM pan WHERE mom20 IS NOT NULL AND fwd5 IS NOT NULL),
b0 AS (SELECT y AS fold, avg(ic) AS ic FROM (SELECT date, y, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM r GROUP BY ALL HAVING count(*) >= 5) GROUP BY y), c0 AS (SELECT y AS fold, avg(ic) AS ic FROM (SELECT date, y, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM q GROUP BY ALL HAVING count(*) >= 5) GROUP BY y)
SELECT fold, make_date(fold::BIGINT, 1, 1) AS test_start, {_rounded('b0.ic AS baseline_ic', 'c0.ic AS candidate_ic', 'c0.ic - b0.ic AS delta_ic')} FROM b0 JOIN c0 USING (fold)""")
def aligned_folds(spark, d):
    p = research.panel(market.bars(spark, d))
    by = lambda s: evaluation.rank_ic(p, s, "fwd5").groupBy(F.year("date").alias("fold")).agg(F.avg("ic").alias("ic")).withColumn("test_start", F.make_date("fold", F.lit(1), F.lit(1)))
    return universe.aligned_folds(by("reversal"), by("mom20"), ["ic"])


@query("""c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), b AS (SELECT CAST(l_shipdate AS DATE) AS at, sum(l_extendedprice) / sum(l_quantity) AS bench FROM lineitem WHERE l_shipmode_like GROUP BY 1), j AS (SELECT c.date, bench FROM c ASOF LEFT JOIN b ON b.at <= c.date) SELECT date, round(bench, 5) AS bench, round(bench / lag(bench) OVER (ORDER BY date) - 1, 5) AS ret FROM j""".replace("l_shipmode_like", "l_discount >= 0.05"), digits=5)
def foreign_benchmark(spark, d):
    """The benchmark of the well discounted line items on the calendar of the orders."""
    line = market.table(spark, d, "lineitem").where("l_discount >= 0.05")
    b = line.groupBy(F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("bench"))
    return universe.on_calendar(b, market.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct(), "bench")


@query(f"""{BARS}, g AS (SELECT id, count(*) AS observed, max(seq) - min(seq) + 1 AS expected FROM bars JOIN cal USING (date) GROUP BY id) SELECT id, expected, observed, expected - observed AS missing, round((expected - observed) / expected, 6) AS gap_rate, (expected - observed) / expected > 0.05 AS flagged FROM g""")
def coverage_gaps(spark, d):
    return universe.coverage_gaps(market.bars(spark, d), market.calendar(spark, d))


@query(f"""{BARS}, {FWD}, m AS (SELECT date_trunc('month', date)::DATE AS month, covar_pop(reversal, fwd5) / nullif(var_pop(reversal), 0) AS slope, count(*) AS n FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL GROUP BY 1), f AS (SELECT (month + INTERVAL 2 MONTH)::DATE AS fitted, slope FROM m WHERE n >= 10) SELECT c.date, fitted, round(slope, 5) AS slope FROM (SELECT date FROM cal) c ASOF LEFT JOIN f ON f.fitted <= c.date""", digits=5)
def nearest_fits(spark, d):
    """For each trading date the slope fitted on the latest month whose labels are known by then."""
    p = research.panel(market.bars(spark, d)).where("reversal is not null and fwd5 is not null")
    m = p.groupBy(F.trunc("date", "month").alias("month")).agg(R.ratio(F.covar_pop("reversal", "fwd5"), F.var_pop("reversal")).alias("slope"), F.count("*").alias("n")).where("n >= 10")
    return universe.nearest_fit(market.calendar(spark, d).select("date"), m.select(F.add_months("month", 2).alias("fitted"), "slope"), "fitted", ["slope"])


_GRID = [(k, t) for k in (5, 10, 20) for t in (0.0, 0.05)]


@query(f"""{BARS}, {FWD}, s AS (SELECT date, id, mom20, fwd5, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, id) AS i FROM pan WHERE mom20 IS NOT NULL AND fwd5 IS NOT NULL), dn AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM (SELECT DISTINCT date FROM pan)), g AS (SELECT * FROM (VALUES {', '.join(f'({k}, {t}::DOUBLE)' for k, t in _GRID)}) t(k, least)),
x AS (SELECT k, least, n, id, fwd5, 1.0 / count(*) OVER (PARTITION BY k, least, n) AS w FROM s JOIN dn USING (date) JOIN g ON i <= k AND mom20 >= least), dd AS (SELECT k, least, n, avg(fwd5) AS r, count(*) AS c, avg((fwd5 > 0)::INT) AS h FROM x GROUP BY ALL),
t AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.least, b.least) AS least, coalesce(a.n, b.n + 1) AS n, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS t FROM x a FULL JOIN x b ON a.k = b.k AND a.least = b.least AND a.id = b.id AND a.n = b.n + 1 GROUP BY 1, 2, 3)
SELECT dd.k, dd.least, count(*) AS dates, {_rounded('avg(dd.r) AS mean_label', 'avg(dd.h) AS hit_rate', 'avg(CASE WHEN p.n IS NOT NULL THEN t END) AS turnover', digits=5)}, sum(dd.c)::BIGINT AS picks FROM dd LEFT JOIN dd p ON p.k = dd.k AND p.least = dd.least AND p.n = dd.n - 1 LEFT JOIN t ON t.k = dd.k AND t.least = dd.least AND t.n = dd.n GROUP BY dd.k, dd.least""", digits=5)
def parameter_sweep(spark, d):
    p = research.panel(market.bars(spark, d)).select("date", "id", "mom20", "fwd5")
    return universe.swept(p, "mom20", "fwd5", [5, 10, 20], [0.0, 0.05])


@query(f"""{BARS}, b AS (SELECT id, date, close AS price, prev * 1.4 AS limit_up, prev * 0.7 AS limit_down, volume < 3 AS suspended, floor(volume) AS closable, floor(volume - lag(volume, 1, 0) OVER (PARTITION BY id ORDER BY date)) AS change FROM rets),
w AS (SELECT *, CASE WHEN suspended THEN 'suspended' WHEN price IS NULL THEN 'no_price' WHEN change > 0 AND coalesce(price >= limit_up, false) THEN 'limit_up' WHEN change < 0 AND coalesce(price <= limit_down, false) THEN 'limit_down' END AS why FROM b) SELECT id, date, change, why AS blocked, CASE WHEN why IS NOT NULL THEN 0 ELSE greatest(change, -closable) END AS allowed FROM w""")
def blocked_orders(spark, d):
    h = Window.partitionBy("id").orderBy("date")
    p = F.lag("close").over(h)
    x = market.bars(spark, d).select("id", "date", F.col("close").alias("price"), (p * 1.4).alias("limit_up"), (p * 0.7).alias("limit_down"), (F.col("volume") < 3).alias("suspended"), F.floor("volume").cast("double").alias("closable"), F.floor(F.col("volume") - F.lag("volume", 1, 0.0).over(h)).cast("double").alias("change"))
    return universe.blocked(x).select("id", "date", "change", "blocked", "allowed")


_NAME = "CASE WHEN l_partkey % 7 = 0 THEN 'IF' || CASE WHEN l_partkey % 2 = 0 THEN '88' ELSE '2403' END ELSE lpad((l_partkey * 37 + l_suppkey * 4999)::VARCHAR, 6, '0') || '.' || CASE l_linestatus WHEN 'O' THEN 'xshg' ELSE 'XSHE' END END"


@query(f"""n AS (SELECT DISTINCT {_NAME} AS name, l_partkey AS code FROM lineitem) SELECT name, code, CASE WHEN name LIKE '%.%' THEN upper(split_part(name, '.', 2)) END AS exchange, split_part(name, '.', 1) LIKE '51%' OR split_part(name, '.', 1) LIKE '159%' OR split_part(name, '.', 1) LIKE '58%' AS fund,
regexp_full_match(name, '[0-9]{{6}}[.](XSHE|XSHG|BJSE)') AS equity, regexp_full_match(name, '[A-Z]+(88|99|888|889)([A-Z][0-9]+)?') AS continuous, nullif(regexp_extract(name, '[0-9]{{6}}'), '') AS digits, lpad(code::VARCHAR, 6, '0') || CASE WHEN left(lpad(code::VARCHAR, 6, '0'), 1) IN ('5', '6', '9') THEN '.XSHG' WHEN left(lpad(code::VARCHAR, 6, '0'), 1) IN ('4', '8') THEN '.BJSE' ELSE '.XSHE' END AS listed FROM n""")
def instrument_ids(spark, d):
    """Ids made of the keys of line items, and what they tell."""
    from quantloom.functions import scalars as S

    code = F.lpad((F.col("l_partkey") * 37 + F.col("l_suppkey") * 4999).cast("string"), 6, "0")
    share = F.concat(code, F.lit("."), F.when(F.col("l_linestatus") == "O", "xshg").otherwise("XSHE"))
    future = F.concat(F.lit("IF"), F.when(F.col("l_partkey") % 2 == 0, "88").otherwise("2403"))
    n = market.table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 7 == 0, future).otherwise(share).alias("name"), F.col("l_partkey").alias("code")).distinct()
    c = F.col("name")
    return n.select("name", "code", S.exchange_of(c).alias("exchange"), S.is_fund(c).alias("fund"), S.is_equity(c).alias("equity"), S.is_continuous(c).alias("continuous"), S.code_of(c).alias("digits"), S.listed_id(F.col("code")).alias("listed"))


@query(f"""{BARS}, {FWD}, a AS (SELECT year(date) AS fold, date, id, reversal AS score FROM pan WHERE reversal IS NOT NULL), b AS (SELECT year(date) AS fold, date, id, fwd5 AS label FROM pan WHERE fwd5 IS NOT NULL AND month(date) > 3) SELECT fold, date, id, {_rounded('score', 'label')} FROM a JOIN b USING (fold, date, id)""")
def fold_panel(spark, d):
    """Scores and labels of several folds stacked, joined on fold, date and id."""
    p = research.panel(market.bars(spark, d)).withColumn("fold", F.year("date"))
    scores = p.where("reversal is not null").select("fold", "date", "id", F.col("reversal").alias("score"))
    return universe.panel_join(scores, p.where("fwd5 is not null and month(date) > 3").select("fold", "date", "id", F.col("fwd5").alias("label")))

"""Queries of universe filters, calibration, gates and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import features, gates, labels
from quantloom.plans import research
from quantloom.queries import _PORT, BARS, FWD, WEIGHTS, _portfolio, _rounded, _top_weights, query
from quantloom.queries_portfolio import _KINDS, _NET, _QUARTERS, _kinds, _net, _quarters
from quantloom.sources import market


@query(f"""{BARS}, fl AS (SELECT id, date, count_if(q > 45) > 0 AS flag FROM line GROUP BY ALL), x AS (SELECT b.id, b.date, b.close, fl.flag FROM bars b ASOF LEFT JOIN fl ON b.id = fl.id AND b.date > fl.date) SELECT id, date, {_rounded('close')} FROM x WHERE NOT coalesce(flag, false)""")
def unflagged_bars(spark, d):
    """Bars of instruments whose last trading day before had no trade above 45 units."""
    line = market.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.date_add(F.to_date("l_shipdate"), 1).alias("date"), (F.col("l_quantity") > 45).alias("flag"))
    flags = line.groupBy("id", "date").agg(F.bool_or("flag").alias("flag"))
    return gates.without_flagged(market.bars(spark, d).select("id", "date", "close"), flags, "flag")


@query(f"""{BARS}, s AS (SELECT id, arg_max(turnover, date) AS cap FROM bars GROUP BY id) SELECT id, round(cap, 6) AS cap FROM s WHERE cap >= (SELECT quantile_cont(cap, 0.3) FROM s)""")
def size_floor(spark, d):
    s = market.bars(spark, d).groupBy("id").agg(F.max_by("turnover", "date").alias("cap"))
    return gates.above_quantile(s, "cap", 0.3)


@query("""c AS (SELECT c_custkey AS id, c_acctbal AS a, c_acctbal / 100 AS b FROM customer), m AS (SELECT median(abs(a)) AS ma, median(abs(b)) AS mb FROM c) SELECT id, round(greatest(-1000, least(10000, a)) / CASE WHEN ma > 100 THEN 10000 WHEN ma > 1 THEN 100 ELSE 1 END, 6) AS a, round(greatest(-1000, least(10000, b)) / CASE WHEN mb > 100 THEN 10000 WHEN mb > 1 THEN 100 ELSE 1 END, 6) AS b FROM c, m""")
def rescaled_ratios(spark, d):
    c = market.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_acctbal") / 100).alias("b"))
    return gates.rescaled(c, ["a", "b"])


@query(f"""{BARS}, {FWD}, s AS (SELECT date, id, mom20 AS w FROM sig WHERE mom20 > 0) SELECT date, id, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM s""")
def sane_weights(spark, d):
    return gates.sane_weights(features.momentum(market.bars(spark, d)).select("date", "id", F.col("mom20").alias("weight")))


@query(f"""{BARS}, {FWD}, x AS (SELECT reversal AS s, fwd5 AS y FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL), e AS (SELECT quantile_cont(s, [0.2, 0.4, 0.6, 0.8]) AS e, avg((y > 0)::INT) AS al FROM x), b AS (SELECT len(list_filter(e, lambda v: v < s)) + 1 AS bucket, y FROM x, e), g AS (SELECT bucket, count(*) AS n, avg((y > 0)::INT) AS h FROM b GROUP BY 1), k AS (SELECT unnest(range(1, 6)) AS bucket)
SELECT bucket::INT AS bucket, {_rounded('CASE WHEN bucket > 1 THEN e[bucket - 1] END AS lower', 'CASE WHEN bucket < 5 THEN e[bucket] END AS upper', 'coalesce(h, al) AS hit_rate')}, coalesce(n, 0) AS n FROM k CROSS JOIN e LEFT JOIN g USING (bucket)""")
def score_calibrator(spark, d):
    return gates.calibrator(research.panel(market.bars(spark, d)), "reversal", "fwd5")


_GATE = """mt AS (SELECT 'mean' AS metric, avg(ret) AS value FROM port UNION ALL SELECT 'worst', min(ret) FROM port UNION ALL SELECT 'days', count(*)::DOUBLE FROM port), ru AS (SELECT * FROM (VALUES ('mean', '>=', 0.0, true), ('worst', '>=', -0.5, false), ('days', '>=', 60.0, true), ('absent', '<=', 1.0, false)) t(metric, sense, lim, hard)),
ev AS (SELECT ru.*, value, coalesce(CASE sense WHEN '>=' THEN value >= lim ELSE value <= lim END, false) AS passes FROM ru LEFT JOIN mt USING (metric))"""


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_GATE} SELECT metric, sense, lim AS "limit", hard, round(value, 6) AS value, passes, bool_and(passes OR NOT hard) OVER () AS promoted FROM ev""")
def promotion_gate(spark, d):
    g = _portfolio(spark, d).agg(F.avg("ret").alias("mean"), F.min("ret").alias("worst"), F.count("*").cast("double").alias("days"))
    return gates.gate(g.unpivot([], ["mean", "worst", "days"], "metric", "value"), {"mean": (">=", 0.0, True), "worst": (">=", -0.5, False), "days": (">=", 60.0, True), "absent": ("<=", 1.0, False)})


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_KINDS}, v AS (SELECT asset_type AS variant, avg(fwd1) AS m, count(fwd1) AS n FROM fwd JOIN kd USING (id) GROUP BY 1) SELECT variant, round(m - (SELECT m FROM v WHERE variant = 'stock'), 6) AS delta_m, n - (SELECT n FROM v WHERE variant = 'stock') AS delta_n FROM v""")
def variant_deltas(spark, d):
    v = labels.forward_returns(market.bars(spark, d)).join(_kinds(spark, d), "id").groupBy(F.col("asset_type").alias("variant")).agg(F.avg("fwd1").alias("m"), F.count("fwd1").alias("n"))
    return gates.deltas(v, "variant", "stock", ["m", "n"])


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_PORT}, p AS (SELECT * FROM (VALUES ('spring', DATE '1996-03-01', DATE '1996-05-31'), ('late', DATE '1997-10-01', DATE '1997-12-31'), ('never', DATE '2030-01-01', DATE '2030-02-01')) t(period, a, b)), e AS (SELECT min(date) AS lo, max(date) AS hi FROM port)
SELECT period, count(ret) AS days, round(exp(sum(ln(1 + ret / 100))) - 1, 6) AS total FROM p JOIN e ON lo <= a AND hi >= b JOIN port ON date BETWEEN a AND b GROUP BY period""")
def stress_periods(spark, d):
    daily = _portfolio(spark, d).withColumn("ret", F.col("ret") / 100)
    return gates.stressed(daily, {"spring": ("1996-03-01", "1996-05-31"), "late": ("1997-10-01", "1997-12-31"), "never": ("2030-01-01", "2030-02-01")})


@query(f"{BARS}, {FWD}, {WEIGHTS}, {_PORT}, {_NET} SELECT {_rounded('avg(CASE WHEN ret > 0 THEN ret END) / avg(CASE WHEN ret < 0 THEN -ret END) AS profit_loss', 'sum(turnover) AS turnover', 'avg(turnover) AS mean_turnover')}, count(*) AS days FROM net")
def profit_loss(spark, d):
    return gates.profit_loss(_net(spark, d))


@query(f"""{BARS}, {FWD}, {WEIGHTS}, {_QUARTERS}, bq AS (SELECT year(date) * 4 + quarter(date) - 1 AS quarter, arg_max(bench, date) AS c FROM bench GROUP BY 1), br AS (SELECT quarter, c / lag(c) OVER (ORDER BY quarter) - 1 AS b FROM bq)
SELECT CASE WHEN b > 0.08 THEN 'bull' WHEN b < -0.08 THEN 'bear' ELSE 'flat' END AS environment, count(*) AS quarters, round(avg(score), 4) AS score FROM qt JOIN br USING (quarter) WHERE b IS NOT NULL GROUP BY 1""", digits=4)
def market_environments(spark, d):
    from pyspark.sql import Window

    b = market.benchmark(spark, d).groupBy((F.year("date") * 4 + F.quarter("date") - 1).alias("quarter")).agg(F.max_by("bench", "date").alias("c"))
    b = b.select("quarter", (R.ratio(F.col("c"), F.lag("c").over(Window.orderBy("quarter"))) - 1).alias("bench"))  # one row a quarter
    return gates.environments(_quarters(spark, d).join(b, "quarter"), "score", "bench")


_DOMINANT = """dm AS (SELECT id % 5 AS id, date, min(id) AS contract, arg_min(close, id) AS close, arg_min(coalesce(prev, open), id) AS prev_close FROM rets GROUP BY 1, 2), dr AS (SELECT *, lag(close) OVER h AS was, coalesce(lag(contract) OVER h <> contract, false) AS roll FROM dm WINDOW h AS (PARTITION BY id ORDER BY date))"""


@query(f"""{BARS}, {_DOMINANT}, s AS (SELECT *, ln(CASE WHEN roll THEN prev_close / was ELSE 1 END) AS r, CASE WHEN roll THEN prev_close - was ELSE 0 END AS df FROM dr) SELECT id, date, {_rounded('close + coalesce(sum(df) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS adjusted', digits=3)} FROM s""", digits=3)
def dominant_series(spark, d):
    b = features.with_returns(market.bars(spark, d)).withColumn("prev", F.lag("close").over(R.history()))
    own = F.struct("close", F.coalesce("prev", "open").alias("prev_close"))
    dm = b.groupBy((F.col("id") % 5).alias("id"), "date").agg(F.min("id").alias("contract"), F.min_by(own, "id").alias("x")).select("id", "date", "contract", "x.close", "x.prev_close")
    return gates.dominant_adjusted(dm, "difference")


@query("""q AS (SELECT o_custkey % 50 AS id, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS quarter, sum(o_totalprice) AS x FROM orders GROUP BY ALL) SELECT id, quarter, round(x, 4) AS x, round((x - lag(x, 4) OVER h) / nullif(abs(lag(x, 4) OVER h), 0), 4) AS growth FROM q WINDOW h AS (PARTITION BY id ORDER BY quarter)""", digits=4)
def quarter_growth(spark, d):
    o = market.table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("id"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("quarter")).agg(F.sum("o_totalprice").alias("x"))
    return gates.grown(o, "x")


@query(f"""{BARS}, {FWD}, p AS (SELECT date, id, percent_rank() OVER (PARTITION BY date ORDER BY mom20) AS a, percent_rank() OVER (PARTITION BY date ORDER BY -reversal) AS b FROM sig WHERE mom20 IS NOT NULL AND reversal IS NOT NULL)
SELECT date, id, (a >= 0.9)::INT + (b >= 0.9)::INT AS hot, round(CASE WHEN a <= 0.2 THEN 1 WHEN a <= 0.8 THEN 1 - (a - 0.2) * 0.7 / 0.6 ELSE 0.3 END, 6) AS weight FROM p""")
def heat_and_weight(spark, d):
    from pyspark.sql import Window

    p = features.momentum(market.bars(spark, d)).where("mom20 is not null and reversal is not null")
    at = lambda c: F.percent_rank().over(Window.partitionBy("date").orderBy(c))
    x = p.select("date", "id", at(F.col("mom20")).alias("a"), at(-F.col("reversal")).alias("b"))
    return gates.hot_signals(x, ["a", "b"]).withColumn("weight", gates.curve_weight(F.col("a"), [(0.2, 1.0), (0.8, 0.3)])).select("date", "id", "hot", "weight")


@query(f"""{BARS}, {FWD}, {_KINDS}, x AS (SELECT date, id, reversal AS s, 1.0 / (1 + id % 3) AS confidence, abs(mom20) AS risk, asset_type FROM sig JOIN kd USING (id) WHERE reversal IS NOT NULL)
SELECT date, id, round(greatest(s - 0.01, 0) * confidence * CASE asset_type WHEN 'etf' THEN 0.5 ELSE 1 END / (1 + coalesce(risk, 0)), 6) AS shaped FROM x""")
def shaped_scores(spark, d):
    x = features.momentum(market.bars(spark, d)).join(_kinds(spark, d), "id").where("reversal is not null")
    x = x.select("date", "id", "reversal", "asset_type", (1.0 / (1 + F.col("id") % 3)).alias("confidence"), F.abs("mom20").alias("risk"))
    return gates.shaped(x, "reversal", 0.01, {"etf": 0.5}, "asset_type").select("date", "id", "shaped")


@query(f"""{BARS}, {FWD}, {WEIGHTS}, p AS (SELECT w.id, w.date, b.close AS price, avg(b.close) OVER (PARTITION BY w.id ORDER BY w.date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS cost FROM wts w JOIN bars b USING (id, date)) SELECT id, date, {_rounded('price', 'cost', 'price / cost - 1 AS unrealised')} FROM p WHERE price / cost - 1 <= -0.08""")
def stop_losses(spark, d):
    p = _top_weights(spark, d).join(market.bars(spark, d).select("id", "date", F.col("close").alias("price")), ["id", "date"])
    p = p.withColumn("cost", F.avg("price").over(R.next_n(-5, -1))).select("id", "date", "price", "cost")
    return gates.stopped_out(p)


@query("""e AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM e""")
def value_counts(spark, d):
    e = market.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = e.agg(F.sum("n").alias("_t"))
    return e.crossJoin(F.broadcast(total)).select("event_type", "n", (F.col("n") / F.col("_t")).alias("share"))  # one row

"""Queries of scalar functions and of signal tests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import scalars as S
from quantloom.operators import diagnostics, evaluation, features, significance
from quantloom.plans import research
from quantloom.queries import _RANKS, BARS, FWD, INDUSTRY, _industry, _rounded, query, w
from quantloom.sources import market


@query("""o AS (SELECT o_orderkey AS id, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS date, o_totalprice AS x, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
SELECT id, strftime(date, '%Y%m%d')::INT AS date_int, strftime(ts, '%Y%m%d%H%M%S')::BIGINT AS time_int, strptime(strftime(date, '%Y%m%d'), '%Y%m%d')::DATE AS back, year(date) * 4 + quarter(date) - 1 AS quarter,
((year(date) * 4 + quarter(date) + 2) // 4)::VARCHAR || 'q' || ((year(date) * 4 + quarter(date) + 2) % 4 + 1) AS next_year, (date + INTERVAL 18 MONTH)::DATE - 1 AS fold_end,
CASE st WHEN 'F' THEN 'buy' WHEN 'O' THEN 'sell' ELSE 'unknown' END AS side, CASE split_part(pr, '-', 2) WHEN 'URGENT' THEN 'urgent' ELSE lower(split_part(pr, '-', 2)) END AS kind,
CASE WHEN x < 0 THEN -1 ELSE 1 END * (floor(abs(x) / 100 + 0.5) * 100)::BIGINT AS lots, CASE WHEN id % 7 = 0 THEN 'E' WHEN id % 7 = 1 THEN 'M+' WHEN id % 7 = 2 THEN 'M' WHEN id % 7 = 3 THEN 'M-' ELSE 'I' END AS grade, round(abs(CASE WHEN id % 2 = 0 THEN x ELSE 2.0 * x END), 4) AS value FROM o""", digits=4)
def order_scalars(spark, d):
    o = market.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("x"), "o_orderstatus", "o_orderpriority")
    text = F.concat(F.year("date").cast("string"), F.lit("q"), F.quarter("date").cast("string"))
    score = F.element_at(F.array(F.lit(75.0), F.lit(30.0), F.lit(0.0), F.lit(-20.0), F.lit(-21.0), F.lit(-50.0), F.lit(-99.0)), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    return o.select(
        "id", S.date_int(F.col("date")).alias("date_int"), S.time_int(F.col("ts")).alias("time_int"), S.int_date(S.time_int(F.col("ts"))).alias("back"), S.quarter_number(text).alias("quarter"), S.quarter_text(S.quarter_number(text) + 3).alias("next_year"),
        S.months_end(F.col("date"), 18).alias("fold_end"), S.order_side(F.col("o_orderstatus")).alias("side"), S.asset_type(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("kind"), S.round_lot(F.col("x"), 100).alias("lots"), S.grade(score).alias("grade"),
        S.order_value(F.when(F.col("id") % 2 == 0, F.col("x")), F.col("x"), F.lit(2.0)).alias("value"),
    )


@query(f"""{BARS}, r AS (SELECT id, min(date) AS a, max(date) AS b FROM bars GROUP BY id), t AS (SELECT id, (b - a)::INT AS days FROM r)
SELECT id, days, CASE WHEN days >= 2555 THEN '7Y' WHEN days >= 2190 THEN '6Y' WHEN days >= 1825 THEN '5Y' WHEN days >= 1460 THEN '4Y' WHEN days >= 1095 THEN '3Y' WHEN days >= 730 THEN '2Y' WHEN days >= 365 THEN '1Y' WHEN days >= 270 THEN '9M' ELSE '6M' END AS tenor,
{_rounded('least(1, greatest(0, (days - 2000) / 600.0)) AS scaled', 'CASE WHEN days <= 1000 THEN 0.2 WHEN days <= 2400 THEN 0.2 + (days - 1000) * 0.6 / 1400 WHEN days <= 2600 THEN 0.8 + (days - 2400) * 0.2 / 200 ELSE 1 END AS piecewise')} FROM t""")
def history_tenors(spark, d):
    """Tenor for the length of each instrument's history, and the length on two scales."""
    r = market.bars(spark, d).groupBy("id").agg(F.datediff(F.max("date"), F.min("date")).alias("days"))
    x = F.col("days")
    return r.select("id", "days", S.tenor_for(x).alias("tenor"), S.scaled(x, 2000, 2600).alias("scaled"), S.piecewise(x, [(1000, 0.2), (2400, 0.8), (2600, 1.0)]).alias("piecewise"))


@query("""e AS (SELECT vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.id, list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) AS c FROM e a JOIN e b ON b.id = a.id + 1) SELECT id, round(c, 5) AS cosine FROM p""", digits=5)
def neighbour_cosine(spark, d):
    """Cosine similarity of each vector with the one of the next id."""
    e = market.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return e.join(e.select((F.col("id") - 1).alias("id"), F.col("v").alias("u")), "id").select("id", S.cosine(F.col("v"), F.col("u")).alias("cosine"))


@query(f"""{BARS}, {FWD}, {_RANKS}, n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM rk), k AS (SELECT *, greatest(1, least(10, CASE WHEN n >= 10 THEN n // 5 ELSE 1 END)) AS k FROM n WHERE n >= 2)
SELECT date, max(n) AS n, {_rounded('avg(CASE WHEN t <= k THEN fwd5 END) - avg(CASE WHEN n - t + 1 <= k THEN fwd5 END) AS spread', 'avg(CASE WHEN t <= k THEN (fwd5 > 0)::INT END) AS hit_rate')} FROM k GROUP BY date""")
def signal_layers(spark, d):
    return significance.layers(research.panel(market.bars(spark, d)), "reversal", "fwd5")


@query(f"""{BARS}, {FWD}, {_RANKS}, n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM rk), g AS (SELECT *, CASE WHEN t - 1 >= n * 4 // 5 THEN 4 WHEN t - 1 >= n * 3 // 5 THEN 3 WHEN t - 1 >= n * 2 // 5 THEN 2 WHEN t - 1 >= n // 5 THEN 1 ELSE 0 END AS g FROM n WHERE n >= 2),
d AS (SELECT date, {', '.join(f'avg(CASE WHEN g = {i} THEN fwd5 END) AS r{i}' for i in range(5))} FROM g GROUP BY date), o AS (SELECT {', '.join(f'coalesce(avg(r{i}), 0) AS group{i}' for i in range(5))}, avg(r0 - r4) AS long_short, coalesce(avg(r0 - r4) / nullif(stddev_pop(r0 - r4), 0), 0) AS long_short_ir, count(r0 - r4) AS dates FROM d),
u AS (SELECT 5 - i AS x, v FROM (SELECT unnest(range(0, 5)) AS i, unnest([group0, group1, group2, group3, group4]) AS v FROM o)), s AS (SELECT x, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS y FROM u), m AS (SELECT CASE WHEN count_if(v <> 0) >= 3 THEN coalesce(corr(x, y), 0) ELSE 0 END AS monotonicity FROM s)
SELECT {_rounded(*(f'group{i}' for i in range(5)), 'long_short', 'long_short_ir', 'monotonicity')}, dates FROM o, m""")
def group_backtest(spark, d):
    return significance.group_backtest(research.panel(market.bars(spark, d)), "reversal", "fwd5")


@query(f"""{BARS}, {FWD}, {_RANKS}, c AS (SELECT ic - avg(ic) OVER () AS c, ic, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM ic0 WHERE ic IS NOT NULL), l AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, round(4 * pow(n / 100.0, 2.0 / 9))::INT) END AS lags FROM c),
v AS (SELECT sum(CASE WHEN a.i = b.i THEN 1.0 ELSE 2 * (1 - (a.i - b.i) / (a.lags + 1.0)) END * a.c * b.c) AS v FROM l a JOIN l b ON a.i - b.i BETWEEN 0 AND a.lags), o AS (SELECT count(*) AS n, max(lags)::INT AS lags, avg(ic) AS mean FROM l)
SELECT n, lags, {_rounded('mean', 'sqrt(greatest(v / n, 0) / n) AS std_error', 'mean / sqrt(greatest(v / n, 0) / n) AS t_stat')} FROM o, v""")
def ic_significance(spark, d):
    return significance.newey_west(evaluation.rank_ic(research.panel(market.bars(spark, d)), "reversal", "fwd5"))


@query(f"""{BARS}, {FWD}, {_RANKS}, m AS (SELECT rk.*, median(rk.fwd5) OVER (PARTITION BY rk.date) AS mid, fwd1, fwd10 FROM rk JOIN pan USING (date, id) QUALIFY count(*) OVER (PARTITION BY rk.date) >= 2)
SELECT date, count(*) AS n, {_rounded('avg((fwd5 > mid)::INT) AS hit_rate', 'avg(fwd1) AS top_fwd1', 'avg(fwd10) AS top_fwd10')} FROM m WHERE t <= 5 GROUP BY date""")
def head_metrics(spark, d):
    return significance.head_metrics(research.panel(market.bars(spark, d)), "reversal", "fwd5", ["fwd1", "fwd10"], "median")


@query(f"""{BARS}, {INDUSTRY}, p AS (SELECT industry AS test, avg((iret > 0)::INT) AS p FROM ind GROUP BY 1), r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY p, test) AS r FROM p)
SELECT test, {_rounded('p', 'least(1, min(p * n / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted')} FROM r""")
def adjusted_p_values(spark, d):
    """Benjamini-Hochberg correction of one p-like share per industry."""
    return evaluation.adjusted_p(_industry(spark, d).groupBy(F.col("industry").alias("test")).agg(F.avg((F.col("iret") > 0).cast("int")).alias("p")), "p").select("test", "p", "adjusted")


_CONFLICT = """f AS (SELECT date, id, reversal, mom20, fwd1 FROM pan), q AS (SELECT date, 'mom20' AS a, 'reversal' AS b, mom20 AS x, reversal AS y FROM f UNION ALL SELECT date, 'fwd1', 'mom20', fwd1, mom20 FROM f UNION ALL SELECT date, 'fwd1', 'reversal', fwd1, reversal FROM f),
z AS (SELECT date, a, b, rank() OVER (PARTITION BY date, a, b ORDER BY x) + (count(*) OVER (PARTITION BY date, a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date, a, b ORDER BY y) + (count(*) OVER (PARTITION BY date, a, b, y) - 1) / 2.0 AS ry FROM q WHERE x IS NOT NULL AND y IS NOT NULL), nn AS (SELECT date, a, b FROM q GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT date, a, b, CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) ELSE 0 END AS c FROM nn LEFT JOIN z USING (date, a, b) GROUP BY ALL)"""


@query(f"{BARS}, {FWD}, {_CONFLICT} SELECT a, b, count(*) AS dates, {_rounded('avg(c) AS agreement')}, abs(avg(c)) >= 0.2 AS conflict FROM c GROUP BY a, b")
def feature_conflicts(spark, d):
    """Pairs of features whose mean daily rank correlation is 0.2 or more in size."""
    pairs = diagnostics.rank_agreement(research.panel(market.bars(spark, d)), ["fwd1", "mom20", "reversal"], least=3)
    return pairs.withColumn("conflict", F.abs("agreement") >= 0.2)


@query(f"""{BARS}, {FWD}, p AS (SELECT date, id, count_if(reversal IS NOT NULL AND mom20 IS NOT NULL AND fwd1 IS NOT NULL) AS ok FROM pan GROUP BY ALL) SELECT date, sum(ok)::BIGINT AS complete FROM p GROUP BY date ORDER BY date DESC LIMIT 60""")
def complete_by_date(spark, d):
    """Rows with all features on each of the last 60 dates."""
    return diagnostics.complete_rows(research.panel(market.bars(spark, d)), ["reversal", "mom20", "fwd1"], 60)


@query(f"""{BARS}, {FWD}, f AS (SELECT year(date) AS fold, reversal, fwd5, date, id FROM pan WHERE reversal IS NOT NULL AND fwd5 IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY reversal) + (count(*) OVER (PARTITION BY date, reversal) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd5) + (count(*) OVER (PARTITION BY date, fwd5) - 1) / 2.0 AS b FROM f),
i AS (SELECT fold, date, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic FROM r GROUP BY ALL HAVING count(*) >= 5), m AS (SELECT fold, avg(ic) AS x FROM i GROUP BY fold), md AS (SELECT median(x) AS mid FROM m),
l AS (SELECT fold, x, x < mid AS low, row_number() OVER (ORDER BY fold) - row_number() OVER (PARTITION BY x < mid ORDER BY fold) AS g FROM m, md), k AS (SELECT coalesce(max(c), 0) AS longest FROM (SELECT count(*) AS c FROM l WHERE low GROUP BY g))
SELECT count(x) AS folds, {_rounded('avg(x) AS mean', 'stddev_pop(x) / nullif(abs(avg(x)), 0) AS variation', 'min(x) AS worst', 'any_value(mid) AS median', 'avg((x > 0)::INT) AS positive', 'avg(CASE WHEN fold <= 1995 THEN x END) - avg(CASE WHEN fold > 1995 THEN x END) AS decay')}, any_value(longest) AS longest_low FROM m, md, k""")
def fold_stability(spark, d):
    """Yearly folds of the rank information: variation, worst, share of positive folds, longest run below the median, and how much the early folds exceed the late ones."""
    ic = evaluation.rank_ic(research.panel(market.bars(spark, d)), "reversal", "fwd5").withColumn("fold", F.year("date")).groupBy("fold").agg(F.avg("ic").alias("x"))
    return diagnostics.stability(ic, "x", "fold", F.col("fold") <= 1995)

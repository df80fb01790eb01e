"""Queries of drawdown stops, capped weights, budget-safe orders and lots, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.operators import construction, features, ledgers, stops
from quantloom.queries import BARS, FWD, _rounded, query
from quantloom.sources import market

_RISK = """mk AS (SELECT date, bench / lag(bench) OVER (ORDER BY date) - 1 AS mret FROM bench), rk AS (SELECT date, CASE WHEN avg(mret) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) < 0 THEN 'risk_off' ELSE 'risk_on' END AS risk FROM mk),
bk AS (SELECT id AS book, date, ret / 20 AS ret, risk, row_number() OVER (PARTITION BY id ORDER BY date) AS n FROM rets JOIN rk USING (date)),
eq AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY book ORDER BY n)) AS equity FROM bk), dd AS MATERIALIZED (SELECT *, greatest(0, 1 - equity / greatest(1, max(equity) OVER (PARTITION BY book ORDER BY n))) AS fall FROM eq)"""
_STOPS = f"""RECURSIVE {BARS}, {_RISK}, lv AS (SELECT *, CASE WHEN fall >= 0.2 THEN 'red' WHEN fall >= 0.15 THEN 'orange' WHEN fall >= 0.1 THEN 'yellow' ELSE 'normal' END AS own FROM dd),
st AS (SELECT book, n, own AS level, CASE WHEN own = 'red' THEN 10 ELSE 0 END AS cooldown, own <> 'normal' AS changed FROM lv WHERE n = 1
UNION ALL SELECT lv.book, lv.n, CASE WHEN st.level = 'red' AND (st.cooldown > 1 OR lv.risk = 'risk_off') THEN 'red' ELSE own END,
CASE WHEN own = 'red' AND st.level <> 'red' THEN 10 ELSE greatest(0, st.cooldown - 1) END, st.level <> CASE WHEN st.level = 'red' AND (st.cooldown > 1 OR lv.risk = 'risk_off') THEN 'red' ELSE own END FROM st JOIN lv ON lv.book = st.book AND lv.n = st.n + 1)"""


def _books(spark, d):
    """Each instrument as a portfolio, with a twentieth of its return and the market's risk state."""
    day = Window.orderBy("date")  # one row a day
    m = market.benchmark(spark, d).withColumn("_m", R.ratio(F.col("bench"), F.lag("bench").over(day)) - 1)
    risk = m.select("date", F.when(F.avg("_m").over(day.rowsBetween(-19, 0)) < 0, "risk_off").otherwise("risk_on").alias("risk"))
    return features.with_returns(market.bars(spark, d)).select(F.col("id").alias("book"), "date", (F.col("ret") / 20).alias("ret")).join(risk, "date")


@query(f"{_STOPS} SELECT st.book, date, {_rounded('equity', 'fall AS drawdown')}, level, CASE level WHEN 'red' THEN 0.0 WHEN 'orange' THEN 0.4 WHEN 'yellow' THEN 0.7 ELSE 1.0 END AS cap, cooldown, changed FROM st JOIN lv ON lv.book = st.book AND lv.n = st.n")
def drawdown_stop_levels(spark, d):
    return stops.drawdown_levels(_books(spark, d))


_BEST = """bs AS (SELECT date, id, mom20 AS s, industry, row_number() OVER (PARTITION BY date ORDER BY mom20 DESC, id) AS i FROM sig JOIN inst USING (id) WHERE mom20 > 0 QUALIFY i <= 30)"""
# for each possible number of names at the cap what the next one would get; the smallest number that keeps it below is the one
_FILL = """pk AS (SELECT date, i, s, sum(s) OVER (PARTITION BY date) - sum(s) OVER (PARTITION BY date ORDER BY i) + s AS rest, count(*) OVER (PARTITION BY date) AS n FROM bs), bud AS (SELECT *, least(0.9, 0.08 * n) AS b FROM pk),
kk AS (SELECT date, coalesce(min(CASE WHEN s / rest * (b - (i - 1) * 0.08) <= 0.08 + 1e-15 THEN i - 1 END), max(n)) AS k FROM bud GROUP BY date),
cw AS (SELECT bs.date, bs.id, industry, CASE WHEN bs.i <= k THEN 0.08 ELSE bs.s / nullif(sum(CASE WHEN bs.i > k THEN bs.s END) OVER (PARTITION BY bs.date), 0) * (b - k * 0.08) END AS weight FROM bs JOIN bud ON bud.date = bs.date AND bud.i = bs.i JOIN kk ON kk.date = bs.date)"""


def _candidates(spark, d):
    best = features.momentum(market.bars(spark, d)).where("mom20 > 0").withColumn("_i", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("mom20"), "id"))).where("_i <= 30")
    return construction.allocated(best.join(market.instruments(spark, d), "id").select("date", "id", "industry", "mom20"), "mom20", 0.08, 0.9)


@query(f"{BARS}, {FWD}, {_BEST}, {_FILL} SELECT date, id, {_rounded('weight')} FROM cw WHERE weight > 1e-15")
def water_filled_weights(spark, d):
    return _candidates(spark, d).select("date", "id", "weight")


@query(f"""{BARS}, {FWD}, {_BEST}, {_FILL}, gs AS (SELECT date, industry, sum(weight) AS gw, sum(sum(weight)) OVER (PARTITION BY date) AS tot FROM cw WHERE weight > 1e-15 GROUP BY date, industry), gi AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY gw DESC, industry) AS i, count(*) OVER (PARTITION BY date) AS n, least(least(0.9, tot), 0.25 * count(*) OVER (PARTITION BY date)) AS b FROM gs),
gr AS (SELECT *, sum(gw) OVER (PARTITION BY date) - sum(gw) OVER (PARTITION BY date ORDER BY i) + gw AS rest FROM gi), gk AS (SELECT date, coalesce(min(CASE WHEN gw / rest * (b - (i - 1) * 0.25) <= 0.25 + 1e-15 THEN i - 1 END), max(n)) AS k FROM gr GROUP BY date),
gt AS (SELECT date, industry, gw, CASE WHEN i <= k THEN 0.25 ELSE gw / nullif(sum(CASE WHEN i > k THEN gw END) OVER (PARTITION BY date), 0) * (b - k * 0.25) END AS target FROM gr JOIN gk USING (date))
SELECT cw.date, cw.id, cw.industry, {_rounded('weight * target / gw AS weight')} FROM cw JOIN gt ON gt.date = cw.date AND gt.industry = cw.industry WHERE weight > 1e-15 AND target > 1e-15""")
def group_capped_weights(spark, d):
    return construction.group_capped(_candidates(spark, d), "industry", 0.25, 0.9).select("date", "id", "industry", "weight")


@query(f"""{BARS}, {FWD}, {_BEST}, {_FILL}, es AS (SELECT cw.*, sector, sum(weight) OVER (PARTITION BY cw.date, sector) AS gw FROM cw JOIN inst USING (id) WHERE weight > 1e-15), c AS (SELECT * FROM (VALUES ('ASIA', 0.2), ('EUROPE', 0.15)) t(sector, cap)) SELECT date, id, sector, {_rounded('weight * CASE WHEN cap < gw THEN cap / gw ELSE 1 END AS weight')} FROM es LEFT JOIN c USING (sector)""")
def exposure_capped_weights(spark, d):
    caps = spark.createDataFrame([("ASIA", 0.2), ("EUROPE", 0.15)], "group string, cap double")
    x = _candidates(spark, d).join(market.instruments(spark, d).select("id", "sector"), "id")
    return construction.exposure_capped(x, "sector", caps).select("date", "id", "sector", "weight")


_ADJ = """CASE WHEN coalesce(suspended, false) OR price IS NULL OR coalesce(dq > 0 AND price >= limit_up, false) OR coalesce(dq < 0 AND price <= limit_down, false) THEN 0 ELSE dq END"""
_NAMES = f"""nm AS (SELECT date AS book, id, coalesce(wt.weight, 0) AS weight, close AS price, (floor(volume) * 200)::DOUBLE AS held, (floor(volume) * 100)::DOUBLE AS closable, volume < 3 AS suspended, prev * 1.5 AS limit_up, prev * 0.6 AS limit_down FROM rets LEFT JOIN (SELECT date, id, weight FROM cw WHERE weight > 1e-15) wt USING (date, id)),
nt AS (SELECT *, 1e6 + sum(held * price) OVER (PARTITION BY book) AS total, sum(weight) OVER (PARTITION BY book) AS want FROM nm)"""


def _costed(name: str, source: str) -> str:
    """Per book the best affordable safety among the candidates `s` of the source."""
    return f"""{name}q AS (SELECT *, coalesce(round_even(total * s * weight / price, 0), 0) - held AS d0 FROM {source}),
{name}r AS (SELECT *, CASE WHEN -d0 = held THEN d0 WHEN abs(d0) < 50 THEN 0 WHEN abs(d0) < 100 THEN 100 * sign(d0) ELSE round_even(d0 / 100, 0) * 100 END AS d1 FROM {name}q), {name}s AS (SELECT *, CASE WHEN d1 < 0 AND -d1 > held THEN -held ELSE d1 END AS dq FROM {name}r),
{name}t AS (SELECT *, greatest({_ADJ}, -closable) AS q FROM {name}s), {name}u AS (SELECT *, q * price AS money, CASE WHEN q <> 0 THEN greatest(abs(q * price) * 8e-4, 5) + CASE WHEN q < 0 THEN abs(q * price) * 5e-4 ELSE 0 END ELSE 0 END AS fee FROM {name}t),
{name}v AS (SELECT book, s, sum(money + fee) AS spent, round(abs(sum(held * price + money) / any_value(total) - any_value(want)), 9) AS away FROM {name}u GROUP BY book, s), {name} AS (SELECT book, s FROM {name}v WHERE spent < 1e6 QUALIFY row_number() OVER (PARTITION BY book ORDER BY away, s DESC) = 1)"""


@query(f"""{BARS}, {FWD}, {_BEST}, {_FILL}, {_NAMES}, c0 AS (SELECT *, round(unnest(range(0, CASE WHEN want > 0.95 THEN 61 ELSE 51 END)) * 0.02, 6) AS s FROM nt), {_costed('ra', 'c0')},
c1 AS (SELECT * FROM (SELECT nt.*, round(ra.s + unnest(range(-20, 21)) * 0.001, 6) AS s FROM nt JOIN ra USING (book)) WHERE s >= 0 AND s <= CASE WHEN want > 0.95 THEN 1.2 ELSE 1.0 END), {_costed('fa', 'c1')}
SELECT nt.book, nt.id, round(fa.s, 6) AS safety, coalesce(q, 0)::BIGINT AS quantity FROM nt LEFT JOIN fa USING (book) LEFT JOIN fat ON fat.book = nt.book AND fat.id = nt.id AND fat.s = fa.s""")
def budget_safe_orders(spark, d):
    bars = market.bars(spark, d)
    h = Window.partitionBy("id").orderBy("date")
    x = bars.withColumn("_p", F.lag("close").over(h)).join(_candidates(spark, d).select("date", "id", "weight"), ["date", "id"], "left")
    names = x.select(
        F.col("date").alias("book"), "id", "weight", F.col("close").alias("price"), (F.floor("volume") * 200).cast("double").alias("held"), (F.floor("volume") * 100).cast("double").alias("closable"), F.lit(100).alias("min_qty"), F.lit(100).alias("lot"),
        (F.col("volume") < 3).alias("suspended"), (F.col("_p") * 1.5).alias("limit_up"), (F.col("_p") * 0.6).alias("limit_down"), F.lit(1e6).alias("cash"),
    )
    return construction.budget_safe_orders(names)


_TR = """tr AS (SELECT l_suppkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS seq, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::BIGINT AS quantity FROM lineitem)"""


def _trades(spark, d):
    """All line items as trades of their supplier's position: returned ones sell; open ones close today first; split where an ex-factor falls."""
    line = market.table(spark, d, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("long")
    return line.select(
        F.col("l_suppkey").alias("id"), F.row_number().over(order).cast("long").alias("seq"), F.to_date("l_shipdate").alias("date"), quantity.alias("quantity"), (F.col("l_discount") >= 0.05).alias("today"), F.when(F.col("l_tax") == 0.08, 1.1).alias("ratio"),
    )


@query(f"""{_TR}, r AS (SELECT *, sum(greatest(quantity, 0)) OVER h AS b, sum(quantity) OVER h AS n, sum(greatest(-quantity, 0)) OVER h AS s FROM tr WINDOW h AS (PARTITION BY id ORDER BY seq)), l AS (SELECT *, s - greatest(0, max(-n) OVER (PARTITION BY id ORDER BY seq)) AS sold FROM r),
m AS (SELECT *, coalesce(lag(sold) OVER (PARTITION BY id ORDER BY seq), 0) AS was FROM l)
SELECT b.id, b.seq AS opened_seq, s.seq AS closed_seq, (least(b.b, s.sold) - greatest(b.b - b.quantity, s.was))::BIGINT AS quantity FROM m b JOIN m s ON b.id = s.id AND b.quantity > 0 AND s.quantity < 0 AND s.was < b.b AND b.b - b.quantity < s.sold WHERE least(b.b, s.sold) > greatest(b.b - b.quantity, s.was)""")
def lot_pairs(spark, d):
    return ledgers.lot_pairs(_trades(spark, d), ["id"], ["seq"]).select("id", F.col("opened.seq").alias("opened_seq"), F.col("closed.seq").alias("closed_seq"), F.col("quantity").cast("long").alias("quantity"))


@query()
def lot_matches(spark, d):
    """Checked against a plain queue in the tests: close-today, splits and turns depend on the path."""
    return ledgers.lot_matches(_trades(spark, d))

"""Point-in-time reads: memberships, sparse series on a calendar, curves, benchmarks and trading days of timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import scalars as S


def listed_long_enough(panel: DataFrame, listed: DataFrame, days: int) -> DataFrame:
    """Rows whose instrument was listed `days` or more before; an unknown listing date is kept."""
    x = panel.join(listed.select("id", "listed_date"), "id", "left")
    return x.where(F.col("listed_date").isNull() | (F.datediff("date", "listed_date") >= days)).drop("listed_date")


def valid_at(panel: DataFrame, instruments: DataFrame) -> DataFrame:
    """Each row with the instrument that carried its code on the date: the latest one listed by then, if it was not delisted. One union and one sort replace the range join."""
    x = R.asof(panel, instruments, ["code"], "date", "listed_date", ["name", "de_listed_date"])
    return x.where(F.col("name").isNotNull() & (F.col("de_listed_date").isNull() | (F.col("date") < F.col("de_listed_date")))).drop("de_listed_date")


def filled(calendar: DataFrame, series: DataFrame, values: list[str]) -> DataFrame:
    """A sparse market-level series on every calendar date: the last known values, those from before the calendar's first date included."""
    days = calendar.select("date", F.lit(1).alias("_one"))
    return R.asof(days, series.withColumn("_one", F.lit(1)).withColumnRenamed("date", "_known"), ["_one"], "date", "_known", values).drop("_one")


def overlaid(panel: DataFrame, meta: DataFrame, columns: dict[str, str], key: str = "id") -> DataFrame:
    """Attributes from metadata where it has them, else from the panel, else the default of `columns`."""
    m = meta.select(key, *(F.col(c).alias(f"_m_{c}") for c in columns if c in meta.columns))
    x = panel.join(m, key, "left")
    pick = {c: F.coalesce(*([F.col(f"_m_{c}")] if c in meta.columns else []), *([F.col(c)] if c in panel.columns else []), F.lit(d)) for c, d in columns.items()}
    return x.withColumns(pick).drop(*(f"_m_{c}" for c in columns))


def risk_free(curve: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the rate of the longest tenor, no longer than the span, that has a value on the last curve date up to `start`. Columns of curve: date, tenor_days, rate."""
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    known = curve.where((F.col("date") <= F.lit(start).cast("date")) & F.col("rate").isNotNull())
    last = known.agg(F.max("date").alias("_d"))
    x = known.join(F.broadcast(last), known["date"] == F.col("_d")).where(F.col("tenor_days") <= span)  # one row
    return x.agg(F.max_by("rate", "tenor_days").alias("rate"), F.max("tenor_days").alias("tenor_days")).withColumn("tenor", S.tenor_for(F.col("tenor_days")))


def blended(returns: DataFrame, weights: dict[str, float], key: str = "k") -> DataFrame:
    """Per date: weighted mean return of the named series, and whether all of them have one."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))[F.col(key)]
    rows = returns.where(F.col(key).isin(*weights)).withColumn("_w", w).where("ret is not null")
    return rows.groupBy("date").agg((F.sum(F.col("_w") * F.col("ret")) / F.sum("_w")).alias("ret"), (F.count("*") == len(weights)).alias("complete"))


def trading_day(stamps: DataFrame, calendar: DataFrame, ts: str = "ts", night: int = 20) -> DataFrame:
    """Add `trading_date`: the stamp's date, or the next one from `night` o'clock on, moved to the next trading date; null after the calendar's end. Stamps meet the calendar by one join on dates, each mapped to its trading date first."""
    day = F.date_add(F.to_date(ts), F.when(F.hour(ts) >= night, 1).otherwise(0))
    w = Window.orderBy("date")
    spans = calendar.select("date", F.coalesce(F.date_add(F.lag("date").over(w), 1), F.col("date")).alias("_from"))  # one row a day
    days = spans.select(F.col("date").alias("trading_date"), F.explode(F.sequence("_from", "date")).alias("_day"))
    return stamps.withColumn("_day", day).join(days, "_day", "left").drop("_day")


def previous_close(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Close of the bar before, in today's terms: times that bar's factor over today's."""
    x = R.asof(bars.select("id", "date", "close"), factors, ["id"], "date", "ex_date", ["factor"]).withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    h = R.history()
    return x.select("id", "date", "close", (F.lag("close").over(h) * F.lag("factor").over(h) / F.col("factor")).alias("previous_close"))


def rebalance_days(calendar: DataFrame, every: int) -> DataFrame:
    """Trading dates on which a rebalance every `every` trading days is due, from the first on."""
    return calendar.where((F.col("seq") - 1) % every == 0).select("date", "seq")


def rebalance_due(books: DataFrame, calendar: DataFrame, every: int) -> DataFrame:
    """Books (date, last_rebalance, holdings, and other columns) with the trading days since the last rebalance, those left, and whether one is due: after `every` trading days, without holdings, or without a rebalance so far."""
    at = lambda c: calendar.select(F.col("date").alias(c), F.col("seq").alias(f"_{c}"))
    x = books.join(at("date"), "date", "left").join(at("last_rebalance"), "last_rebalance", "left")
    gap = F.col("_date") - F.col("_last_rebalance")
    due = F.col("_last_rebalance").isNull() | (F.coalesce(F.col("holdings"), F.lit(0)) == 0) | (gap >= every)
    return x.select(*books.columns, gap.alias("days_since"), F.when(due, 0).otherwise(every - gap).alias("days_left"), due.alias("due"))


def freshness(tables: dict[str, DataFrame], calendar: DataFrame, stale: int = 3, expired: int = 5) -> DataFrame:
    """Per source: last date, trading days since, and fresh, stale or expired."""
    today = calendar.agg(F.max("seq").alias("_now"))
    out = None
    for name, df in tables.items():
        last = df.agg(F.max("date").alias("last")).withColumn("source", F.lit(name))
        out = last if out is None else out.unionByName(last)
    seqs = out.join(calendar.select(F.col("date").alias("last"), "seq"), "last", "left").crossJoin(F.broadcast(today))  # one row
    gap = F.col("_now") - F.col("seq")
    return seqs.select("source", "last", gap.alias("days"), F.when(gap > expired, "expired").when(gap > stale, "stale").otherwise("fresh").alias("state"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free digest of all their values, columns by name."""
    names = sorted(df.columns)
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in names))
    return df.agg(F.count("*").alias("n"), F.expr("0L").alias("_z"), F.bit_xor(row).alias("mix"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("sum")).select("n", F.coalesce("mix", "_z").alias("mix"), F.coalesce("sum", "_z").alias("sum"), F.sha2(F.lit(",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))), 256).alias("schema"))


def deduplicated(df: DataFrame, keys: list[str], order: str, keep: str = "last") -> DataFrame:
    """One row per key: the first or last by `order`."""
    by = F.desc(order) if keep == "last" else F.asc(order)
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where("_k = 1").drop("_k")


def quarter_of(date: Column | str) -> Column:
    """Quarters since year 0: year x 4 + quarter - 1."""
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("int")


def latest_quarters(probes: DataFrame, facts: DataFrame, values: list[str], count: int = 4, statements: str = "latest", key: str = "id", date: str = "asof") -> DataFrame:
    """Each probe (id, asof, and other columns) with the figures of its last `count` quarters as they were known then: quarter, info_date, values, `place` from 1 for the newest.

    Only quarters from count + 1 before that of the date on are asked for. A
    probe becomes one question for each of them, answered by an as-of join on id
    and quarter with the day on which a figure was published, so a restatement
    counts from its own day on and no join is by range. With `all` every version
    known by then is returned, newest first in a quarter, and the quarters are
    those from count + 1 before. Columns of facts: id, quarter, info_date, values."""
    names = probes.columns
    first = quarter_of(F.col(date)) - (count + 1)
    asks = probes.withColumn("quarter", F.explode(F.sequence(first, quarter_of(F.col(date)))))
    if statements == "all":
        known = asks.join(facts.select(key, "quarter", "info_date", *values), [key, "quarter"]).where(F.col("info_date") <= F.col(date))
        order = Window.partitionBy(*names).orderBy(F.desc("quarter"), F.desc("info_date"))
        return known.select(*names, "quarter", "info_date", *values, F.row_number().over(order).alias("place"))
    known = R.asof(asks, facts.withColumn("_info", F.col("info_date")), [key, "quarter"], date, "info_date", ["_info", *values])
    known = known.where("_info is not null").withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("quarter"))))
    return known.where(F.col("place") <= count).select(*names, "quarter", F.col("_info").alias("info_date"), *values, "place")

"""What a user reads from a bundle of bars, events and flags: price panels, counted panels, single bars, dividends, flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators import panel

KEYS = ("id", "date")
PRICES = ("open", "high", "low", "close")


def _fields(df: DataFrame, fields: Iterable[str] | None) -> list[str]:
    there = [c for c in df.columns if c not in KEYS]
    wanted = there if fields is None else list(fields)
    unknown = [c for c in wanted if c not in there]
    if unknown:
        raise ValueError(f"unknown fields {unknown}; there are {there}")
    return wanted


def prices(
    bars: DataFrame, factors: DataFrame, ids: Iterable[int] | None, start: str, end: str | None, fields: Iterable[str] | None = None, adjust: str = "pre", skip_suspended: bool = False, frequency: str = "1d", today: str | None = None,
) -> DataFrame:
    """Panel of fields between two dates, both included, by id and date.

    `adjust`: none, pre (prices of the last day asked for) or post. With `today`
    the end must lie before it, and without an end it is the day before.
    `frequency` 1w or 1m rolls bars up under their last date. Filters and fields
    reach the scan, since nothing is computed before them but the adjustment."""
    last = str(dt.date.fromisoformat(today) - dt.timedelta(days=1)) if today else None
    end = end or last
    if not end:
        raise ValueError("an end date or the current date is needed")
    if last and (end > last or start > last):
        raise ValueError(f"dates after {last} are not known yet")
    if start > end:
        raise ValueError(f"start {start} lies after end {end}")
    if adjust not in ("none", "pre", "post"):
        raise ValueError(f"unknown adjustment {adjust!r}")
    if frequency not in ("1d", "1w", "1m"):
        raise ValueError(f"unknown frequency {frequency!r}")
    wanted = _fields(bars, fields)
    x = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if ids is not None:
        x = x.where(F.col("id").isin(list(ids)))
    if skip_suspended:
        x = x.where("volume > 0")
    if adjust != "none":
        raw, x = x, panel.adjusted(x, factors, adjust, end if adjust == "pre" else None)
        rest = [c for c in wanted if c not in x.columns]  # amounts and the like, which no split changes
        x = x.join(raw.select(*KEYS, *rest), list(KEYS)) if rest else x
    if frequency != "1d":
        unit = {"1w": "week", "1m": "month"}[frequency]
        how = {"open": F.min_by("open", "date"), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", "date")}
        agg = [how.get(c, F.sum(c)).alias(c) for c in wanted]
        x = x.groupBy("id", F.date_trunc(unit, "date").alias("_p")).agg(F.max("date").alias("date"), *agg).drop("_p")
    return x.select(*KEYS, *wanted)


def counted(rows: DataFrame, calendar: DataFrame, at: str, count: int, fields: Iterable[str] | None = None) -> DataFrame:
    """The rows of the last `count` trading days before a date, so that nothing of the day itself is seen."""
    wanted = _fields(rows, fields)
    if count < 1:
        raise ValueError("count must be positive")
    days = calendar.where(F.col("date") < F.lit(at).cast("date")).orderBy(F.desc("date")).limit(count).select("date")
    return rows.join(days, "date").select(*KEYS, *wanted)


def bars_on(bars: DataFrame, asks: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """The bar of each (id, date) asked for; a day without one gives nulls."""
    return asks.select(*KEYS).join(bars.select(*KEYS, *_fields(bars, fields)), list(KEYS), "left")


AUCTION = ("open", "limit_up", "limit_down", "volume", "turnover")


def auction_bars(bars: DataFrame, asks: DataFrame) -> DataFrame:
    """What is known at the opening auction of each (id, date): fields that the bars lack are NaN, and the last price is the open."""
    nan = F.lit(float("nan"))
    x = bars.select(*KEYS, *((F.col(c).cast("double") if c in bars.columns else nan).alias(c) for c in AUCTION))
    x = asks.select(*KEYS).join(x, list(KEYS), "left").select(*KEYS, *(F.coalesce(c, nan).alias(c) for c in AUCTION))
    return x.withColumn("last", F.col("open"))


def events_until(events: DataFrame, asks: DataFrame, date: str = "ex_date", start: str | None = None) -> DataFrame:
    """Events (dividends, splits) of each instrument asked for up to its date, from `start` on, oldest first with their places; ids without events give none."""
    x = events if start is None else events.where(F.col(date) >= F.lit(start).cast("date"))
    x = asks.select("id", F.col("date").alias("as_of")).join(x, "id").where(F.col(date) <= F.col("as_of"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("id", "as_of").orderBy(date)))


def flagged(flags: DataFrame, asks: DataFrame) -> DataFrame:
    """Whether each (id, date) is in a table of flagged days; null for instruments that the table does not know at all."""
    known = flags.select("id").distinct().withColumn("_known", F.lit(True))
    x = asks.join(flags.select(*KEYS).distinct().withColumn("_on", F.lit(True)), list(KEYS), "left").join(known, "id", "left")
    return x.withColumn("flag", F.when(F.col("_known"), F.coalesce("_on", F.lit(False)))).drop("_known", "_on")


def listing_state(asks: DataFrame, listings: DataFrame, futures: bool = False) -> DataFrame:
    """Each (id, date) with `listed`, `delisted` and `active`; futures trade on their last day, others do not."""
    x = asks.join(listings.select("id", F.col("listed").alias("_a"), F.col("delisted").alias("_b")), "id", "left")
    listed = F.coalesce(F.col("_a") <= F.col("date"), F.lit(False))
    gone = F.coalesce(F.col("date") > F.col("_b") if futures else F.col("date") >= F.col("_b"), F.lit(False))
    return x.withColumn("listed", listed).withColumn("delisted", gone).withColumn("active", listed & ~gone).drop("_a", "_b")


def calendar_slice(calendar: DataFrame, start: str | None = None, end: str | None = None, last: int | None = None) -> DataFrame:
    """Trading dates from start to end, both included, or the last n of them."""
    x = calendar
    if start:
        x = x.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        x = x.where(F.col("date") <= F.lit(end).cast("date"))
    return x if last is None else x.orderBy(F.desc("date")).limit(last)

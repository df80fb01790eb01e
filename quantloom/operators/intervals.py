"""Date intervals: coverage, overlaps and what is active on a date, by sweeps with one sort a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def merged(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of each key's closed date ranges, as the fewest ranges; ranges that touch or follow on the next day become one. Ranges that end before they start are ignored."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.where(F.col(start) <= F.col(end)).select(*keys, start, end).withColumn("_reach", F.max(end).over(before))
    opens = F.col("_reach").isNull() | (F.col(start) > F.date_add("_reach", 1))
    x = x.withColumn("_run", F.sum(opens.cast("int")).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_run")


def covered(dates: DataFrame, ranges: DataFrame, keys: list[str], date: str = "date", start: str = "start", end: str = "end") -> DataFrame:
    """Dates asked for, with whether the key's ranges hold them; the ranges are merged first, so the last one that began decides."""
    r = merged(ranges, keys, start, end).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"))
    x = R.asof(dates, r, keys, date, "_start", ["_end"])
    return x.withColumn("covered", F.coalesce(F.col(date) <= F.col("_end"), F.lit(False))).drop("_end")


def clashes(listings: DataFrame, code: str = "code", key: str = "id", start: str = "listed", end: str = "delisted", inclusive: bool = False) -> DataFrame:
    """Instruments that share a code with one listed before them and not yet delisted: the last day on which the code was taken, and how many days both hold it. An open end never comes; the day of delisting counts where `inclusive`, as it does for futures."""
    until = F.coalesce(F.date_sub(end, 0 if inclusive else 1), F.lit("9999-12-31").cast("date"))
    w = Window.partitionBy(code).orderBy(start, key).rowsBetween(Window.unboundedPreceding, -1)
    x = listings.withColumn("_until", until).withColumn("taken_until", F.max("_until").over(w)).where(F.col("taken_until") >= F.col(start))
    return x.select(code, key, start, end, "taken_until", (F.datediff(F.least("taken_until", "_until"), F.col(start)) + 1).alias("days"))


def active_on(probes: DataFrame, listings: DataFrame, code: str = "code", key: str = "id", start: str = "listed", end: str = "delisted", date: str = "date", inclusive: bool = False) -> DataFrame:
    """Each (code, date) with how many instruments are active then, the one if it is alone, and `status`: found, none or several.

    Listings add to running sums on their first day and leave them when they are
    delisted (a day later where `inclusive`, as for futures), probes read the
    sums, all in one sort by code and date: a sum of keys is the key itself where
    the count is one. Keys are whole numbers."""
    names = probes.columns
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in names if c not in (code, date)]
    event = lambda at, n: listings.where(at.isNotNull()).select(code, at.alias(date), F.lit(0).alias("_probe"), F.lit(n).alias("_n"), (F.col(key).cast("decimal(38,0)") * n).alias("_k"), *nothing)
    asks = probes.select(code, date, F.lit(1).alias("_probe"), F.lit(0).alias("_n"), F.lit(0).cast("decimal(38,0)").alias("_k"), *(c for c in names if c not in (code, date)))
    every = event(F.col(start), 1).unionByName(event(F.date_add(end, 1 if inclusive else 0), -1)).unionByName(asks)
    w = Window.partitionBy(code).orderBy(date, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    x = every.withColumn("active", F.sum("_n").over(w)).withColumn("_sum", F.sum("_k").over(w)).where("_probe = 1")
    n = F.col("active")
    kind = listings.schema[key].dataType
    return x.select(*names, n.cast("long").alias("active"), F.when(n == 1, F.col("_sum")).cast(kind).alias(key), F.when(n == 1, "found").when(n == 0, "none").otherwise("several").alias("status"))

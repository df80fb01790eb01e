"""Panel plumbing: calendars, as-of joins, adjustment, upserts, quality and universes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def adjusted(bars: DataFrame, factors: DataFrame, mode: str = "post", origin: str | None = None) -> DataFrame:
    """Prices times the cumulative factor in force on the day (1 before the first), volume divided by it; `pre` divides the factor by the one in force on the day `origin`, or by the last."""
    df = R.asof(bars, factors, ["id"], "date", "ex_date", ["factor"])
    f = F.coalesce("factor", F.lit(1.0))
    if mode == "pre":
        known = factors if origin is None else factors.where(F.col("ex_date") <= F.lit(origin).cast("date"))
        df = df.join(known.groupBy("id").agg(F.max_by("factor", "ex_date").alias("_base")), "id", "left")
        f = f / F.coalesce("_base", F.lit(1.0))
    return df.withColumn("f", f).select("id", "date", *((F.col(c) * F.col("f")).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") / F.col("f")).alias("volume"), "f")


def weekly(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars of weeks that end on Friday, labelled by the last trading date up to that Friday."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    out = bars.withColumn("week", week).groupBy("id", "week").agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("days")
    )
    label = calendar.groupBy(F.next_day(F.date_sub("date", 1), "FRI").alias("week")).agg(F.max("date").alias("date"))
    return out.join(label, "week").select("id", "date", "open", "high", "low", "close", "volume", "days")


def neighbours(calendar: DataFrame, n: int = 1) -> DataFrame:
    """Each trading date with the n-th one before and after, clamped to the calendar's ends, and its place in week and month from both sides."""
    w = Window.orderBy("date")
    ends = calendar.agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    place = lambda unit, desc: F.row_number().over(Window.partitionBy(F.date_trunc(unit, "date")).orderBy(F.desc("date") if desc else F.asc("date")))
    df = calendar.crossJoin(F.broadcast(ends))  # one row
    return df.select(
        "date", "seq", F.coalesce(F.lag("date", n).over(w), "_a").alias("prev"), F.coalesce(F.lead("date", n).over(w), "_b").alias("next"),
        place("week", False).alias("week_day"), place("week", True).alias("week_day_back"), place("month", False).alias("month_day"), place("month", True).alias("month_day_back"),
    )


def missing_runs(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Runs of trading days within an instrument's first and last bar on which it has none."""
    seqs = bars.select("id", "date").join(calendar, "date")
    gaps = seqs.withColumn("before", F.lag("seq").over(R.history(order="seq"))).where(F.col("seq") > F.col("before") + 1)
    return gaps.select("id", (F.col("before") + 1).alias("first_seq"), (F.col("seq") - 1).alias("last_seq"), (F.col("seq") - F.col("before") - 1).alias("days"))


def last_bars(bars: DataFrame, n: int, until=None) -> DataFrame:
    """The last n bars of each instrument up to a date."""
    df = bars if until is None else bars.where(F.col("date") <= until)
    return df.withColumn("back", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("date")))).where(F.col("back") <= n)


def liquid(bars: DataFrame, n: int, top: int) -> DataFrame:
    """The `top` instruments by mean turnover of their last n bars within 2 n days of the newest bar of all, with n / 2 bars at least; ties by id."""
    newest = bars.agg(F.max("date").alias("_newest"))
    recent = last_bars(bars, n).crossJoin(F.broadcast(newest)).where(F.col("date") > F.date_sub("_newest", 2 * n))  # one row
    mean = recent.groupBy("id").agg(F.avg("turnover").alias("mean_turnover"), F.median("volume").alias("median_volume"), F.count("*").alias("n"))
    return mean.where(F.col("n") >= n / 2).orderBy(F.desc("mean_turnover"), "id").limit(top)


def quality(bars: DataFrame, jump: float = 0.5) -> DataFrame:
    """One row: rows, instruments, dates, repeated keys, missing and non-positive closes, returns beyond `jump`."""
    h = R.history()
    before, twice = F.lag(F.lit(1)).over(h).isNotNull(), F.lag(F.lit(1), 2).over(h).isNotNull()
    same = before & F.lag("date").over(h).eqNullSafe(F.col("date"))
    more = twice & F.lag("date", 2).over(h).eqNullSafe(F.col("date"))  # the key was counted at its second row
    ret = F.abs(R.ratio(F.col("close"), F.lag("close").over(h)) - 1)
    x = bars.select("id", "date", "close", ret.alias("_r"), (~before & F.col("id").isNotNull()).alias("_first"), (same & ~more).alias("_again"))
    # one order by instrument gives instruments, repeated keys and returns, so bars are built once and only the dates need a distinct count
    return x.agg(
        F.count("*").alias("n"), F.count_if("_first").alias("ids"), F.countDistinct("date").alias("dates"), F.count_if(F.col("close").isNull()).alias("missing"), F.count_if(F.col("close") <= 0).alias("not_positive"), F.count_if(F.col("_r") > jump).alias("jumps"),
        F.count_if("_again").alias("repeated_keys"),
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old_on_null: bool = True) -> DataFrame:
    """Field-wise upsert: new values win; with `keep_old_on_null` only where they are not null."""
    fields = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*fields).alias("_o"))
    n = new.select(*keys, F.struct(*fields).alias("_n"))
    pick = (lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}"))) if keep_old_on_null else (lambda c: F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")))
    return o.join(n, keys, "full").select(*keys, *(pick(c).alias(c) for c in fields))


def layered(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key and field the first non-null value in order of the sources."""
    both = sources[0].withColumn("_p", F.lit(0))
    for p, s in enumerate(sources[1:], 1):
        both = both.unionByName(s.withColumn("_p", F.lit(p)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (*keys, "_p")]
    return both.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in fields))


def order_fees(trades: DataFrame, rate: float, minimum: float) -> DataFrame:
    """Commission of each fill when an order pays a minimum once: the step of max(cumulative fee, minimum); sales also pay stamp tax, 0.1 % before 2023-08-28 and 0.05 % from then."""
    w = Window.partitionBy("account", "day").orderBy("order_id").rowsBetween(Window.unboundedPreceding, 0)
    total = F.greatest(F.sum(F.col("amount") * rate).over(w), F.lit(minimum))
    df = trades.withColumn("_paid", total)
    fee = F.col("_paid") - F.coalesce(F.lag("_paid").over(Window.partitionBy("account", "day").orderBy("order_id")), F.lit(0.0))
    tax = F.when(F.col("side") == "SELL", F.col("amount") * F.when(F.col("date") < F.lit("2023-08-28").cast("date"), 0.001).otherwise(0.0005)).otherwise(0.0)
    return df.withColumn("commission", fee).withColumn("tax", tax).drop("_paid")

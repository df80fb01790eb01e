"""Forward-looking labels and leak-free folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10), lag: int = 1, cost: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Return of each horizon entered `lag` bars later, less a round trip's cost, with entry and exit date of the longest, and forward volatility; columns to `keep` come first."""
    lead = lambda x, n: F.lead(x, n).over(R.history())
    h = max(horizons)
    df = bars.withColumn("ret", R.ratio(F.col("close"), F.lag("close").over(R.history())) - 1)
    w = R.next_n(lag + 1, lag + h)
    vol = F.when(F.count("ret").over(w) >= h, F.stddev_samp("ret").over(w))
    return df.select("id", "date", *keep, *((R.ratio(lead("close", lag + n), lead("close", lag)) - 1 - cost).alias(f"fwd{n}") for n in horizons), lead("date", lag).alias("entry_date"), lead("date", lag + h).alias("exit_date"), vol.alias("fwd_vol"))


def horizon_labels(bars: DataFrame, bench: DataFrame, h: int = 20) -> DataFrame:
    """Return over the next h bars in excess of the benchmark's over its next h days, yearly volatility of the returns between those bars and their deepest fall from the running maximum; null without h bars ahead."""
    ahead = R.next_n(1, h)
    b = bench.select("date", (R.ratio(F.lead("bench", h).over(Window.orderBy("date")), F.col("bench")) - 1).alias("_bench"))  # one row a day
    df = bars.withColumn("_ret", R.ratio(F.col("close"), F.lag("close").over(R.history())) - 1).withColumn("_next", F.collect_list("close").over(ahead))
    fall = F.aggregate("_next", F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("fall")), lambda s, c: F.struct(F.greatest(s["top"], c).alias("top"), F.greatest(s["fall"], 1 - c / F.greatest(s["top"], c)).alias("fall")))["fall"]
    whole = F.size("_next") == h
    df = df.withColumn("_vol", F.stddev_samp("_ret").over(R.next_n(2, h)) * F.sqrt(F.lit(252.0))).withColumn("_fwd", R.ratio(F.lead("close", h).over(R.history()), F.col("close")) - 1)
    return df.join(b, "date", "left").select("id", "date", (F.col("_fwd") - F.col("_bench")).alias("excess"), F.when(whole, F.col("_vol")).alias("volatility"), F.when(whole, fall).alias("fall"))


def peer_relative(df: DataFrame, x: str, group: str, low: float = 0.05, high: float = 0.95, least: int = 3) -> DataFrame:
    """x clipped to quantiles of its date, less the mean of its (date, group), or of the date if the group has fewer than `least` rows."""
    edges = df.groupBy("date").agg(F.percentile(x, low).alias("_lo"), F.percentile(x, high).alias("_hi"))
    cut = F.when(F.col(x).isNotNull(), F.greatest("_lo", F.least("_hi", x)))
    df = df.join(edges, "date").withColumn("_cut", cut)
    g, d = Window.partitionBy("date", group), Window.partitionBy("date")
    mean = F.when(F.count("_cut").over(g) >= least, F.avg("_cut").over(g)).otherwise(F.avg("_cut").over(d))
    return df.withColumn("relative", F.col("_cut") - mean).drop("_lo", "_hi", "_cut")


def folds(calendar: DataFrame, train: int, valid: int, test: int, embargo: int, step: int) -> DataFrame:
    """Rolling walk-forward folds over trading-day ordinals: first and last `seq` of train, validation and test, `embargo` days between them."""
    last = calendar.agg(F.max("seq").alias("n"))
    need = train + valid + test + 2 * embargo
    starts = last.where(F.col("n") >= need).select(F.explode(F.sequence(F.lit(0), F.col("n") - need, F.lit(step))).alias("at"))
    a = F.col("at")
    rows = starts.select((F.floor(a / step) + 1).cast("int").alias("fold"), a)
    part = lambda name, lo, n: F.struct(F.lit(name).alias("part"), (a + lo + 1).alias("first"), (a + lo + n).alias("last"))
    three = F.array(part("train", 0, train), part("valid", train + embargo, valid), part("test", train + valid + 2 * embargo, test))
    return rows.select("fold", F.explode(three).alias("p")).select("fold", "p.*")


def fold_days(calendar: DataFrame, fold_table: DataFrame) -> DataFrame:
    """fold, part, date: ordinals are exploded from the folds and joined by equality, so no range join is needed."""
    days = fold_table.select("fold", "part", F.explode(F.sequence("first", "last")).alias("seq"))
    return days.join(calendar, "seq").select("fold", "part", "date")

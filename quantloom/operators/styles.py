"""Style spreads and exposures, fund and valuation factors, and holdings with a band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import walks


def exposure(returns: DataFrame, calendar: DataFrame, long: int, short: int, n: int = 60, least: int = 20, limit: float = 3.0) -> DataFrame:
    """Per row of returns (id, date, ret): return of the long less the short leg on the day, and the row's exposure to it.

    Betas to that spread over the last `n` dates of the calendar, with `least`
    pairs, are scaled so that the long leg has 1 and the short leg -1, and
    clipped; where they cannot be had the legs have 1 and -1 and others 0."""
    one = lambda k: F.max(F.when(F.col("id") == k, F.col("ret")))
    legs = returns.where(F.col("id").isin(long, short)).groupBy("date").agg(one(long).alias("_l"), one(short).alias("_s"))
    days = Window.orderBy("seq").rowsBetween(1 - n, 0)  # one row a day
    spread = calendar.select("date", "seq").join(legs, "date", "left").withColumn("spread", F.col("_l") - F.col("_s"))
    paired = lambda c: F.when(F.count(F.col(c) * F.col("spread")).over(days) >= least, F.covar_samp(c, "spread").over(days))
    variance = F.when((F.count("spread").over(days) >= least) & (F.var_samp("spread").over(days) != 0), F.var_samp("spread").over(days))
    spread = spread.select("date", "seq", "spread", variance.alias("_v"), paired("_l").alias("_cl"), paired("_s").alias("_cs"))
    w = Window.partitionBy("id").orderBy("seq").rangeBetween(1 - n, 0)
    x = returns.select("id", "date", "ret").join(spread, "date")
    x = x.withColumn("_c", F.when(F.count(F.col("ret") * F.col("spread")).over(w) >= least, F.covar_samp("ret", "spread").over(w)))
    beta = lambda c: R.ratio(F.col(c), F.col("_v"))
    scaled = R.ratio(2 * (beta("_c") - beta("_cs")), beta("_cl") - beta("_cs")) - 1
    sign = F.when(F.col("id") == long, 1.0).when(F.col("id") == short, -1.0).otherwise(0.0)
    return x.select("id", "date", "spread", F.coalesce(R.clip(scaled, -limit, limit), sign).alias("exposure"))


def style_spreads(panel: DataFrame, calendar: DataFrame, pairs: dict[str, tuple[int, int, float]], momentum: str = "mom20", n: int = 60) -> DataFrame:
    """Per row of the panel (id, date, ret, momentum) a column per style: momentum of the long less that of the short leg on the day (0 where missing) times the row's exposure, and their weighted mean as `composite`. Styles: name -> long, short, weight."""
    rows = panel.select("id", "date", "ret", momentum)
    out = rows.select("id", "date")
    for name, (long, short, _) in pairs.items():
        leg = lambda k: F.coalesce(F.max(F.when(F.col("id") == k, F.col(momentum))), F.lit(0.0))  # noqa: B023, E731
        gap = rows.where(F.col("id").isin(long, short)).groupBy("date").agg((leg(long) - leg(short)).alias("_gap"))
        own = exposure(rows, calendar, long, short, n).join(gap, "date", "left").select("id", "date", (F.coalesce("_gap", F.lit(0.0)) * F.col("exposure")).alias(name))
        out = out.join(own, ["id", "date"])
    total = sum(w for _, _, w in pairs.values()) or len(pairs)
    return out.withColumn("composite", sum((F.col(k) * w for k, (_, _, w) in pairs.items()), F.lit(0.0)) / total)


def fund_factors(bars: DataFrame, bench: DataFrame | None = None) -> DataFrame:
    """Momentum of 20 and 60 days, that in excess of the benchmark's (`date`, `bench`) on the day, return weighted by relative volume, and short over long volatility less 1."""
    df = bars.withColumn("ret", R.ratio(F.col("close"), F.lag("close").over(R.history())) - 1)
    change = lambda n: R.ratio(F.col("close"), F.lag("close", n).over(R.history())) - 1
    out = df.select("id", "date", change(20).alias("mom20"), change(60).alias("mom60"), R.ratio(F.col("ret") * F.col("volume"), R.mean("volume", 20)).alias("flow"), (R.ratio(R.std("ret", 10), R.std("ret", 60)) - 1).alias("vol_shift"))
    if bench is None:
        return out
    day = Window.orderBy("date")  # one row a day
    b = bench.select("date", *((R.ratio(F.col("bench"), F.lag("bench", n).over(day)) - 1).alias(f"_b{n}") for n in (20, 60)))
    return out.join(b, "date", "left").select("id", "date", "mom20", "mom60", *((F.col(f"mom{n}") - F.col(f"_b{n}")).alias(f"excess{n}") for n in (20, 60)), "flow", "vol_shift")


def valuation(bars: DataFrame) -> DataFrame:
    """Gap to the 250-day mean (20 days at least), yearly volatility of 20 days and volume over its mean."""
    df = bars.withColumn("ret", R.ratio(F.col("close"), F.lag("close").over(R.history())) - 1)
    return df.select("id", "date", (R.ratio(F.col("close"), R.mean("close", 250, 20)) - 1).alias("ma_gap"), (R.std("ret", 20) * F.sqrt(F.lit(252.0))).alias("vol"), R.ratio(F.col("volume"), R.mean("volume", 20)).alias("volume_ratio"))


def hold_band(scores: DataFrame, score: str, buy: int = 10, hold: int = 20, every: int = 20, bonus: float = 0.0, book: str = "book") -> DataFrame:
    """book, date, id, weight: on each rebalance the `buy` best names and those held that are among the `hold` best, in equal weights; between rebalances the names held that still have a score. `bonus` deviations are added to the scores of held names.

    Only the `hold` best of a date and the names held matter, so the scores of a
    date are cut to the names that were ever among the best before the books are
    walked through, in Arrow batches: a task holds one date's names. Without
    `bonus` the cut loses nothing."""
    from pyspark.sql import Window

    df = scores if book in scores.columns else scores.withColumn(book, F.lit(1))
    df = df.where(F.col(score).isNotNull()).select(book, "date", "id", F.col(score).alias("score"))
    place = F.row_number().over(Window.partitionBy(book, "date").orderBy(F.desc("score"), "id"))
    df = df.withColumn("place", place).withColumn("sd", F.stddev_samp("score").over(Window.partitionBy(book, "date")))
    if not bonus:
        ever = df.where(F.col("place") <= buy).select(book, "id").distinct()
        df = df.join(ever, [book, "id"], "left_semi")
    kinds = dict(df.dtypes)

    class Book:
        def __init__(self):
            self.held, self.since, self.day, self.names = set(), every, None, []

        def closed(self) -> list[tuple]:
            """The names held on the day that is complete."""
            names, held = self.names, self.held
            if self.since >= every or not held:
                places = [(i, place) for place, i, _, _ in names]
                sd = names[0][3]
                if bonus and held and sd is not None and sd > 0:
                    lifted = sorted((-(score + (i in held) * bonus * sd), i) for _, i, score, _ in names)
                    places = [(i, k) for k, (_, i) in enumerate(lifted, 1)]
                self.held = held = {i for i, place in places if place <= buy or i in held and place <= hold}
                self.since = 0
                names = [(place, i, None, None) for i, place in places]
            now = [i for _, i, _, _ in names if i in held]
            self.since += 1
            return [(self.day, i, 1 / len(now)) for i in now]

    def step(state: Book, row: tuple) -> list[tuple]:
        out = []
        if state.names and row[0] != state.day:
            out, state.names = state.closed(), []
        state.day = row[0]
        state.names.append(row[1:])
        return out

    return walks.walk(df, [book], ["date", "place"], ["id", "score", "sd"], Book, step, f"{book} {kinds[book]}, date {kinds['date']}, id {kinds['id']}, weight double", lambda state: state.closed())

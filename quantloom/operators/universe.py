"""Who is in a universe on a date, and joins of panels that say what does not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R


def large_enough(panel: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Rows whose instrument's size as last known on the row's date is at least `least`; an unknown size stays. Columns of sizes: id, date, size."""
    x = R.asof(panel, sizes.withColumnRenamed("date", "_at"), ["id"], "date", "_at", ["size"])
    return x.where(F.col("size").isNull() | (F.col("size") >= least)).drop("size")


def members_at(panel: DataFrame, listings: DataFrame) -> DataFrame:
    """Rows of instruments that were listed on their date, those that have gone since included: one join, no bias towards survivors."""
    x = panel.join(listings.select("id", F.col("listed").alias("_a"), F.col("delisted").alias("_b")), "id")
    return x.where((F.col("_a") <= F.col("date")) & (F.col("_b").isNull() | (F.col("date") < F.col("_b")))).drop("_a", "_b")


def layered_universe(snapshot: DataFrame, explicit: dict[int, str], defaults: dict[str, str], limits: dict[str, int | None]) -> DataFrame:
    """Latest rows of instruments with a layer: the one named for the id, else the row's own, else that of its asset type; layers not in `limits` go, and each keeps its first names by id up to its limit."""
    named = F.create_map(*(F.lit(x) for kv in explicit.items() for x in kv)) if explicit else F.create_map().cast("map<bigint,string>")
    by_type = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    own = F.lower(F.trim("layer")) if "layer" in snapshot.columns else F.lit(None).cast("string")
    enabled = F.array(*(F.lit(k) for k in limits))
    own = F.when(F.array_contains(enabled, own), own)
    x = snapshot.withColumn("layer", F.coalesce(named[F.col("id")], own, by_type[F.lower("asset_type")])).where(F.array_contains(enabled, F.col("layer")))
    most = F.create_map(*(F.lit(x) for k, n in limits.items() for x in (k, n if n is not None else (1 << 31) - 1)))
    place = F.row_number().over(Window.partitionBy("layer").orderBy("id"))
    return x.withColumn("_i", place).where(F.col("_i") <= most[F.col("layer")]).drop("_i")


def masked(panel: DataFrame, columns: list[str], asset_type: str) -> DataFrame:
    """Columns that are null for rows of any other asset type."""
    own = F.lower("asset_type") == asset_type
    return panel.withColumns({c: F.when(own, F.col(c)) for c in columns})


def by_regime(panel: DataFrame, regimes: DataFrame, families: dict[str, tuple[str, ...]], columns: dict[str, list[str]], default: str) -> DataFrame:
    """Factor columns kept where the day's regime (`default` where it is unknown) maps to their family, null elsewhere."""
    x = panel.join(regimes.select("date", "regime"), "date", "left").withColumn("regime", F.coalesce("regime", F.lit(default)))
    on = lambda family: F.col("regime").isin([r for r, fs in families.items() if family in fs])
    return x.withColumns({c: F.when(on(f), F.col(c)) for f, cs in columns.items() for c in cs})


def members_of(instruments: DataFrame, column: str, name: str) -> DataFrame:
    """Ids of an industry or sector, in order."""
    return instruments.where(F.lower(column) == name.lower()).select("id").orderBy("id")


def panel_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on date and id, and on fold where both sides have one; columns of the right that the left has are left out."""
    keys = ["date", "id", *(["fold"] if "fold" in left.columns and "fold" in right.columns else [])]
    return left.join(right.select(*keys, *(c for c in right.columns if c not in left.columns)), keys)


def merged_panels(panels: list[DataFrame], keys: tuple[str, ...] = ("date", "id")) -> DataFrame:
    """Outer merge of several panels with columns of their own: one union and one aggregation instead of a chain of full joins. Keys are unique in each panel."""
    names = [c for p in panels for c in p.columns if c not in keys]
    if len(set(names)) != len(names):
        raise ValueError("panels share columns")
    union = panels[0]
    for p in panels[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in names))


def labelled(weights: DataFrame, labels: DataFrame, label: str, strict: bool = True) -> DataFrame:
    """Weights with their label; with `strict` a weight without one is an error when it is read."""
    x = weights.join(labels.select("date", "id", label), ["date", "id"], "left")
    return x.withColumn(label, F.coalesce(label, F.raise_error(F.lit(f"a weight has no {label}")).cast(dict(labels.dtypes)[label]))) if strict else x


def aligned_folds(baseline: DataFrame, candidate: DataFrame, values: list[str]) -> DataFrame:
    """Folds of two experiments side by side with differences, matched by `test_start` if that matches at least as many as `fold`, else by `fold`."""
    b, c = (df.select("fold", "test_start", *(F.col(v).alias(f"{s}_{v}") for v in values)) for df, s in ((baseline, "baseline"), (candidate, "candidate")))
    by_start = b.join(c.drop("fold"), "test_start").withColumn("_by", F.lit("start"))
    by_fold = b.join(c.drop("test_start"), "fold").withColumn("_by", F.lit("fold"))
    both = by_start.unionByName(by_fold)
    counts = both.agg(F.count_if(F.col("_by") == "start").alias("_s"), F.count_if(F.col("_by") == "fold").alias("_f"))
    x = both.crossJoin(F.broadcast(counts)).where((F.col("_by") == "start") == ((F.col("_s") >= F.col("_f")) & (F.col("_s") > 0)))  # one row
    return x.select("fold", "test_start", *(f"{s}_{v}" for v in values for s in ("baseline", "candidate")), *((F.col(f"candidate_{v}") - F.col(f"baseline_{v}")).alias(f"delta_{v}") for v in values))


def on_calendar(series: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """Returns on another calendar: the last value at or before each of its dates (0 counts as missing), and the change between them."""
    clean = series.where((F.col(value) != 0) & F.col(value).isNotNull()).select(F.lit(1).alias("_k"), F.col("date").alias("_at"), value)
    x = R.asof(calendar.select("date").withColumn("_k", F.lit(1)), clean, ["_k"], "date", "_at", [value]).drop("_k")
    w = Window.orderBy("date")  # one row a day
    return x.withColumn("ret", R.ratio(F.col(value), F.lag(value).over(w)) - 1)


def coverage_gaps(bars: DataFrame, calendar: DataFrame, limit: float = 0.05) -> DataFrame:
    """Per instrument between its first and last bar: trading days expected, observed and missing, the rate, and whether it exceeds the limit."""
    days = calendar.select("date", "seq")
    x = bars.select("id", "date").distinct().join(days, "date").groupBy("id").agg(F.count("*").alias("observed"), (F.max("seq") - F.min("seq") + 1).cast("long").alias("expected"))
    rate = R.ratio(F.col("expected") - F.col("observed"), F.col("expected"))
    return x.select("id", "expected", "observed", (F.col("expected") - F.col("observed")).alias("missing"), rate.alias("gap_rate"), (rate > limit).alias("flagged"))


def nearest_fit(dates: DataFrame, fits: DataFrame, fitted: str, values: list[str]) -> DataFrame:
    """Each date with the latest model fitted on an earlier date or on it."""
    one = F.lit(1).alias("_k")
    x = R.asof(dates.select("*", one), fits.select("*", one, F.col(fitted).alias("_fit")), ["_k"], "date", fitted, ["_fit", *values])
    return x.drop("_k").withColumnRenamed("_fit", fitted)


def swept(scores: DataFrame, score: str, label: str, counts: list[int], thresholds: list[float]) -> DataFrame:
    """Every (top k, least score) candidate on all dates: mean label of the names picked, hit rate, mean turnover and picks, from one pass in which each row meets the candidates that pick it."""
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "id"))
    grid = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("least")) for k in counts for t in thresholds))
    x = scores.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("_i", place).where(F.col("_i") <= max(counts))
    x = x.select("date", "id", score, F.col(label).alias("_y"), "_i", F.explode(grid).alias("c")).where((F.col("_i") <= F.col("c.k")) & (F.col(score) >= F.col("c.least")))
    days = scores.select("date").distinct().withColumn("_d", F.row_number().over(Window.orderBy("date")))  # one row a day
    x = x.join(days, "date").select("date", "_d", "id", "_y", "c.k", "c.least", (1 / F.count("*").over(Window.partitionBy("date", "c.k", "c.least"))).alias("_w"))
    h = Window.partitionBy("k", "least", "id").orderBy("_d")
    held = F.when(F.lag("_d").over(h) == F.col("_d") - 1, F.lag("_w").over(h)).otherwise(0.0)
    nxt = F.when(F.lead("_d").over(h) == F.col("_d") + 1, F.lit(0.0)).otherwise(F.col("_w"))  # sold on the next date
    x = x.withColumn("_buy", F.abs(F.col("_w") - held)).withColumn("_sold", nxt)
    daily = x.groupBy("k", "least", "date", "_d").agg(F.avg("_y").alias("_r"), F.count("*").alias("_n"), F.sum("_buy").alias("_b"), F.sum("_sold").alias("_s"), F.avg((F.col("_y") > 0).cast("int")).alias("_h"))
    c = Window.partitionBy("k", "least").orderBy("_d")
    before = F.when(F.lag("_d").over(c) == F.col("_d") - 1, F.lag("_s").over(c))
    daily = daily.withColumn("_t", F.when(before.isNotNull(), (F.col("_b") + before) / 2))
    return daily.groupBy("k", "least").agg(F.count("*").alias("dates"), F.avg("_r").alias("mean_label"), F.avg("_h").alias("hit_rate"), F.avg("_t").alias("turnover"), F.sum("_n").alias("picks"))


def _limit(x: Column, at: Column) -> Column:
    return F.coalesce(x, F.lit(False)) & at.isNotNull()


def blocked(orders: DataFrame) -> DataFrame:
    """Why a trade towards a target cannot be made: suspended, no_price, limit_up for purchases, limit_down for sales; `allowed` is what remains of the change after what can be closed. Columns: change, price, limit_up, limit_down, suspended, closable."""
    c = F.col
    up, down = _limit(c("price") >= c("limit_up"), c("limit_up")), _limit(c("price") <= c("limit_down"), c("limit_down"))
    why = F.when(F.coalesce("suspended", F.lit(False)), "suspended").when(c("price").isNull() | F.isnan("price"), "no_price").when((c("change") > 0) & up, "limit_up").when((c("change") < 0) & down, "limit_down")
    return orders.withColumn("blocked", why).withColumn("allowed", F.when(why.isNotNull(), F.lit(0).cast("double")).otherwise(F.greatest(c("change"), -c("closable")).cast("double")))

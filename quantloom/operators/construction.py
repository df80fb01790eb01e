"""Portfolio construction: caps, smoothing, budgets, orders, and their checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import rolling as R
from quantloom.functions import scalars as S
from quantloom.sources.shared import written

TINY = 1e-12


def capped_equally(df: DataFrame, cap: float, rounds: int = 10, by: str = "date", key: str = "id") -> DataFrame:
    """Weights cut at `cap`; what is cut goes in equal parts to the names below it, `rounds` times at most, then all sum to 1, so they may end above the cap.

    One group is one date's portfolio, a bounded list of names."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["weight"].astype(float).to_numpy().copy()
        for _ in range(rounds):
            cut = w.clip(max=cap)
            excess = w.sum() - cut.sum()
            free = cut < cap
            if excess < 1e-10 or not free.any():
                break
            w = cut
            w[free] = (w[free] + excess / free.sum()).clip(max=cap)
        total = w.sum()
        return pdf.assign(weight=w / total if total > 0 else w)

    return df.select(by, key, "weight").groupBy(by).applyInPandas(one, df.select(by, key, "weight").schema)


def smoothed_weights(df: DataFrame, halflife: float, least: float = 0.005, key: str = "id", order: str = "date", book: str = "book") -> DataFrame:
    """Weights smoothed over the dates of a book: alpha x target + (1 - alpha) x the smoothed weight before, alpha = 2 / (halflife + 1); new names start at their target, names below `least` are dropped, each date is scaled to 1.

    The recursion runs over the dates of one book, whose rows must fit a task."""
    alpha = 2 / (halflife + 1)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        rows = []
        for day, part in pdf.sort_values(order).groupby(order, sort=True):
            raw = dict(zip(part[key], part["weight"].astype(float), strict=True))
            new = {k: raw.get(k, 0.0) if k not in state else alpha * raw.get(k, 0.0) + (1 - alpha) * state[k] for k in raw.keys() | state.keys()}
            state = {k: v for k, v in new.items() if v >= least}
            total = sum(state.values())
            rows += [(pdf[book].iloc[0], day, k, v / total) for k, v in state.items()]
        return pd.DataFrame(rows, columns=[book, order, key, "weight"])

    kinds = dict(df.dtypes)
    return df.groupBy(book).applyInPandas(one, f"{book} {kinds[book]}, {order} {kinds[order]}, {key} {kinds[key]}, weight double")


def within_budget(df: DataFrame, budget: float, by: str = "date", key: str = "id") -> DataFrame:
    """Moves from `current` towards `target`, largest |move| x |alpha| first, until buys and sells have each used up `budget`; ties by key.

    A side's use before a row is a running sum, so no row waits for another task."""
    move = F.coalesce("target", F.lit(0.0)) - F.coalesce("current", F.lit(0.0))
    x = df.withColumn("_move", move).withColumn("_side", F.signum(move)).withColumn("_rank", F.abs(move) * F.abs(F.coalesce("alpha", F.lit(1.0))))
    before = Window.partitionBy(by, "_side").orderBy(F.desc("_rank"), key).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.abs("_move")).over(before), F.lit(0.0))
    allowed = F.greatest(F.lit(0.0), F.least(F.abs("_move"), budget - used))
    return x.select(by, key, (F.coalesce("current", F.lit(0.0)) + F.col("_side") * allowed).alias("weight"), (F.col("_side") * allowed).alias("moved"))


def orders(df: DataFrame, value: float, lot: int = 100, least: float = 0.0, most: int | None = None, by: str = "date", key: str = "id") -> DataFrame:
    """Orders in whole lots from `current` shares to `weight` of a portfolio of `value` at `price`; orders worth less than `least` are not sent, and of the rest only `most` a date: sales first, then the larger ones."""
    wanted = F.col("weight") * value / F.col("price") - F.col("current")
    x = df.withColumn("shares", S.round_lot(wanted, lot)).withColumn("amount", F.col("shares") * F.col("price"))
    x = x.withColumn("shares", F.when(F.abs("amount") < least, 0).otherwise(F.col("shares")))
    if most is not None:
        place = F.row_number().over(Window.partitionBy(by).orderBy((F.col("shares") == 0).asc(), (F.col("shares") < 0).desc(), F.desc(F.abs("amount")), key))
        x = x.withColumn("_place", place).withColumn("shares", F.when(F.col("_place") <= most, F.col("shares")).otherwise(0)).drop("_place")
    return x.select(by, key, F.col("shares").cast("long").alias("shares"), (F.col("shares") * F.col("price")).alias("amount"), (F.col("current") + F.col("shares")).cast("long").alias("target_shares"))


def period_cost(weights: DataFrame, buy: dict[str, float], sell: dict[str, float], default: tuple[float, float]) -> DataFrame:
    """Per date: cost of the weight changes since the date before at the buy and sell rates of each `asset_type`; the first date buys everything."""
    days = weights.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("date")))  # one row a day
    now = weights.join(days, "date").select("_n", "id", "asset_type", "weight")
    was = now.select((F.col("_n") + 1).alias("_n"), "id", F.col("asset_type").alias("_t"), F.col("weight").alias("_w"))
    both = now.join(was, ["_n", "id"], "full").join(days, "_n").withColumn("_kind", F.coalesce("asset_type", "_t"))
    move = F.coalesce("weight", F.lit(0.0)) - F.coalesce("_w", F.lit(0.0))
    cost = F.greatest(move, F.lit(0.0)) * _rates(buy, default[0]) + F.greatest(-move, F.lit(0.0)) * _rates(sell, default[1])
    return both.groupBy("date").agg(F.sum(cost).alias("cost"), (F.sum(F.abs(move)) / 2).alias("turnover"))


def _rates(rates: dict[str, float], other: float) -> F.Column:
    out = None
    for kind, v in rates.items():
        out = F.when(F.col("_kind") == kind, v) if out is None else out.when(F.col("_kind") == kind, v)
    return F.lit(other) if out is None else out.otherwise(other)


def complete_returns(weights: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Per date: portfolio return and gross exposure; dates on which a held name has no label are left out."""
    both = weights.join(labels.select("date", "id", F.col(label).alias("_l")), ["date", "id"], "left")
    g = both.groupBy("date").agg(F.sum(F.col("weight") * F.col("_l")).alias("ret"), F.sum(F.abs("weight")).alias("gross"), F.bool_and(F.col("_l").isNotNull()).alias("_all"))
    return g.where("_all").drop("_all")


def violations(weights: DataFrame, group: str, single: float, grouped: float, gross: float, positions: tuple[int, int], unknown: str = "Unknown") -> DataFrame:
    """One row of counts: names above `single`; (date, group) exposures above `grouped`, but on days of unknown groups only; dates above and below the gross budget; dates with too few or too many positions."""
    w = weights.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("_g", F.coalesce(group, F.lit(unknown)))
    by_group = w.groupBy("date", "_g").agg(F.sum(F.abs("weight")).alias("_x"), F.count_if(F.col("weight") > single + TINY).alias("_single"), F.count_if(F.col("weight") > TINY).alias("_held"))
    day = by_group.groupBy("date").agg(F.sum("_single").alias("_single"), F.sum("_held").alias("_held"), F.sum("_x").alias("_gross"), F.count_if(F.col("_x") > grouped + TINY).alias("_over"), F.bool_and(F.col("_g") == unknown).alias("_blind"))
    held = F.col("_held") > 0
    count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    return day.agg(
        F.sum("_single").alias("single"), F.coalesce(F.sum(F.when(~F.col("_blind"), F.col("_over"))), F.lit(0)).alias("grouped"), count(F.col("_gross") > gross + 1e-8).alias("gross_over"), count(F.col("_gross") < gross - 1e-8).alias("gross_short"),
        count(held & (F.col("_held") < positions[0])).alias("too_few"), count(held & (F.col("_held") > positions[1])).alias("too_many"),
    )


def layer_drift(weights: DataFrame, layer: str, budgets: dict[str, float]) -> DataFrame:
    """Per layer: mean and largest exposure over all dates (0 where a date has none) and mean and largest distance from its budget."""
    days = weights.select("date").distinct()
    grid = days.select("date", F.explode(F.create_map(*(x for k, v in budgets.items() for x in (F.lit(k), F.lit(v))))).alias("layer", "budget"))
    held = weights.groupBy("date", F.col(layer).alias("layer")).agg(F.sum("weight").alias("_x"))
    x = grid.join(held, ["date", "layer"], "left").withColumn("_x", F.coalesce("_x", F.lit(0.0))).withColumn("_d", F.abs(F.col("_x") - F.col("budget")))
    return x.groupBy("layer").agg(F.avg("_x").alias("weight_mean"), F.max("_x").alias("weight_max"), F.avg("_d").alias("deviation_mean"), F.max("_d").alias("deviation_max"), F.count("*").alias("dates"))


def benchmark_skill(daily: DataFrame, year: int = 252, free: float = 0.02 / 252, window: int = 20) -> DataFrame:
    """One row from `ret` (net) and `bench` per date: excess mean and hit rate, deepest fall of compounded excess, worst `window`-day shortfall, tracking error, information ratio, beta and Jensen's alpha; population moments, null returns are left out."""
    rows = daily.where(F.col("ret").isNotNull() & F.col("bench").isNotNull()).withColumn("_one", F.lit(1)).withColumn("_x", F.col("ret") - F.col("bench"))
    w = Window.partitionBy("_one").orderBy("date")  # one row a day
    rows = rows.withColumn("_e", F.sum(F.log1p("_x")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_fall", 1 - F.exp(F.col("_e") - F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("_short", -F.sum("_x").over(w.rowsBetween(1 - window, 0)))
    g = rows.agg(
        F.count("*").alias("dates"), F.avg("_x").alias("excess_mean"), F.avg((F.col("_x") > 0).cast("int")).alias("hit_rate"), F.max("_fall").alias("excess_drawdown"), F.greatest(F.max("_short"), F.max(-F.col("_x")), F.lit(0.0)).alias("shortfall"),
        F.stddev_pop("_x").alias("_s"), F.covar_pop("ret", "bench").alias("_c"), F.var_pop("bench").alias("_v"), F.avg("ret").alias("_p"), F.avg("bench").alias("_b"),
    )
    root, beta = float(year) ** 0.5, F.try_divide(F.col("_c"), F.col("_v"))
    alpha = (F.col("_p") - (free + beta * (F.col("_b") - free))) * year
    return g.select("dates", "excess_mean", "hit_rate", "excess_drawdown", "shortfall", (F.col("_s") * root).alias("tracking_error"), (F.try_divide(F.col("excess_mean"), F.col("_s")) * root).alias("information_ratio"), beta.alias("beta"), alpha.alias("jensen_alpha"))


def allocated(df: DataFrame, score: str, cap: float, budget: float | Column = 1.0, by: list[str] | None = None, key: str = "id", out: str = "weight") -> DataFrame:
    """A budget shared in proportion to scores, at most `cap` each, what is cut going to the others by score; scores below 0 count as 0, and where none is positive all count alike.

    Water filling by prefix sums: the names at the cap are the first of the
    order by score, and name i is one of them if, with those above it at the cap,
    its share of the rest exceeds the cap. Names with no score share what the
    others cannot take. A name without weight is left out."""
    by = by or ["date"]
    every = Window.partitionBy(*by)
    order = every.orderBy(F.desc("_s"), key).rowsBetween(Window.unboundedPreceding, -1)
    money = budget if isinstance(budget, Column) else F.lit(float(budget))
    x = df.where(F.col(key).isNotNull()).withColumn("_s", F.greatest(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("_s", F.when(F.sum("_s").over(every) > 0, F.col("_s")).otherwise(1.0)).withColumn("_n", F.count("*").over(every)).withColumn("_b", F.least(money, cap * F.col("_n")))
    x = x.withColumn("_i", F.row_number().over(every.orderBy(F.desc("_s"), key))).withColumn("_rest", F.sum("_s").over(every) - F.coalesce(F.sum("_s").over(order), F.lit(0.0)))
    x = x.withColumn("_over", F.col("_s") * (F.col("_b") - (F.col("_i") - 1) * cap) > (cap + 1e-15) * F.col("_rest"))
    x = x.withColumn("_k", F.coalesce(F.min(F.when(~F.col("_over"), F.col("_i"))).over(every), F.col("_n") + 1) - 1)
    x = x.withColumn("_free", F.sum(F.when(F.col("_i") > F.col("_k"), F.col("_s"))).over(every))
    left = F.col("_b") - F.col("_k") * cap
    rest = F.when(F.col("_free") > 0, left * R.ratio(F.col("_s"), F.col("_free"))).otherwise(R.ratio(left, (F.col("_n") - F.col("_k")).cast("double")))
    x = x.withColumn(out, F.when(F.col("_i") <= F.col("_k"), F.lit(float(cap))).otherwise(rest))
    return x.drop("_s", "_n", "_b", "_i", "_rest", "_over", "_k", "_free").where(F.col(out) > 1e-15)


def unclassified(group: str, by: list[str]) -> Column:
    """Whether all that is known of a date's groups is `Unknown`; such dates have no group to cap."""
    every = Window.partitionBy(*by)
    other = F.count_if(F.col(group).isNotNull() & (F.col(group) != "Unknown")).over(every)
    return (other == 0) & (F.count_if(F.col(group) == "Unknown").over(every) > 0)


def group_capped(weights: DataFrame, group: str, cap: float, budget: float = 1.0, by: list[str] | None = None, key: str = "id", skip: str | None = None) -> DataFrame:
    """Weights scaled group by group so that no group has more than `cap`: groups share the budget (or the sum of weights, if less) as names do.

    A missing group is `Unknown`. Dates that `skip`, a flag column, names stay as
    they are; without it those on which no group but `Unknown` is known."""
    by = by or ["date"]
    x = weights.withColumn("_g", F.when(F.trim(F.coalesce(F.col(group).cast("string"), F.lit(""))) == "", "Unknown").otherwise(F.col(group).cast("string")))
    x = x.withColumn("_skip", F.col(skip) if skip else unclassified(group, by))
    groups = x.groupBy(*by, "_g").agg(F.sum("weight").alias("_w"), F.max("_skip").alias("_skip"))
    groups = groups.withColumn("_all", F.sum("_w").over(Window.partitionBy(*by)))
    shares = allocated(groups.where("not _skip"), "_w", cap, F.least(F.lit(float(budget)), F.col("_all")), by, "_g", "_target")
    shares = shares.select(*by, "_g", (F.col("_target") / F.col("_w")).alias("_scale")).unionByName(groups.where("_skip").select(*by, "_g", F.lit(1.0).alias("_scale")))
    return x.join(shares, [*by, "_g"]).withColumn("weight", F.col("weight") * F.col("_scale")).drop("_g", "_scale", "_skip").where("weight > 0")


def exposure_capped(weights: DataFrame, group: str, caps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Weights of groups above their own cap (`group`, `cap`) scaled down to it; what is cut stays in cash."""
    by = by or ["date"]
    total = F.sum("weight").over(Window.partitionBy(*by, group))
    x = weights.withColumn("_w", total).join(caps.select(F.col("group").alias(group), F.col("cap").alias("_cap")), group, "left")
    return x.withColumn("weight", F.col("weight") * F.when(F.col("_cap") < F.col("_w"), F.col("_cap") / F.col("_w")).otherwise(1.0)).drop("_w", "_cap").where("weight > 0")


def _adjusting(target: Column) -> Column:
    """Shares to trade towards `target`: less than half the least order is not traded, less than the least order is the least order, more is rounded to lots (half to even); a position may always be sold out; no trade of a suspended name, no purchase at the upper and no sale at the lower limit, and no sale beyond what can be closed."""
    held, least, lot = F.col("held"), F.col("min_qty"), F.col("lot")
    d = target - held
    size = F.abs(d)
    d = F.when(-d == held, d).when(size < least / 2, 0.0).when(size < least, least * F.signum(d)).otherwise(F.rint(d / lot) * lot)
    d = F.when((d < 0) & (-d > held), -held).otherwise(d)
    barred = F.coalesce(F.col("suspended"), F.lit(False)) | F.col("price").isNull() | F.coalesce((d > 0) & (F.col("price") >= F.col("limit_up")), F.lit(False)) | F.coalesce((d < 0) & (F.col("price") <= F.col("limit_down")), F.lit(False))
    d = F.when(barred, 0.0).otherwise(d)
    return F.greatest(d, -F.col("closable"))


def _adjusted(target: np.ndarray, x: dict[str, np.ndarray]) -> np.ndarray:
    """`_adjusting` for candidates in rows and names in columns held by a task; NaN in a price or limit is none."""
    held, least, lot, price = x["held"], x["min_qty"], x["lot"], x["price"]
    d = target - held
    size = np.abs(d)
    out = np.where(-d == held, d, np.where(size < least / 2, 0.0, np.where(size < least, least * np.sign(d), np.rint(d / lot) * lot)))
    out = np.where((out < 0) & (-out > held), -held, out)
    barred = (x["suspended"] != 0) | np.isnan(price) | (out > 0) & (price >= x["limit_up"]) | (out < 0) & (price <= x["limit_down"])
    return np.fmax(np.where(barred, 0.0, out), -x["closable"])


def _costs(batches: Iterator[pa.RecordBatch], candidates: Callable[[np.ndarray], np.ndarray], commission: float, minimum: float, tax: float) -> Iterator[pa.RecordBatch]:
    """Per book and safety what the batch's names cost and what is then invested, and the book's cash, value and wish. `candidates` gives the safeties of a book from its first row's `_want` and `_near`."""
    numbers = ("weight", "price", "held", "closable", "min_qty", "lot", "suspended", "limit_up", "limit_down", "cash", "_total", "_want", "_near")
    for batch in batches:
        x = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in numbers}
        books = batch.column(0).dictionary_encode()
        code = pc.fill_null(books.indices, len(books.dictionary)).to_numpy(zero_copy_only=False)
        at, sums = [], []
        for book in np.unique(code):
            mine = np.flatnonzero(code == book)
            first = {c: x[c][mine[0]] for c in ("cash", "_total", "_want", "_near")}
            s = candidates(first["_want"], first["_near"])
            spent, after = np.zeros(len(s)), np.zeros(len(s))
            if np.isnan([first[c] for c in ("cash", "_total", "_want")]).any():  # a book without a value can afford nothing
                spent += np.nan
            for lo in range(0, len(mine), 1024):
                y = {c: v[mine[lo : lo + 1024]] for c, v in x.items()}
                with np.errstate(all="ignore"):
                    target = np.where((y["price"] == 0) | np.isnan(y["price"]), 0.0, y["_total"] * s[:, None] * y["weight"] / y["price"])
                    q = _adjusted(np.rint(np.nan_to_num(target, posinf=np.inf, neginf=-np.inf)), y)
                    money = np.where(np.isnan(y["price"]), 0.0, q * y["price"])
                    fee = np.where(q != 0, np.maximum(np.abs(money) * commission, minimum) + np.where(q < 0, np.abs(money) * tax, 0.0), 0.0)
                    worth = np.nan_to_num(y["held"] * y["price"], posinf=np.inf, neginf=-np.inf)
                spent += (money + fee).sum(axis=1)
                after += (worth + money).sum(axis=1)
            at.append(np.full(len(s), mine[0]))
            sums.append(np.stack([s, spent, after, *(np.full(len(s), first[c]) for c in ("cash", "_total", "_want"))]))
        both = np.concatenate(sums, axis=1) if sums else np.empty((6, 0))
        where = pa.array(np.concatenate(at) if at else np.empty(0, np.int64))
        yield pa.record_batch([batch.column(0).take(where), *map(pa.array, both)], names=[batch.schema.names[0], "_s", "_spent", "_after", "_cash", "_t", "_w"])


def budget_safe_orders(names: DataFrame, book: str = "book", commission: float = 8e-4, minimum: float = 5.0, tax: float = 5e-4, coarse: float = 0.02, fine: float = 0.001) -> DataFrame:
    """Orders that bring each book to its target weights with the cash it has: book, id, safety, quantity.

    Target quantities are total value x safety x weight / price. Every safety of
    a coarse grid from 1.2 (1 for books with at most 95 % invested) down to 0,
    and then of a fine one around the best, is costed: purchases, commission
    with its minimum and tax on sales against the cash. Of the affordable ones
    that nearest to the target share invested wins, the larger on a tie. A book
    that can afford none trades nothing.

    No row is repeated for a candidate: a task costs all of them over an Arrow
    batch, and the sums of the batches are added up by book.

    Columns of names: book, id, weight, price, held, closable, min_qty, lot,
    suspended, limit_up, limit_down, and cash, the same for a book."""
    value = F.coalesce(F.col("held") * F.col("price"), F.lit(0.0))
    every = Window.partitionBy(book)
    x = names.select(book, "id", F.coalesce("weight", F.lit(0.0)).alias("weight"), "price", "held", "closable", F.col("min_qty").cast("double").alias("min_qty"), F.col("lot").cast("double").alias("lot"), "suspended", "limit_up", "limit_down", "cash")
    x = written(x.withColumn("_total", F.col("cash") + F.sum(value).over(every)).withColumn("_want", F.sum("weight").over(every)), "books")  # read three times
    kind = dict(x.dtypes)[book]

    def costed(rows: DataFrame, candidates: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        plain = rows.select(book, "weight", "price", "held", "closable", "min_qty", "lot", F.coalesce("suspended", F.lit(False)).cast("double").alias("suspended"), "limit_up", "limit_down", "cash", "_total", "_want", "_near")
        y = plain.mapInArrow(lambda it: _costs(it, candidates, commission, minimum, tax), f"`{book}` {kind}, _s double, _spent double, _after double, _cash double, _t double, _w double")
        g = y.groupBy(book, "_s").agg(F.sum("_spent").alias("_spent"), F.sum("_after").alias("_after"), *(F.max(c).alias(c) for c in ("_cash", "_t", "_w")))
        away = F.round(F.abs(F.col("_after") / F.col("_t") - F.col("_w")), 9)
        return g.where(F.col("_spent") < F.col("_cash")).groupBy(book).agg(F.min(F.struct(away.alias("away"), (-F.col("_s")).alias("s"))).alias("_best")).select(book, (-F.col("_best.s")).alias("_s"))

    def every_coarse(want: float, _: float) -> np.ndarray:
        return np.array([round(k * coarse, 6) for k in range(round((1.2 if want > 0.95 else 1.0) / coarse) + 1)])

    def around(want: float, near: float) -> np.ndarray:
        reach = round(coarse / fine)
        s = np.array([round(near + k * fine, 6) for k in range(-reach, reach + 1)])
        return s[(s >= 0) & (s <= (1.2 if want > 0.95 else 1.0))]

    rough = costed(x.withColumn("_near", F.lit(0.0)), every_coarse).withColumnRenamed("_s", "_near")
    best = costed(x.join(rough, book), around)
    q = _adjusting(F.rint(F.coalesce(R.ratio(F.col("_total") * F.col("_s") * F.col("weight"), F.col("price")), F.lit(0.0))))
    out = x.join(best, book, "left")
    return out.select(book, "id", F.col("_s").alias("safety"), F.when(F.col("_s").isNotNull(), q).otherwise(0.0).cast("long").alias("quantity"))

"""Ledgers from fills: lots, average cost, valuation and commissions."""

from __future__ import annotations

from collections import deque
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.walks import walk


def open_lots(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First-in-first-out lots still open after all fills, for positions that never turn short: `quantity` left of each purchase.

    A purchase is consumed by the sales of its key beyond the purchases before
    it, so running sums replace the queue. Columns: by, order, quantity (sales
    negative). Sales beyond what is held close everything and are ignored."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    buy, sell = F.greatest("quantity", F.lit(0)), F.greatest(-F.col("quantity"), F.lit(0))
    # a sale beyond the holding sells the holding only: the floor of the running position is lifted by its minimum
    x = trades.withColumn("_buy", F.sum(buy).over(run)).withColumn("_net", F.sum("quantity").over(run))
    lift = F.greatest(F.lit(0), F.max(-F.col("_net")).over(run))
    x = x.withColumn("_sold", F.sum(sell).over(run) - lift)
    sold = F.max("_sold").over(every)
    left = F.least(F.col("quantity"), F.greatest(F.lit(0), F.col("_buy") - sold))
    return x.withColumn("left", left).where("quantity > 0 and left > 0").select(*by, *order, F.col("left").alias("quantity"))


def average_cost(trades: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Per fill: position, average cost and realised profit of the fill; a purchase moves the average, a sale realises against it, and sells what is held at most.

    The average depends on the path, so the fills of one key are walked through in one task; keys run in parallel. Columns: key, order, quantity (sales negative), price, fee."""
    kinds = dict(trades.dtypes)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        held = cost = 0.0
        out = []
        for row in pdf.sort_values(order).itertuples(index=False):
            n, price, fee = float(row.quantity), float(row.price), float(row.fee)
            gain = 0.0
            if n > 0:
                cost = (held * cost + n * price + fee) / (held + n)
                held += n
            else:
                sold = min(-n, held)
                gain = sold * (price - cost) - fee if sold else 0.0
                held -= sold
                cost = cost if held > 0 else 0.0
            out.append((getattr(row, key), getattr(row, order), held, cost, gain))
        return pd.DataFrame(out, columns=[key, order, "held", "cost", "realised"])

    return trades.groupBy(key).applyInPandas(walk, f"{key} {kinds[key]}, {order} {kinds[order]}, held double, cost double, realised double")


def futures_fees(fills: DataFrame, rates: DataFrame) -> DataFrame:
    """Commission of each fill by its product's rule: by money (rate x amount) or by volume (rate x lots); what closes a position of today pays the rate of close-today, other closes that of close, the rest that of open. A product without a rule pays 0.

    Columns of fills: product, lots, amount, effect (open or close), today (lots that close a position of today)."""
    x = fills.join(F.broadcast(rates), "product", "left")  # a rule a product; a shuffle by product would put all fills of one in a task
    share = F.when(F.col("lots") != 0, F.least(F.col("today"), F.col("lots")) / F.col("lots")).otherwise(0.0)
    base = F.when(F.col("kind") == "money", F.col("amount")).otherwise(F.col("lots").cast("double"))
    fee = F.when(F.col("effect") == "open", base * F.col("open_rate")).otherwise(base * (share * F.col("close_today_rate") + (1 - share) * F.col("close_rate")))
    return x.withColumn("commission", F.coalesce(fee, F.lit(0.0)))


def valuation(trades: DataFrame, prices: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """Per book, instrument and price date from the first trade on: quantity held at the close, cash spent so far and market value.

    Trades and prices are united and carried forward by one window; no row is multiplied. Columns of trades: by, key, date, quantity, amount (paid, sales negative); prices: key, date, close, for all books of `by` that trade the instrument."""
    books = trades.select(*by, key).distinct()
    t = trades.groupBy(*by, key, "date").agg(F.sum("quantity").alias("_q"), F.sum("amount").alias("_a"))
    grid = books.join(prices.select(key, "date", "close"), key)
    both = grid.join(t, [*by, key, "date"], "full")
    run = Window.partitionBy(*by, key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = both.select(*by, key, "date", F.last("close", ignorenulls=True).over(run).alias("close"), F.sum("_q").over(run).alias("quantity"), F.sum("_a").over(run).alias("spent"))
    return x.where("quantity is not null").withColumn("value", F.col("quantity") * F.col("close"))


def lot_pairs(trades: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Which purchase each sale closes, first in first out, for positions that never turn short: by, opened, closed (structs of `order`), quantity.

    Purchases and sales cut the line of shares at their running sums. All cuts
    of a key in one order give the pieces between them; the next purchase and
    the next sale at or after a piece are the ones that own it. Sales beyond
    what is held close everything and the rest is ignored."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    x = trades.withColumn("_buy", F.sum(F.greatest("quantity", F.lit(0))).over(run)).withColumn("_net", F.sum("quantity").over(run))
    x = x.withColumn("_sold", F.sum(F.greatest(-F.col("quantity"), F.lit(0))).over(run) - F.greatest(F.lit(0), F.max(-F.col("_net")).over(run)))
    x = x.withColumn("_was", F.coalesce(F.max("_sold").over(before), F.lit(0)))
    at, me = F.when(F.col("quantity") > 0, F.col("_buy")).otherwise(F.col("_sold")), F.struct(*order)
    cuts = x.where((F.col("quantity") > 0) | (F.col("_sold") > F.col("_was"))).select(*by, at.alias("_at"), F.when(F.col("quantity") > 0, me).alias("opened"), F.when(F.col("quantity") <= 0, me).alias("closed"))
    down = Window.partitionBy(*by).orderBy(F.desc("_at"))
    ahead = down.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    owner = lambda c: F.last(c, ignorenulls=True).over(ahead).alias(c)
    pieces = cuts.select(*by, owner("opened"), owner("closed"), (F.col("_at") - F.coalesce(F.lead("_at").over(down), F.lit(0))).alias("quantity"))
    return pieces.where("opened is not null and closed is not null and quantity > 0")


class _Lots:
    """Open lots of one position, oldest first; negative when short."""

    def __init__(self):
        self.queue: deque[list] = deque()

    def step(self, row: tuple) -> list[tuple]:
        _, day, quantity, today, ratio = row
        out: list[tuple] = []
        if ratio is not None:
            self.split(Decimal(repr(ratio)))
        if not quantity:
            return out
        q = self.queue
        if not q or q[0][1] * quantity >= 0:
            if q and q[-1][0] == day:
                q[-1][1] += quantity
            else:
                q.append([day, quantity])
            return out
        if today and q[-1][0] >= day:
            quantity = self.take(-1, day, quantity, out)
        while quantity and q:
            quantity = self.take(0, day, quantity, out)
        if quantity:
            q.append([day, quantity])  # the position turns
        return out

    def take(self, at: int, day, quantity: int, out: list[tuple]) -> int:
        """Close against one lot; what is left of the trade."""
        opened, held = self.queue[at]
        n = min(abs(held), abs(quantity))
        sign = 1 if held > 0 else -1
        if n:  # splits can leave empty lots
            out.append((opened, day, n * sign))
        if n == abs(held):
            del self.queue[at]
        else:
            self.queue[at][1] -= n * sign
        return quantity + n * sign

    def split(self, ratio: Decimal) -> None:
        """Lots grow by the ratio, each rounded half to even; the newest takes what rounding leaves of the whole."""
        if self.queue:
            whole = round(Decimal(sum(n for _, n in self.queue)) * ratio)
            for lot in self.queue:
                lot[1] = round(Decimal(lot[1]) * ratio)
            self.queue[-1][1] += whole - sum(n for _, n in self.queue)


def lot_matches(trades: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """key, opened, closed, quantity: which lot each trade closes, and at the end the lots still open (`closed` null), with the rules that running sums cannot state.

    Purchases of a day are one lot. Trades flagged `today` close the lot of
    their own day first, then the oldest; a trade beyond the position turns it
    (negative quantities are short lots); `ratio`, where there is one, splits
    all lots before the trade of its row. Positions are walked through in one
    pass with their open lots as state. Columns: key, order, date, quantity
    (whole, sales negative), today, ratio."""
    kinds = dict(trades.dtypes)
    end = lambda s: [(d, None, n) for d, n in s.queue if n]
    return walk(trades, [key], [order], ["date", "quantity", "today", "ratio"], _Lots, _Lots.step, f"{key} {kinds[key]}, opened date, closed date, quantity long", end)

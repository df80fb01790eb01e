"""Drawdown stops of portfolios with several levels, a cooldown and a regime gate; the same state machine for tables and streams."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.walks import walk

# Level, drawdown from which it holds, exposure that it allows.
LEVELS = (("yellow", 0.10, 0.70), ("orange", 0.15, 0.40), ("red", 0.20, 0.00))
COOLDOWN = 10


@dataclass
class Stop:
    """The state of one portfolio, six plain values."""

    equity: float = 1.0
    peak: float = 1.0
    level: str = "normal"
    cooldown: int = 0
    bankrupt: bool = False

    def step(self, ret: float | None, risk: str | None, levels: tuple = LEVELS, cooldown: int = COOLDOWN, gated: bool = True) -> tuple:
        """One day's return and the market's risk state; gives equity, drawdown, level, cap, cooldown left and whether the level changed.

        The last level is sticky: it holds for `cooldown` days, then until the
        market is not `risk_off` and the drawdown is below it. Equity at or
        below zero locks it for good. A missing return is none."""
        self.equity *= 1 + (ret or 0.0)
        self.bankrupt = self.bankrupt or self.equity <= 0
        self.peak = max(self.peak, self.equity)
        fall = min(1.0, max(0.0, 1 - self.equity / self.peak)) if self.peak > 0 else 1.0
        self.cooldown = max(0, self.cooldown - 1)
        was, lock = self.level, levels[-1][0]
        held = was == lock and (self.cooldown > 0 or gated and risk == "risk_off")
        if self.bankrupt or held:
            self.level = lock
        else:
            self.level = next((name for name, at, _ in reversed(levels) if fall >= at), "normal")
            if self.level == lock != was:
                self.cooldown = cooldown
        cap = next((share for name, _, share in levels if name == self.level), 1.0)
        return self.equity, fall, self.level, cap, self.cooldown, self.level != was


_OUT = "equity double, drawdown double, level string, cap double, cooldown int, changed boolean"


def drawdown_levels(daily: DataFrame, key: str = "book", order: str = "date", ret: str = "ret", risk: str = "risk", levels: tuple = LEVELS, cooldown: int = COOLDOWN, gated: bool = True) -> DataFrame:
    """Per portfolio and day the state of its stop; portfolios run in parallel, each in one pass with a few values of state."""
    kinds = dict(daily.dtypes)
    step = lambda s, row: [(row[0], *s.step(row[1], row[2], levels, cooldown, gated))]
    return walk(daily, [key], [order], [ret, risk], Stop, step, f"{key} {kinds[key]}, {order} {kinds[order]}, {_OUT}")


def capped(weights: DataFrame, stops: DataFrame, key: str = "book", order: str = "date") -> DataFrame:
    """Target weights (key, date, id, weight) times the cap of their portfolio and day; without one they stay."""
    x = weights.join(stops.select(key, order, "cap"), [key, order], "left")
    return x.withColumn("weight", F.coalesce("weight", F.lit(0.0)) * F.coalesce("cap", F.lit(1.0)))


def streaming_levels(daily: DataFrame, key: str = "book", order: str = "ts", levels: tuple = LEVELS, cooldown: int = COOLDOWN, gated: bool = True, idle: str | None = None) -> DataFrame:
    """The same on a stream of (key, order, ret, risk), with the state in the query's checkpoint; needs the RocksDB state store.

    Rows of a micro-batch are taken in order. With `idle` seconds a timer
    frees the state of a portfolio that has sent nothing for so long; it starts
    anew should it come back."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Levels(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("stop", "equity double, peak double, level string, cooldown int, bankrupt boolean")

        def handleInputRows(self, group, frames, timers):
            stop = Stop(*self.state.get()) if self.state.exists() else Stop()
            rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
            out = [(group[0], t, *stop.step(None if pd.isna(r) else r, k, levels, cooldown, gated)) for t, r, k in zip(rows[order], rows["ret"], rows["risk"], strict=True)]
            self.state.update(astuple(stop))
            if idle:
                for t in self.handle.listTimers():
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + 1000 * int(idle))
            yield pd.DataFrame(out, columns=[key, order, "equity", "drawdown", "level", "cap", "cooldown", "changed"])

        def handleExpiredTimer(self, group, timers, expired):
            self.state.clear()
            return iter([])

        def close(self):
            pass

    kinds = dict(daily.dtypes)
    rows = daily.select(key, order, "ret", "risk").groupBy(key)
    return rows.transformWithStateInPandas(Levels(), f"{key} {kinds[key]}, {order} {kinds[order]}, {_OUT}", "Append", "processingTime" if idle else "None")

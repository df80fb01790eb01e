"""The research line: bars, factors, labels and their evaluation in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quantloom.operators import evaluation, features, labels


def panel(bars: DataFrame) -> DataFrame:
    """Momentum factors and forward returns of each bar: one shuffle and one sort by instrument serve both."""
    factors = features.momentum(bars, keep=("close",))
    names = tuple(c for c in factors.columns if c not in ("id", "date", "close"))
    return labels.forward_returns(factors, keep=names)


def signal_quality(bars: DataFrame, signal: str = "reversal", label: str = "fwd5", k: int = 5) -> DataFrame:
    return evaluation.signal_summary(panel(bars), signal, label, k)

"""Moments and extremes of the last rows of each instrument, by arrays: the cost of a window grows with the logarithm of its width, not with an update for each row in it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 256


class Series(NamedTuple):
    """The values of one instrument in order, and which of them are there."""

    v: np.ndarray
    there: np.ndarray


def both(f: Callable[..., np.ndarray], *series: Series) -> Series:
    """`f` of the values where all series have one."""
    with np.errstate(all="ignore"):
        return Series(f(*(s.v for s in series)), np.logical_and.reduce([s.there for s in series]))


def ratio(a: Series, b: Series) -> Series:
    """a / b, null where b is 0."""
    q = both(np.divide, a, b)
    return Series(q.v, q.there & (b.v != 0))


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1, x.dtype), x]), n)


Moments = tuple[np.ndarray, ...]


def _back(x: np.ndarray, k: int) -> np.ndarray:
    """The value k rows before, 0 where there is none."""
    return np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[: max(len(x) - k, 0)]])


def _merged(a: Moments, b: Moments) -> Moments:
    """Moments of two neighbouring stretches as one: count and mean, with the central sum of squares or that and the one of cubes, where there. Equal values keep their mean and sums of exactly 0."""
    n, d = np.maximum(a[0] + b[0], 1), b[1] - a[1]
    share = b[0] / n
    out = [a[0] + b[0], a[1] + d * share]
    if len(a) > 2:
        w = a[0] * share
        out.append(a[2] + b[2] + d * d * w)
    if len(a) > 3:
        out.append(a[3] + b[3] + d * d * d * w * (a[0] - b[0]) / n + 3 * d * (a[0] * b[2] - b[0] * a[2]) / n)
    return tuple(out)


def _merged_pairs(a: Moments, b: Moments) -> Moments:
    """The same for count, means of x and y and central sums xx, xy, yy."""
    n, d, e = np.maximum(a[0] + b[0], 1), b[1] - a[1], b[2] - a[2]
    share = b[0] / n
    w = a[0] * share
    return a[0] + b[0], a[1] + d * share, a[2] + e * share, a[3] + b[3] + d * d * w, a[4] + b[4] + d * e * w, a[5] + b[5] + e * e * w


def _moments(part: Moments, n: int, merged: Callable[[Moments, Moments], Moments] = _merged) -> Moments:
    """Moments of the last n rows from those of each row: stretches of 1, 2, 4, ... rows are merged, those that make up n one after the other."""
    out, done, size = None, 0, 1
    with np.errstate(all="ignore"):
        while True:
            if n & size:
                shifted = tuple(_back(v, done) for v in part)
                out, done = shifted if out is None else merged(shifted, out), done + size
            if done == n:
                return out
            part, size = merged(tuple(_back(v, size) for v in part), part), 2 * size


def _extreme(f: np.ufunc, x: np.ndarray, n: int, none: float) -> np.ndarray:
    """f of the last n rows; `none` changes nothing."""
    x, size = np.concatenate([np.full(n - 1, none), x]), 1
    while 2 * size <= n:
        x, size = np.concatenate([x[:size], f(x[size:], x[:-size])]), 2 * size
    return f(x[n - 1 :], x[size - 1 : len(x) - n + size])


def rolling(kind: str, x: Series, n: int, least: int | None = None) -> Series:
    """mean, std (sample), std0 (population), skew, min, max, or share (of values not above the current one) of the last n rows; null below `least` values (default n), as are the sample deviation of one value and the skew of equal ones."""
    count = counted(x, n).v
    enough = (count >= (n if least is None else least)) & (count > 0)
    with np.errstate(all="ignore"):
        if kind == "share":
            return Series(_share(x, n) / count, enough & x.there)
        if kind == "max":  # NaN is the largest
            return Series(_extreme(np.maximum, np.where(x.there, x.v, -np.inf), n, -np.inf), enough)
        if kind == "min":
            real = x.there & ~np.isnan(x.v)
            out = _extreme(np.minimum, np.where(real, x.v, np.inf), n, np.inf)
            return Series(np.where(counted(Series(x.v, real), n).v > 0, out, np.nan), enough)
        zero = np.zeros(len(x.v))
        row = (x.there.astype(float), np.where(x.there, x.v, 0.0), zero, zero)
        if kind == "mean":
            return Series(_moments(row[:2], n)[1], enough)
        m2, m3 = _moments(row, n)[2:] if kind == "skew" else (_moments(row[:3], n)[2], None)
        if kind == "std0":
            return Series(np.sqrt(m2 / count), enough)
        if kind == "std":
            return Series(np.sqrt(m2 / (count - 1)), enough & (count > 1))
        return Series(np.sqrt(count) * m3 / np.sqrt(m2 * m2 * m2), enough & (m2 != 0))


def _share(x: Series, n: int) -> np.ndarray:
    """How many of the last n values are not above the current one."""
    v, t, out = _windows(x.v, n), _windows(x.there, n), np.empty(len(x.v))
    for lo in range(0, len(out), BLOCK):
        at, now = slice(lo, lo + BLOCK), x.v[lo : lo + BLOCK, None]
        out[at] = (t[at] & ((v[at] <= now) | np.isnan(now))).sum(axis=1)
    return out


def counted(x: Series, n: int) -> Series:
    """How many of the last n rows have a value."""
    total = np.cumsum(x.there).astype(float)
    return Series(total - _back(total, n), np.ones(len(x.v), bool))


def covariances(y: Series, x: Series, n: int) -> tuple[Series, Series, Series]:
    """Population covariance, variance of x and variance of y over the last n rows that have both."""
    t = x.there & y.there
    zero = np.zeros(len(t))
    count, _, _, xx, xy, yy = _moments((t.astype(float), np.where(t, x.v, 0.0), np.where(t, y.v, 0.0), zero, zero, zero), n, _merged_pairs)
    with np.errstate(all="ignore"):
        return tuple(Series(v / count, count > 0) for v in (xy, xx, yy))


Made = Callable[[dict[str, Series]], Series]


def by_history(df: DataFrame, specs: dict[str, Made], drop: tuple[str, ...] = (), key: str = "id", order: str = "date") -> DataFrame:
    """Columns made from the double columns of `df` and from those made before them, in one pass over each key's history; all columns stay but those named in `drop`.

    A task holds one key's history, as a price history fits it."""
    inputs = [c for c, t in df.dtypes if t == "double" and c not in (key, order)]
    kinds = dict(df.dtypes)
    carried = [c for c in df.columns if c not in (key, order, *inputs)]
    kept = [c for c in (*inputs, *specs) if c not in drop]

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        have = {}
        for c in inputs:
            x = t.column(c)
            have[c] = Series(x.to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False))
        for c, made in specs.items():
            have[c] = made(have)
        return pa.table({**{c: t.column(c) for c in (key, order, *carried)}, **{c: pa.array(have[c].v, pa.float64(), mask=~have[c].there) for c in kept}})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, order, *carried)), *(f"`{c}` double" for c in kept)])
    return df.select(key, order, *carried, *inputs).groupBy(key).applyInArrow(one, schema)

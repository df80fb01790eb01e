"""One pass over each key's rows in order, for results that depend on the path: a state per key, no group in memory."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Row = tuple[Any, ...]


def walk(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], Any], step: Callable[[Any, Row], Iterable[Row]], schema: str, end: Callable[[Any], Iterable[Row]] | None = None
) -> DataFrame:
    """`step(state, (order values, column values))` for each row of a key in order, and `end(state)` after its last; both give rows without the key, which is put before them.

    Rows are shuffled by key and sorted within their task, and flow through in
    Arrow batches, so a task holds one batch and one key's state, however long
    the key's history is. `schema` names the key's columns first."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:n] != key:
                    if key is not None and end:
                        out.extend(key + r for r in end(state))
                    key, state = row[:n], start()
                out.extend(key + r for r in step(state, row[n:]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                out = []
        if key is not None and end and (out := [key + r for r in end(state)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    rows = df.select(*keys, *order, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)


class SortedWindow:
    """The last `size` values in order of arrival and of size; a null takes a place but has no rank."""

    def __init__(self, size: int):
        self.size = size
        self.arrived: deque[float | None] = deque()
        self.ordered: list[float] = []

    def push(self, x: float | None) -> None:
        if x is not None and x != x:
            x = None
        self.arrived.append(x)
        if x is not None:
            insort(self.ordered, x)
        if len(self.arrived) > self.size:
            old = self.arrived.popleft()
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]

    def hazen(self) -> float | None:
        """(average rank - 0.5) / n of the newest value that is there, null in an empty window."""
        last = next((x for x in reversed(self.arrived) if x is not None), None)
        if last is None:
            return None
        below, upto = bisect_left(self.ordered, last), bisect_right(self.ordered, last)
        return ((below + 1 + upto) / 2 - 0.5) / len(self.ordered)


def hazen_percentiles(df: DataFrame, x: list[str], size: int, least: int, key: str = "id", order: str = "date", inverted: tuple[str, ...] = ()) -> DataFrame:
    """Per row: for each column its Hazen percentile among the last `size` rows of the key (of the last value there is), null below `least` values, and the number of values.

    Columns named in `inverted` give 1 - percentile. A window is kept in order
    and moved by one value a row, so a row costs a search and a shift, and a key
    needs `size` values of memory."""

    def step(windows: list[SortedWindow], row: Row) -> list[Row]:
        out: list[Any] = [row[0]]
        for name, w, v in zip(x, windows, row[1:], strict=True):
            w.push(v)
            p = w.hazen() if len(w.ordered) >= least else None
            out += [1 - p if p is not None and name in inverted else p, len(w.ordered)]
        return [tuple(out)]

    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, " + ", ".join(f"{c}_percentile double, {c}_n long" for c in x)
    return walk(df, [key], [order], x, lambda: [SortedWindow(size) for _ in x], step, schema)

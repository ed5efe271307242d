"""Operators whose next value depends on the last one. A series is sorted within its task and read in Arrow batches; only
the state is carried from row to row and from batch to batch, so a series need not fit in memory."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], kept: list[str], made: StructType, step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """For each series (keys; none: the whole table is one, in one task), in order: state, output = step(state, *inputs),
    with state None at the start. Rows have the kept columns and the output's (made)."""
    schema = StructType([*(df.schema[c] for c in kept), *made])
    types = [f.type for f in to_arrow_schema(made)]
    width, n = len(keys), len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, series = None, None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(k).to_pylist() for k in range(width + n)]
            names = list(zip(*columns[:width], strict=True)) if width else [()] * len(batch)
            out = []
            for name, *values in zip(names, *columns[width:], strict=True):
                if name != series:
                    state, series = None, name
                state, row = step(state, *values)
                out.append(row)
            arrays = [pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(width + n + k) for k in range(len(kept))), *arrays], schema.names)

    dealt = df.repartition(*keys) if keys else df.coalesce(1)
    read = dealt.sortWithinPartitions(*keys, *order).select(*[F.col(c).alias(f"c{k}") for k, c in enumerate([*keys, *inputs, *kept])])
    return read.mapInArrow(run, schema)


def low_pass_step(tau: float) -> Callable[..., tuple[Any, tuple]]:
    """First-order low-pass over (time, value); one output."""
    import math

    def step(state, t, x):
        y = x if state is None else state[1] + (x - state[1]) * -math.expm1(-(t - state[0]) / tau)
        return (t, y), (y,)

    return step


def window_remove_step(most: float) -> Callable[..., tuple[Any, tuple]]:
    """movingWindowRemove with a sum that is kept as the window moves: the size of the window whose sum is `most` or less,
    one item at least."""

    def step(state, x):
        window, total = state if state is not None else (deque(), 0)
        window.append(x)
        total += x
        while len(window) > 1 and total > most:
            total -= window.popleft()
        return (window, total), (len(window),)

    return step


def iir(rows: list, initial: Callable, follow: Callable) -> list:
    """Recursive filter: initial(item) first, then follow(item, last)."""
    out: list = []
    for item in rows:
        out.append(follow(item, out[-1]) if out else initial(item))
    return out


def iir_combine(rows: list, initial: Callable, follow: Callable) -> list:
    """As iir, with follow(previous item, item, last)."""
    out: list = []
    for k, item in enumerate(rows):
        out.append(follow(rows[k - 1], item, out[-1]) if k else initial(item))
    return out


def low_pass(name: str, time: Callable, value: Callable, tau: float) -> tuple[Callable, Callable]:
    """initial and follow of a first-order low-pass; the row gets a field of this name."""
    import math

    def initial(item: dict) -> dict:
        return item | {name: value(item)}

    def follow(before: dict, item: dict, last: dict) -> dict:
        a = math.exp(-(time(item) - time(before)) / tau)
        return item | {name: last[name] * a + value(item) * (1 - a)}

    return initial, follow


def fsm(rows: list, step: Callable) -> list[dict]:
    """State after every item; the state begins as {state: 0}."""
    state, out = {"state": 0}, []
    for item in rows:
        state = step(state, item)
        out.append(state)
    return out


def visit(rows: list, start, step: Callable):
    for item in rows:
        start = step(start, item)
    return start


def compact(rows: list, equal: Callable) -> list:
    """Drops items equal to the last one that stayed."""
    out: list = []
    for item in rows:
        if not out or not equal(out[-1], item):
            out.append(item)
    return out


def moving_window(rows: list, value: Callable) -> list[list]:
    """For each item, those from the first on whose value differs by 1 at most."""
    begin, out = 0, []
    for k, item in enumerate(rows):
        while abs(value(item) - value(rows[begin])) > 1:
            begin += 1
        out.append(rows[begin : k + 1])
    return out


def moving_window_remove(rows: list, too_large: Callable) -> list[list]:
    window, out = [], []
    for item in rows:
        window = [*window, item]
        while len(window) > 1 and too_large(window):
            window = window[1:]
        out.append(window)
    return out


def merge(left: list, right: list, first: Callable) -> list:
    """Two-pointer merge: the left item is taken where first(left, right) is true."""
    out, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if first(left[i], right[j]):
            out.append(left[i])
            i += 1
        else:
            out.append(right[j])
            j += 1
    return out + left[i:] + right[j:]


def bisection(f: Callable[[float], float], low: float, high: float, eps: float = 1e-10, rounds: int = 1000) -> float:
    a, b = f(low), f(high)
    if a == 0 or b == 0:
        return low if a == 0 else high
    if (a < 0) == (b < 0):
        raise ValueError("the function has the same sign at both ends")
    for _ in range(rounds):
        mid = (low + high) / 2
        m = f(mid)
        if m == 0 or high - low < eps:
            return mid
        if (m < 0) == (a < 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2

"""Recursive operators on streams: the steps of ordered scans, with the state of each series kept between micro-batches.

A step is the same as for a table, (state, *values) -> (state, row), so a stream gives the rows that a table gives. Within a
micro-batch a series is sorted; over micro-batches it must arrive in its order, as for any operator that looks back."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def stream_scan(stream: DataFrame, keys: list[str], order: list[str], inputs: list[str], kept: list[str], made: StructType, step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """As sequential.ordered_scan, on a stream (append mode)."""
    schema = StructType([*(stream.schema[c] for c in kept), *made])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for values in zip(*(rows[c].tolist() for c in inputs), strict=True):
            held, row = step(held, *values)
            out.append(row)
        state.update((pickle.dumps(held),))
        found = pd.DataFrame(out, columns=made.names, index=rows.index)
        yield pd.concat([rows[kept], found], axis=1)[schema.names]

    return stream.select(*dict.fromkeys([*keys, *order, *inputs, *kept])).groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def compact_step() -> Callable[..., tuple[Any, tuple]]:
    """compact: whether an item differs from the one before; the caller filters by it."""

    def step(state, x):
        return (x,), (state is None or state[0] != x,)

    return step


def fold_step(start: Any, f: Callable[[Any, Any], Any]) -> Callable[..., tuple[Any, tuple]]:
    """visit and mapReduce: the fold so far after each item; the last row of a series has its result."""

    def step(state, x):
        state = f(start if state is None else state[0], x)
        return (state,), (state,)

    return step


def machine_step(f: Callable[[int, Any], int]) -> Callable[..., tuple[Any, tuple]]:
    """fsm with numbers as states, beginning with 0."""

    def step(state, x):
        state = f(0 if state is None else state, x)
        return state, (state,)

    return step


def value_window_step(width: float = 1) -> Callable[..., tuple[Any, tuple]]:
    """movingWindow over (value, weight): number and sum of the items up to this one whose value differs by `width` at most.
    The state is the window."""

    def step(state, v, weight):
        window = [x for x in (state or []) if abs(v - x[0]) <= width] + [(v, weight)]
        return window, (len(window), float(sum(x[1] for x in window)))

    return step


def run_to_table(stream: DataFrame) -> DataFrame:
    """Runs a stream in append mode over what there is into Parquet files of the shared folder, and reads them."""
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "fluentlake-streams")
    path = f"{base.rstrip('/')}/stream/{uuid.uuid4().hex}"
    writing = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append")
    writing.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def histogram(stream: DataFrame, bin_of: Any, value: Any) -> DataFrame:
    """binning on a stream (complete mode): sums by bin; bins without rows are added where the result is read."""
    return stream.groupBy(bin_of.alias("bin")).agg(F.sum(value).alias("value"))

"""What several operators need: scratch tables in the shared folder, and words of a block of texts in numpy.

Texts travel to Python as UTF-8 bytes. Splitting bytes at ASCII white space gives the words ``[^\\x20\\x09-\\x0D]+``
of the text, as no byte of a longer UTF-8 sequence is below 0x80; ``bytes.lower`` lower-cases A-Z alone.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.cast("string").cast("binary"), F.expr("X''"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n, F.lit(0))


_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Only where the session names none and runs
    in one process, as in tests, a folder of our own is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = os.path.dirname(held) if held else os.path.join(tempfile.gettempdir(), "fluentlake-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(path := f"{base.rstrip('/')}/scratch/{uuid.uuid4().hex}/{name}")
    return path


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of the shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def made() -> int:
    """How many scratch tables there are; see delete_since."""
    return len(_made)


def delete_since(spark: SparkSession, mark: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the scratch tables made after `mark`, but those of keep: for steps whose result is stored."""
    gone = [p for p in _made[mark:] if p not in keep]
    _made[mark:] = [p for p in _made[mark:] if p in keep]
    delete(spark, gone)


def delete_between(spark: SparkSession, begin: int, end: int) -> None:
    """Deletes the scratch tables made between two marks; see made. Later marks move down."""
    gone = _made[begin:end]
    del _made[begin:end]
    delete(spark, gone)


@contextlib.contextmanager
def rows_at_once(spark: SparkSession, most: int | None) -> Iterator[None]:
    """Plans that run within it send a Python worker so many rows at once, at most."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        if most:
            spark.conf.set(setting, min(most, int(before)) if int(before) > 0 else most)
        yield
    finally:
        spark.conf.set(setting, before)


def stored(df: DataFrame, name: str, compression: str = "snappy", batch: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage so that it survives lost executors. batch: rows
    that go to a Python worker at once, where rows are long."""
    spark = df.sparkSession
    schema = df.schema
    path = scratch(spark, name)
    with rows_at_once(spark, batch):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(schema).parquet(path)


#: Groups that are joined by broadcast at most; a table of so many short rows is some MB.
HOT_GROUPS = 100_000
#: Rows of a group that may meet in one task however small the input.
FEW_ROWS = 100


def hot_groups(size: str, total: int) -> Column:
    """Whether a group of this size, of `total` rows, is large. Fewer than HOT_GROUPS groups are."""
    return F.col(size) > max(FEW_ROWS, total // HOT_GROUPS)


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with groups (one row per value of `on`, `size` of the rows have it, of `total` rows) in which no
    task gets a large group: large groups are broadcast, and the rows of the others are shuffled. Both inputs are read twice, so they should be stored. Nulls in `on` match nothing."""
    hot = hot_groups(size, total)
    large = F.broadcast(groups.where(hot))
    rest = rows.join(large.select(*on), on, "left_anti")
    return rows.join(large, on).unionByName(rest.join(groups.where(~hot), on))


def give_back() -> None:
    """Returns memory that is free to the system: a Python worker lives on beside the JVM and the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


_tables: list = []


def worker_tables(most: int) -> Callable:
    """As lru_cache, for large tables that a Python worker keeps for its next task: they go when the worker, which later stages
    use too, turns to another operator's texts (text_blocks)."""

    def held(build: Callable) -> Callable:
        _tables.append(found := lru_cache(maxsize=most)(build))
        return found

    return held


def drop_tables() -> None:
    """Lets go the tables of worker_tables, if there are any."""
    if any(x.cache_info().currsize for x in _tables):
        for x in _tables:
            x.cache_clear()
        gc.collect()
        give_back()


# --- numpy over blocks of texts -------------------------------------------------------------------------------

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 21) -> np.ndarray:
    """64-bit rolling hashes of spans of bytes, ascending and disjoint: prefix sums of byte codes times powers, modulo
    2**64, brought to position 0. Works in chunks of whole spans, so memory is bounded by the longest span."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        m = max(k + 1, int(np.searchsorted(ends, base + chunk, "right")))
        part = data[base : int(ends[m - 1])]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:-1], out=sums[1:])
        s, e = starts[k:m] - base, ends[k:m] - base
        out[k:m] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = m
    return out


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie one after the other in data, and for each text the first word
    (one more entry than texts). bounds: where texts begin, and the end."""
    n = len(data)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | first[:-1]))
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def text_blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch whose texts have about `most` bytes (a longer text alone): rows, bytes, bounds. Tables that
    another operator left in the worker go."""
    drop_tables()
    col = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) else pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    k = 0
    while k < len(col):
        m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        yield slice(k, m), data[offsets[k] : offsets[m]], np.asarray(offsets[k : m + 1] - offsets[k])
        k = m

"""An ordered list of records: a DataFrame with the columns that give its order.

Operators are narrow or use aggregates, windows and joins, so Catalyst plans them. Order-sensitive ones need an order; a
global position costs a sort by ranges, a position in a series (`by`) a window.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction


class Record:
    """Fields of a row, by attribute."""

    def __init__(self, df: DataFrame, prefix: str = ""):
        self._df, self._prefix = df, prefix

    def __getattr__(self, name: str) -> Column:
        if self._prefix + name not in self._df.columns:
            raise KeyError(f"no field {name!r}; there are {', '.join(self._df.columns)}")
        return F.col(self._prefix + name)

    __getitem__ = __getattr__


class Table:
    def __init__(self, df: DataFrame, order: tuple[str, ...] = (), by: tuple[str, ...] = ()):
        self.df, self.order, self.by = df, tuple(order), tuple(by)

    # sources
    @classmethod
    def numbers(cls, spark: SparkSession, n: int) -> Table:
        return cls(spark.range(max(n, 0)).withColumnRenamed("id", "value"), ("value",))

    @classmethod
    def of(cls, spark: SparkSession, rows: list, schema: str | None = None) -> Table:
        names = schema or None
        df = spark.createDataFrame(rows, names)
        return cls(df.withColumn("_pos", F.monotonically_increasing_id()), ("_pos",))

    def _window(self, reverse: bool = False):
        if not self.order:
            raise ValueError("this operator needs an order")
        keys = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.by).orderBy(*keys)

    def _key(self) -> Column:
        if not self.order:
            raise ValueError("this operator needs an order")
        return F.struct(*self.order)

    def _with(self, df: DataFrame, order: tuple[str, ...] | None = None) -> Table:
        return Table(df, self.order if order is None else order, self.by)

    # projection and filter
    def accept(self, test: Callable[[Record], Column]) -> Table:
        return self._with(self.df.filter(test(Record(self.df))))

    def map(self, make: Callable[[Record], dict[str, Column]], order: tuple[str, ...] | None = None) -> Table:
        made = make(Record(self.df))
        return Table(self.df.select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in made.items()]), tuple(c for c in (order or self.order) if c in made), tuple(c for c in self.by if c in made))

    def number(self, name: str = "n") -> Table:
        """Positions from 0. Over the whole table: rows are dealt by ranges of the order, and each range begins after the
        number of rows in those before it, which Spark counts over the same shuffle files. Rows that the order leaves equal
        are told apart by where they are in the input, so that they don't all land in one task."""
        window = self._window()
        if self.by:
            return self._with(self.df.withColumn(name, (F.row_number().over(window) - 1).cast("bigint")))
        dealt = self.df.orderBy(*self._sorting(), F.monotonically_increasing_id())
        return self._with(dealt.withColumn(name, InternalFunction.distributed_sequence_id()))

    def replace_list(self, f: Callable[[Table], Table]) -> Table:
        return f(self)

    def set(self, position: int, **values) -> Table:
        """Replaces fields of the item at a position."""
        numbered = self.number("_at").df
        for k, v in values.items():
            numbered = numbered.withColumn(k, F.when(F.col("_at") == position, v).otherwise(F.col(k)))
        return self._with(numbered.drop("_at"))

    # order
    def sort(self, key: Callable[[Record], Column], reverse: bool = False, name: str = "_key") -> Table:
        """order / orderRev: by key, ties in the old order. The key becomes part of the order; a column is added for it."""
        df = self.df.withColumn(name, key(Record(self.df)))
        return Sorted(df, name, reverse, self.order, self.by)

    def reverse(self) -> Table:
        return Sorted(self.df, None, True, self.order, self.by)

    def top(self, n: int) -> Table:
        return self._with(self.df.orderBy(*self._sorting()).limit(n)) if not self.by else self._ranked(lambda r: r <= n)

    def skip(self, n: int) -> Table:
        return self._with(self.df.orderBy(*self._sorting()).offset(n)) if not self.by else self._ranked(lambda r: r > n)

    def _sorting(self) -> list[Column]:
        return [F.col(c).asc() for c in self.order]

    def _ranked(self, test) -> Table:
        ranked = self.df.withColumn("_rank", F.row_number().over(self._window()))
        return self._with(ranked.where(test(F.col("_rank"))).drop("_rank"))

    # elements
    def first(self) -> DataFrame:
        return self._element(F.min_by)

    def last(self) -> DataFrame:
        return self._element(F.max_by)

    def _element(self, pick) -> DataFrame:
        rows = self.df.groupBy(*self.by).agg(F.count("*").alias("_n"), pick(F.struct(*self.df.columns), self._key()).alias("r"))
        if not self.by:
            rows = rows.where(F.when(F.col("_n") == 0, F.raise_error(F.lit("the list is empty"))).otherwise(True))
        return rows.select("r.*")

    def single(self) -> DataFrame:
        rows = self.df.agg(F.count("*").alias("_n"), F.first(F.struct(*self.df.columns)).alias("r"))
        bad = F.when(F.col("_n") == 0, F.raise_error(F.lit("the list is empty"))).when(F.col("_n") > 1, F.raise_error(F.lit("the list has more than one item")))
        return rows.where(bad.otherwise(True)).select("r.*")

    def size(self, name: str = "size") -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.count("*").alias(name))

    def present(self, test, name: str = "present") -> DataFrame:
        return self.df.groupBy(*self.by).agg(F.coalesce(F.bool_or(test(Record(self.df))), F.lit(False)).alias(name))

    def index_where(self, test, name: str = "index") -> DataFrame:
        numbered = self.number("_at").df
        return numbered.groupBy(*self.by).agg(F.coalesce(F.min(F.when(test(Record(numbered)), F.col("_at"))), F.lit(-1).cast("bigint")).alias(name))

    # aggregates; an empty list is an error where the whole table is one list
    def aggregate(self, **columns: Column) -> DataFrame:
        rows = self.df.groupBy(*self.by).agg(F.count("*").alias("_n"), *[c.alias(k) for k, c in columns.items()])
        if not self.by:
            rows = rows.where(F.when(F.col("_n") == 0, F.raise_error(F.lit("the list is empty"))).otherwise(True))
        return rows.drop("_n")

    def min_max(self, value, item: Callable[[Record], Column]) -> DataFrame:
        """min, max, minItem, maxItem, valid; the first item wins ties."""
        r = Record(self.df)
        v, at = value(r), [F.col(c) for c in self.order]
        found = self.df.groupBy(*self.by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(item(r), F.struct(v, *at)).alias("minItem"), F.min_by(item(r), F.struct(-v, *at)).alias("maxItem"), (F.count("*") > 0).alias("valid"))
        return found.na.fill(0, ["min", "max"])

    def reduce_text(self, text, sep: str, name: str = "text") -> DataFrame:
        """Ordered concatenation; the order travels in the collected structs."""
        r = Record(self.df)
        items = F.array_sort(F.collect_list(F.struct(*self.order, text(r).alias("_text"))))
        return self.df.groupBy(*self.by).agg(F.array_join(F.transform(items, lambda x: x["_text"]), sep).alias(name))

    def fold(self, start: Column, step, value, name: str = "result") -> DataFrame:
        """mapReduce / visit over the ordered values of each series; a general fold needs the series in one row."""
        r = Record(self.df)
        items = F.array_sort(F.collect_list(F.struct(*self.order, value(r).alias("_value"))))
        return self.df.groupBy(*self.by).agg(F.aggregate(items, start, lambda a, x: step(a, x["_value"])).alias(name))

    def linear_regression(self, x, y) -> DataFrame:
        r = Record(self.df)
        return self.df.groupBy(*self.by).agg(F.coalesce(F.regr_slope(y(r), x(r)), F.lit(float("nan"))).alias("a"), F.coalesce(F.regr_intercept(y(r), x(r)), F.lit(float("nan"))).alias("b"))

    def multi_use(self, **uses: Callable[[Record], Column]) -> DataFrame:
        """One pass for several aggregates of the same list."""
        r = Record(self.df)
        return self.df.groupBy(*self.by).agg(*[f(r).alias(k) for k, f in uses.items()])

    # groups
    def group(self, key, first_seen: bool = False, **aggregates: Callable[[Record], Column]) -> Table:
        """groupByString / groupByInt / groupByEqual followed by aggregates of the groups: a single groupBy().agg(). With
        first_seen, groups are ordered by their first item."""
        r = Record(self.df)
        made = [f(r).alias(k) for k, f in aggregates.items()]
        if first_seen:
            made.append(F.min(self._key()).alias("_first"))
        out = self.df.groupBy(key(r).alias("key")).agg(*(made or [F.count("*").alias("size")]))
        return Table(out, ("_first",) if first_seen else ("key",))

    def group_values(self, key, *fields: str) -> Table:
        """Groups with their items, in order."""
        items = F.array_sort(F.collect_list(F.struct(*self.order, *[f for f in fields if f not in self.order])))
        return Table(self.df.groupBy(key(Record(self.df)).alias("key")).agg(items.alias("values")), ("key",))

    def unique(self, key, name: str = "key") -> Table:
        return Table(self.df.select(key(Record(self.df)).alias(name)).distinct(), (name,))

    # neighbours
    def combine(self, n: int, make: Callable[..., dict[str, Column]]) -> Table:
        """combine, combine3, combineN: windows of n neighbours; make gets a function (field, k) -> column."""
        w = self._window()
        made = make(lambda field, k=0: F.lead(field, k).over(w) if k else F.col(field))
        last = F.lead(F.lit(1), n - 1).over(w) if n > 1 else F.lit(1)
        places = {c: f"_at_{c}" if c in made else c for c in self.order}  # a made column may have an order column's name
        kept = [F.col(c) for c in self.by if c not in self.order] + [F.col(c).alias(k) for c, k in places.items()]
        df = self.df.select(*kept, *[c.alias(k) for k, c in made.items()], last.alias("_full"))
        return self._with(df.where("_full is not null").drop("_full"), tuple(places.values()))

    def scan(self, how: str, value, name: str) -> Table:
        """iir with +, max or min: a running aggregate."""
        f = {"+": F.sum, "max": F.max, "min": F.min}[how]
        return self._with(self.df.withColumn(name, f(value(Record(self.df))).over(self._window().rowsBetween(Window.unboundedPreceding, 0))))

    def compact(self, key) -> Table:
        """Drops items equal to the one before (an equivalence, so the one before is as good as the last that stayed)."""
        k = key(Record(self.df))
        df = self.df.withColumn("_same", k.eqNullSafe(F.lag(k).over(self._window())) & F.lag(F.lit(True), 1, False).over(self._window()))
        return self._with(df.where(~F.col("_same")).drop("_same"))

    def moving_window(self, value, on: tuple[str, ...], **aggregates: Callable[[Record], Column]) -> DataFrame:
        """movingWindow over an ascending value: items up to this one whose value is less by 1 at most. Unit buckets of the
        value make the join an equi-join of neighbours: no cross product within a series."""
        r = Record(self.df)
        base = self.df.withColumn("_v", value(r).cast("double")).withColumn("_u", F.floor("_v")).withColumn("_k", F.struct(*self.order))
        left = base.select(*[F.col(c).alias(f"l_{c}") for c in base.columns], F.explode(F.array(F.col("_u"), F.col("_u") - 1)).alias("_b"))
        pairs = left.join(base, [*[left[f"l_{b}"] == base[b] for b in self.by], left["_b"] == base["_u"]])
        pairs = pairs.where((F.abs(F.col("l__v") - F.col("_v")) <= 1) & (F.col("_k") <= F.col("l__k")))
        keys = [F.col(f"l_{c}").alias(c) for c in on]
        return pairs.groupBy(*keys).agg(*[f(Record(base)).alias(k) for k, f in aggregates.items()])

    # joins and sets
    def cross(self, other: Table, make: Callable[[Record, Record], dict[str, Column]], test=None) -> DataFrame:
        """cross, with the accept that follows it: an equality in the test becomes a hash join."""
        a, b = self.df.select(*[F.col(c).alias(f"a_{c}") for c in self.df.columns]), other.df.select(*[F.col(c).alias(f"b_{c}") for c in other.df.columns])
        ra, rb = Record(a, "a_"), Record(b, "b_")
        joined = a.join(b, test(ra, rb)) if test is not None else a.crossJoin(b)
        return joined.select(*[c.alias(k) for k, c in make(ra, rb).items()])

    def accept_present(self, other: Table, test: Callable[[Record, Record], Column], negate: bool = False) -> Table:
        """accept(x -> other.present(y -> ...)) and its negation: semi and anti joins."""
        renamed = other.df.select(*[F.col(c).alias(f"_other_{c}") for c in other.df.columns])
        return self._with(self.df.join(renamed, test(Record(self.df), Record(renamed, "_other_")), "left_anti" if negate else "left_semi"))

    def lookup(self, other: Table, on: Callable[[Record, Record], Column], keys: tuple[str, ...], **aggregates) -> DataFrame:
        """map(x -> other.accept(y -> ...)) with aggregates of the matches: a left join and one groupBy."""
        renamed = other.df.select(*[F.col(c).alias(f"_other_{c}") for c in other.df.columns], F.lit(1).alias("_other__hit"))
        joined = self.df.join(renamed, on(Record(self.df), Record(renamed, "_other_")), "left")
        return joined.groupBy(*keys).agg(*[f(Record(renamed, "_other_")).alias(k) for k, f in aggregates.items()])

    def append_list(self, other: Table) -> Table:
        """list + list."""
        both = self.df.withColumn("_src", F.lit(0)).unionByName(other.df.withColumn("_src", F.lit(1)))
        return self._with(both, ("_src", *self.order))

    def merge(self, other: Table, key: str) -> Table:
        """Merge of sorted lists; on a tie the other list's item comes first."""
        both = self.df.withColumn("_src", F.lit(1)).unionByName(other.df.withColumn("_src", F.lit(0)))
        return self._with(both, tuple(dict.fromkeys((key, "_src", *self.order))))

    # histograms
    def binning(self, start: float, size: float, count: int, index, value, name: str = "value") -> DataFrame:
        """count + 2 bins, all present: below, count of them, above."""
        r = Record(self.df)
        sums = self.df.select(bin_of(index(r), start, size, count).alias("bin"), value(r).alias("_v")).groupBy("bin").agg(F.sum("_v").alias("_s"))
        every = self.df.sparkSession.range(count + 2).withColumnRenamed("id", "bin")
        return every.join(F.broadcast(sums), "bin", "left").select("bin", bin_label(F.col("bin"), start, size, count).alias("descr"), F.coalesce("_s", F.lit(0.0)).alias(name))

    def binning2d(self, x, y, index_x, index_y, value, name: str = "value") -> DataFrame:
        """x, y: (start, size, count)."""
        r, spark = Record(self.df), self.df.sparkSession
        sums = self.df.select(bin_of(index_x(r), *x).alias("x"), bin_of(index_y(r), *y).alias("y"), value(r).alias("_v")).groupBy("x", "y").agg(F.sum("_v").alias("_s"))
        grid = spark.range((x[2] + 2) * (y[2] + 2)).select(F.expr(f"id div {y[2] + 2}").alias("x"), (F.col("id") % (y[2] + 2)).alias("y"))
        return grid.join(F.broadcast(sums), ["x", "y"], "left").select("x", "y", F.coalesce("_s", F.lit(0.0)).alias(name))


def collect_binning(*histograms: DataFrame) -> DataFrame:
    """Sums histograms element by element."""
    both = reduce(DataFrame.unionByName, histograms)
    if any(h.columns != histograms[0].columns for h in histograms):
        raise ValueError("histograms of different kinds cannot be summed")
    keys = [c for c in both.columns if c in ("bin", "descr", "x", "y")]
    return both.groupBy(*keys).agg(F.sum("value").alias("value"))


class Sorted(Table):
    """A table whose first order column is descending, or whose order is reversed."""

    def __init__(self, df, key, reverse, order, by):
        super().__init__(df, ((key, *order) if key else order), by)
        self.key, self.reversed = key, reverse

    def _sorting(self) -> list[Column]:
        return [F.col(c).desc() if self.reversed and (c == self.key or self.key is None) else F.col(c).asc() for c in self.order]

    def _window(self, reverse: bool = False):
        return Window.partitionBy(*self.by).orderBy(*self._sorting())

    def _with(self, df, order=None) -> Table:
        out = Sorted(df, self.key, self.reversed, self.order, self.by)
        out.order = self.order if order is None else order
        return out


def bin_of(v: Column, start: float, size: float, count: int) -> Column:
    return F.least(F.greatest(F.floor((v - start) / size) + 1, F.lit(0)), F.lit(count + 1)).cast("bigint")


def bin_digits(size: float) -> int:
    """Digits that show a bin's width: one for a width from 0.1 to 10, more for smaller, none for larger ones."""
    if size == 0 or abs(size) >= 10:
        return 0
    return max(1, math.ceil(-math.log10(abs(size)) - 0.000001))


def bin_label(b: Column, start: float, size: float, count: int) -> Column:
    """<0, 0-10, >10; bounds that are whole numbers have no digits."""
    text = lambda digits, v: F.format_string(f"%.{digits}f", v)
    low, high = (F.when(b == 0, F.lit(0.0)).otherwise(F.lit(float(start)) + (b - 1) * F.lit(float(size))), F.when(b == count + 1, F.lit(0.0)).otherwise(F.lit(float(start)) + b * F.lit(float(size))))
    whole = (low == F.round(low)) & (high == F.round(high))
    shown = lambda v: F.when(whole, text(0, v)).otherwise(text(bin_digits(size), v))
    return F.when(b == 0, F.concat(F.lit("<"), shown(high))).when(b == count + 1, F.concat(F.lit(">"), shown(low))).otherwise(F.concat(shown(low), F.lit("-"), shown(high)))


class Interpolation:
    """Linear between knots, clamped outside. Knots are a model on the driver: at most MOST, x strictly ascending. On columns
    the segment is found by a binary search of a constant array, in the row: no join."""

    MOST = 100_000

    def __init__(self, knots: list[tuple[float, float]]):
        if not knots or len(knots) > self.MOST or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
            raise ValueError(f"interpolation needs 1 to {self.MOST} knots with strictly increasing x")
        self.x, self.y = ([float(k[c]) for k in knots] for c in (0, 1))
        self.arity = 1

    @classmethod
    def of(cls, knots: DataFrame) -> Interpolation:
        return cls([(r[0], r[1]) for r in knots.orderBy(knots.columns[0]).limit(cls.MOST + 1).collect()])

    def __call__(self, v, context=None):
        if not isinstance(v, Column):
            k = min(max(bisect_right(self.x, v) - 1, 0), max(len(self.x) - 2, 0))
            if v <= self.x[0] or len(self.x) == 1:
                return self.y[0]
            return self.y[-1] if v >= self.x[-1] else self.y[k] + (v - self.x[k]) * (self.y[k + 1] - self.y[k]) / (self.x[k + 1] - self.x[k])
        v, n = v.cast("double"), len(self.x)
        slopes = [(self.y[k + 1] - self.y[k]) / (self.x[k + 1] - self.x[k]) for k in range(n - 1)] or [0.0]
        constant = lambda values: F.from_json(F.lit(json.dumps(values)), "array<double>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
        k = F.aggregate(steps, F.lit(-1), lambda at, step: F.when(F.get(constant(self.x), at + step) <= v, at + step).otherwise(at))
        found = F.transform(F.array(k), lambda k: F.get(constant(self.y), k) + (v - F.get(constant(self.x), k)) * F.get(constant(slopes), k))[0]
        return F.when(v < self.x[0], F.lit(self.y[0])).when(v >= self.x[-1], F.lit(self.y[-1])).otherwise(found)


def interpolate(probes: Table, knots: Table, x: str, kx: str, ky: str, out: str = "y") -> DataFrame:
    """createInterpolation over a column."""
    return probes.df.withColumn(out, Interpolation.of(knots.df.select(kx, ky))(F.col(x)))

"""Host objects as lists of records: by declared attributes, by their types, or by a function of the key."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable, Iterator
from typing import Any, get_type_hints

from pyspark.sql import SparkSession
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from fluentlake.operators.table import Table

_TYPES: dict[type, DataType] = {bool: BooleanType(), int: LongType(), float: DoubleType(), str: StringType()}


class Attributes:
    """Attributes of a host type, declared one by one: attr(name, function, type)."""

    def __init__(self, attributes: tuple[tuple[str, Callable[[Any], Any], type], ...] = ()):
        self.attributes = attributes

    def attr(self, name: str, of: Callable[[Any], Any], kind: type = str) -> Attributes:
        return Attributes((*self.attributes, (name, of, kind)))

    @classmethod
    def reflected(cls, host: type) -> Attributes:
        """The fields of a dataclass that are bool, int, float or str; others are left out."""
        hints = get_type_hints(host)
        named = [f.name for f in dataclasses.fields(host) if hints[f.name] in _TYPES]
        return cls(tuple((n, lambda item, n=n: getattr(item, n), hints[n]) for n in named))

    def record(self, item: Any) -> dict[str, Any]:
        """A constant of the language."""
        return {name: of(item) for name, of, _ in self.attributes}

    def table(self, spark: SparkSession, items: Iterable[Any]) -> Table:
        """A list of host objects on the driver as a table, in their order. A converter that fails names its attribute."""
        rows = []
        for k, item in enumerate(items):
            row = [k]
            for name, of, kind in self.attributes:
                try:
                    value = of(item)
                    row.append(None if value is None else kind(value))
                except Exception as error:
                    raise ValueError(f"item {k}, attribute {name}: {error}") from error
            rows.append(tuple(row))
        schema = StructType([StructField("_pos", LongType()), *(StructField(n, _TYPES[kind]) for n, _, kind in self.attributes)])
        return Table(spark.createDataFrame(rows, schema), ("_pos",))


class FunctionMap(dict):
    """A map whose values a function of the key gives, for a fixed list of keys; keys for which it raises KeyError are left out
    when the map is gone through."""

    def __init__(self, of: Callable[[str], Any], *keys: str):
        super().__init__()
        self._of, self._keys = of, keys

    def _get(self, key: str) -> tuple[bool, Any]:
        try:
            return (True, self._of(key)) if key in self._keys else (False, None)
        except KeyError:
            return False, None

    def __contains__(self, key: object) -> bool:
        return self._get(str(key))[0]

    def __getitem__(self, key: str) -> Any:
        there, value = self._get(key)
        if not there:
            raise KeyError(key)
        return value

    def get(self, key: str, default: Any = None) -> Any:
        return self[key] if key in self else default

    def __iter__(self) -> Iterator[str]:
        return (k for k in self._keys if k in self)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def keys(self):
        return dict.fromkeys(self).keys()

    def items(self):
        return {k: self[k] for k in self}.items()

    def values(self):
        return {k: self[k] for k in self}.values()


class SizedTable(Table):
    """A table whose number of rows the host knows: size needs no job."""

    def __init__(self, df, order: tuple[str, ...] = (), rows: int = 0):
        super().__init__(df, order)
        self.rows = rows

    def size(self, name: str = "size"):
        return self.df.sparkSession.createDataFrame([(self.rows,)], f"{name} long")

    def _with(self, df, order=None) -> Table:
        return Table(df, self.order if order is None else order, self.by)

"""Driver-side exporters of results: JSON, XML, HTML, text, CSV, DAT and zip. Tables are read row by row."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row

from fluentlake.lang.values import text_of


@dataclass(frozen=True)
class File:
    name: str
    mime: str
    data: bytes


@dataclass(frozen=True)
class Styled:
    """A value with a CSS style, of itself or of its cell, and a column span; or a link."""

    value: Any
    style: str = ""
    cell: bool = False
    span: int = 1
    link: str = ""


def plain(value: Any) -> Any:
    if isinstance(value, DataFrame):
        return (plain(r) for r in value.toLocalIterator())
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    return value


def _items(value: Any) -> list | None:
    value = plain(value)
    return list(value) if isinstance(value, list | tuple) or hasattr(value, "__next__") else None


def to_json(value: Any, stringify: bool = True) -> str:
    """Keys are sorted; with stringify, all scalars become strings."""
    value = plain(value.value if isinstance(value, Styled) else value)
    if (items := _items(value)) is not None:
        return "[" + ",".join(to_json(x, stringify) for x in items) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{to_json(k, True)}:{to_json(v, stringify)}" for k, v in sorted(value.items())) + "}"
    if not stringify and isinstance(value, bool | int | float):
        return text_of(value)
    text = "nil" if value is None else text_of(value)
    return '"' + text.replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def to_xml(value: Any) -> str:
    """Lists as <list><entry>, maps as <map>; a map of scalars has them as attributes."""
    value = plain(value.value if isinstance(value, Styled) else value)
    if (items := _items(value)) is not None:
        return "<list>" + "".join(f"<entry>{to_xml(x)}</entry>" for x in items) + "</list>"
    if isinstance(value, dict):
        pairs = sorted(value.items())
        if pairs and all(_items(v) is None and not isinstance(plain(v), dict) for _, v in pairs):
            return "<map " + " ".join(f'{k}="{html.escape(text_of(v))}"' for k, v in pairs) + "/>"
        return "<map>" + "".join(f"<entry key=\"{html.escape(str(k))}\">{to_xml(v)}</entry>" for k, v in pairs) + "</map>"
    return html.escape("nil" if value is None else text_of(value))


def to_text(value: Any, depth: int = 0) -> str:
    value, pad = plain(value.value if isinstance(value, Styled) else value), "  " * depth
    if (items := _items(value)) is not None:
        return "".join(to_text(x, depth + 1) for x in items)
    if isinstance(value, dict):
        return "".join(f"{pad}{k}:\n{to_text(v, depth + 1)}" if _items(v) is not None or isinstance(plain(v), dict) else f"{pad}{k}: {text_of(v)}\n" for k, v in sorted(value.items()))
    return f"{pad}{text_of(value)}\n"


def to_html(value: Any, most: int = 1000, custom: Callable[[Any], str | None] | None = None) -> str:
    """custom gives the HTML of a scalar, or None. A list is a numbered table, a list of lists a grid, a map a table of keys; lists end after `most` items."""
    style = ""
    if isinstance(value, Styled):
        if value.link:
            return f'<a href="{html.escape(value.link)}">{to_html(value.value, most, custom)}</a>'
        style, value = "" if value.cell else value.style, value.value
    if isinstance(value, DataFrame):
        value = value.limit(most + 1).collect()
    value = plain(value)
    if (items := _items(value)) is not None:
        rows = []
        for k, x in enumerate(items[:most], 1):
            cells = _items(x)
            rows.append("<tr>" + ("".join(_cell(c, most, custom) for c in cells) if cells is not None else f"<td>{k}.</td>{_cell(x, most, custom)}") + "</tr>")
        return f"<table{_style(style)}>" + "".join(rows) + ("<tr><td>more...</td></tr>" if len(items) > most else "") + "</table>"
    if isinstance(value, dict):
        return f"<table{_style(style)}>" + "".join(f"<tr><td>{html.escape(str(k))}:</td>{_cell(v, most, custom)}</tr>" for k, v in sorted(value.items())) + "</table>"
    if custom and (made := custom(value)) is not None:
        return made
    text = format(value, ".6g") if isinstance(value, float) else "nil" if value is None else text_of(value)
    if text.startswith(("http://", "https://")):
        return f'<a href="{html.escape(text)}" target="_blank">Link</a>'
    return f"<span{_style(style)}>{html.escape(text)}</span>" if style else html.escape(text)


def _style(style: str) -> str:
    return f' style="{html.escape(style)}"' if style else ""


def _cell(value: Any, most: int, custom: Callable[[Any], str | None] | None = None) -> str:
    cell = value if isinstance(value, Styled) else Styled(value)
    span = f' colspan="{cell.span}"' if cell.span != 1 else ""
    return f"<td{span}{_style(cell.style if cell.cell else '')}>{to_html(value, most, custom)}</td>"


@dataclass(frozen=True)
class DataFile:
    """Columns over a list, written as CSV or DAT; the first column is time."""

    time: str
    unit: str
    time_of: Callable[[Any], float]
    columns: tuple[tuple[str, str, Callable[[Any], Any]], ...] = ()
    date: bool = False
    formats: tuple[str, str] = field(default=("%Y-%m-%d", "%H:%M:%S"))

    def add(self, name: str, unit: str, value: Callable[[Any], Any]) -> DataFile:
        return replace(self, columns=(*self.columns, (name, unit, value)))

    def add_if(self, wanted: bool, name: str, unit: str, value: Callable[[Any], Any]) -> DataFile:
        return self.add(name, unit, value) if wanted else self

    def time_is_date(self) -> DataFile:
        return replace(self, date=True)

    def with_formats(self, date: str, time: str) -> DataFile:
        return replace(self, formats=(date, time))

    def _rows(self, rows: Any) -> Iterable[tuple[str, list]]:
        import datetime

        for r in plain(rows):
            t = self.time_of(r)
            when = datetime.datetime.fromtimestamp(t, datetime.UTC).strftime(" ".join(self.formats)) if self.date else text_of(float(t))
            yield when, [f(r) for _, _, f in self.columns]

    def _heads(self) -> list[str]:
        return [f"{n}[{u}]" if u else n for n, u in [(self.time, self.unit), *((n, u) for n, u, _ in self.columns)]]

    def _cells(self, values: list, missing: str, quote: str) -> list[str]:
        return [f"{quote}{text_of(float(c))}{quote}" if isinstance(c, int | float) else missing for c in values]

    def csv_lines(self, rows: Any) -> Iterator[str]:
        """Lines one after the other: rows of a table are read partition by partition. Fails at the end where a column had no
        value at all."""
        yield ",".join(f'"{h}"' for h in self._heads())
        seen = [False] * len(self.columns)
        for when, cells in self._rows(rows):
            seen = [s or isinstance(c, int | float) for s, c in zip(seen, cells, strict=True)]
            yield ",".join([f'"{when}"', *self._cells(cells, "", '"')])
        if not all(seen):
            raise ValueError("a column has no value")

    def dat_lines(self, rows: Any) -> Iterator[str]:
        yield "#" + "\t".join(self._heads())
        for when, cells in self._rows(rows):
            yield "\t".join([when, *self._cells(cells, "-", "")])

    def csv(self, name: str, rows: Any) -> File:
        return File(name, "text/csv", "".join(f"{x}\n" for x in self.csv_lines(rows)).encode())

    def dat(self, name: str, rows: Any) -> File:
        return File(name, "text/plain", "".join(f"{x}\n" for x in self.dat_lines(rows)).encode())


def zip_files(name: str, files: Iterable[File]) -> File:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for f in files:
            archive.writestr(f.name, f.data)
    return File(name, "application/zip", data.getvalue())

"""The exporters as functions and methods of the language: style, styleCell, colspan, link, dataFile, list.zip."""

from __future__ import annotations

import math
from typing import Any

from fluentlake.export.render import DataFile, File, Styled, zip_files
from fluentlake.lang.language import Language
from fluentlake.lang.values import text_of

#: A Go layout's parts and what strftime calls them.
LAYOUT = (("2006", "%Y"), ("01", "%m"), ("02", "%d"), ("15", "%H"), ("04", "%M"), ("05", "%S"), ("Jan", "%b"), ("06", "%y"))
_RAISED = str.maketrans("-0123456789", "⁻⁰¹²³⁴⁵⁶⁷⁸⁹")


def strftime_of(layout: str) -> str:
    out, k = "", 0
    while k < len(layout):
        part = next((p for p in LAYOUT if layout.startswith(p[0], k)), None)
        out += part[1] if part else layout[k].replace("%", "%%")
        k += len(part[0]) if part else 1
    return out


def formatted_float(x: float, digits: int = 6, form: str = "unicode") -> str:
    """A number with so many digits, and a power of ten where it is large or small: form is ascii, unicode, latex or mathml."""
    if math.isnan(x) or math.isinf(x) or x == 0:
        return text_of(float(x))
    mantissa, power = f"{x:.{max(digits, 1) - 1}e}".split("e")
    mantissa, n = text_of(float(mantissa)), int(power)
    if -4 <= n < digits:
        plain = f"{x:.{max(digits - 1 - n, 0)}f}"
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    match form:
        case "ascii":
            return f"{mantissa}*10^{n}"
        case "latex":
            return rf"{mantissa}\cdot 10^{{{n}}}"
        case "mathml":
            return f"<mn>{mantissa}</mn><mo>&sdot;</mo><msup><mn>10</mn><mn>{n}</mn></msup>"
    return f"{mantissa}⋅10{str(n).translate(_RAISED)}"


def css(style: Any, value: Any) -> str:
    """A style is a text, a map of properties, or a function of the value that gives either."""
    style = style(value) if callable(style) else style
    return ";".join(f"{k}:{text_of(v)}" for k, v in style.items()) if isinstance(style, dict) else str(style)


DataFile.language_type = "dataFile"
File.language_type = "file"
Styled.language_type = "styled"


def with_exports(language: Language | None = None) -> Language:
    language = language or Language()
    language.function("style", lambda style, v: Styled(v, css(style, v)), description="a value with a CSS style")
    language.function("styleCell", lambda style, v: Styled(v, css(style, v), cell=True), description="a value whose cell has a CSS style")
    language.function("colspan", lambda n, v: Styled(v, span=n), description="a value whose cell spans n columns")
    language.function("link", lambda link, v: Styled(v, link=link), description="a value that is a link")
    language.function("formatFloat", formatted_float, description="a number with so many digits: ascii, unicode, latex or mathml")
    language.function("dataFile", lambda name, unit, time: DataFile(name, unit, lambda r: float(time(r))), description="a file of columns over time")
    language.type(
        "dataFile", (), DataFile, "a file of columns over time",
        add=lambda f, name, unit, value: f.add(name, unit, value), addIf=lambda f, wanted, name, unit, value: f.add_if(wanted, name, unit, value), timeIsDate=lambda f: f.time_is_date(),
        dateFormat=lambda f, layout: f.with_formats(strftime_of(layout), f.formats[1]), timeFormat=lambda f, layout: f.with_formats(f.formats[0], strftime_of(layout)),
        csv=lambda f, name, rows: f.csv(name, _rows(rows)), dat=lambda f, name, rows: f.dat(name, _rows(rows)),
    )
    return language.type("list", (), list, zip=lambda files, name: zip_files(name, files))


def _rows(rows: Any) -> Any:
    """A table's rows in their order, one after the other."""
    return rows.df.orderBy(*rows._sorting()) if hasattr(rows, "_sorting") else rows

"""Scalar functions as JVM-side Column builders: IEEE division, strict conversions, guarded mathematics, byte-based strings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


_forgiving = False


@contextmanager
def forgiving() -> Iterator[None]:
    """Within it, columns are made that are null where they would raise an error: for try."""
    global _forgiving
    before, _forgiving = _forgiving, True
    try:
        yield
    finally:
        _forgiving = before


def error(message) -> Column:
    """An error, or null within forgiving."""
    return F.lit(None) if _forgiving else F.raise_error(col(message))


def failing(condition: Column, message: str, value: Column) -> Column:
    """value, or an error with this message where the condition holds."""
    return F.when(condition, error(message)).otherwise(value)


def divide(a, b) -> Column:
    """Always a double; x/0 is infinite or NaN."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))


def power(a, b, whole: bool = False) -> Column:
    """Whole numbers to a constant power from 1 to 9 are an exact product; else by floats."""
    if whole and isinstance(b, int) and 0 < b < 10:
        return reduce(lambda x, y: x * y, [col(a).cast("bigint")] * b)
    p = F.pow(col(a).cast("double"), col(b).cast("double"))
    return p.cast("bigint") if whole else p


def _shift(f, a, n, beyond: Column) -> Column:
    a, n = col(a).cast("bigint"), col(n)
    return failing(n < 0, "a shift count is negative", F.when(n >= 64, beyond).otherwise(f(a, n.cast("int"))))


def shift_left(a, n) -> Column:
    return _shift(lambda x, k: F.call_function("shiftleft", x, k), a, n, F.lit(0).cast("bigint"))


def shift_right(a, n) -> Column:
    return _shift(lambda x, k: F.call_function("shiftright", x, k), a, n, F.when(col(a) < 0, F.lit(-1)).otherwise(0).cast("bigint"))


def modulo(a, b) -> Column:
    return failing(col(b) == 0, "modulo by zero", F.try_mod(col(a), col(b)))


def sqrt(x) -> Column:
    return failing(col(x) < 0, "sqrt of a negative number", F.sqrt(x))


def _log(x, f) -> Column:
    x = col(x).cast("double")
    return F.when(x == 0, F.lit(-INF)).otherwise(failing(x < 0, "logarithm of a negative number", f(x)))


def ln(x) -> Column:
    return _log(x, F.log)


def log10(x) -> Column:
    return _log(x, F.log10)


def asin(x) -> Column:
    return failing(F.abs(col(x)) > 1, "asin outside [-1, 1]", F.asin(x))


def acos(x) -> Column:
    return failing(F.abs(col(x)) > 1, "acos outside [-1, 1]", F.acos(x))


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


def trunc(x) -> Column:
    x = col(x).cast("double")
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


def round_(x) -> Column:
    """Half away from zero, as an integer."""
    return F.round(col(x)).cast("bigint")


def sign(x, whole: bool = False) -> Column:
    return F.signum(col(x)).cast("bigint" if whole else "double")


def least(*xs) -> Column:
    return reduce(lambda a, b: F.when(col(b) < col(a), col(b)).otherwise(col(a)), xs)


def greatest(*xs) -> Column:
    return reduce(lambda a, b: F.when(col(b) > col(a), col(b)).otherwise(col(a)), xs)


def float_text(x) -> Column:
    """The shortest text of a double, with an exponent below 1e-4 and from 1e6 on: 3, 0.5, 1e+06, 1e-05."""
    x = col(x).cast("double")
    text = F.abs(x).cast("string")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1)
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), "0+$", "")
    exponent = F.when(power != "", power.cast("int")).otherwise(F.length(whole) - 1)
    digits = F.regexp_replace(F.concat(whole, part), "0+$", "")
    rest = F.substring(digits, 2, 400)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    scientific = F.concat(mantissa, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    plain = F.when(power != "", small).when(part != "", F.concat(whole, F.lit("."), part)).otherwise(whole)
    shown = F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)
    return F.when(F.isnan(x), F.lit("NaN")).when(x == INF, F.lit("+Inf")).when(x == -INF, F.lit("-Inf")).when(x == 0, F.lit("0")).otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), shown))


# --- strings: lengths and indexes count bytes, cut counts characters ------------------------------------------------


def byte_len(s) -> Column:
    return F.octet_length(col(s)).cast("bigint")


def trim(s) -> Column:
    return F.regexp_replace(col(s), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def index_of(s, part) -> Column:
    at = F.locate(part, col(s)) if isinstance(part, str) else F.instr(col(s), part)
    return F.when(at == 0, F.lit(-1)).otherwise(F.octet_length(F.substring(col(s), F.lit(1), at - 1))).cast("bigint")


def split(s, sep: str) -> Column:
    return F.split(col(s), "\\Q" + sep + "\\E", -1)


def cut(s, start: int, length: int) -> Column:
    start = max(start, 0)
    return F.substring(col(s), start + 1, length if length > 0 else 2**31 - 1 - start)


def behind(s, prefix: str) -> Column:
    return trim(F.regexp_extract(col(s), "(?m)\\Q" + prefix + "\\E(.*)$", 1))


def behind_list(s, header: str) -> Column:
    lines = F.transform(F.split(col(s), "\n"), trim)
    rest = F.slice(lines, F.array_position(lines, header).cast("int") + 1, F.size(lines))
    stop = F.array_position(rest, "").cast("int")
    return F.when(F.array_contains(lines, header), F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)).otherwise(F.array().cast("array<string>"))


def replace(s, old: str, new: str) -> Column:
    return F.regexp_replace(col(s), "", new) if old == "" else F.replace(col(s), F.lit(old), F.lit(new))


def to_int(s) -> Column:
    return failing(~col(s).rlike(r"^[+-]?\d+$"), "not an integer", col(s).try_cast("bigint"))


def to_float(s) -> Column:
    return failing(~col(s).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "not a number", col(s).try_cast("double"))

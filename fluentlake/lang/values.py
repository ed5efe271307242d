"""Values of the language at compile time: typed operators on constants, their texts, and user types.

Whole numbers are 64-bit and wrap. Operators check types: what has no meaning is a LanguageError, never a Python result by
accident. User types join in by overloads, looked up by operator and the kinds of both sides."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from fluentlake.lang.parser import LanguageError


def wrap(n: int) -> int:
    """Two's complement of 64 bits."""
    return (n + 2**63) % 2**64 - 2**63


def kind(v: Any) -> str:
    """bool, int, float, string, list, map, function, or the name of a user type."""
    for python, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (list, "list"), (dict, "map")):
        if isinstance(v, python):
            return name
    return getattr(v, "language_type", "function" if callable(v) else "nil" if v is None else type(v).__name__)


def text_of(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return float_text(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{k}:{text_of(x)}" for k, x in v.items()) + "}"
    return "nil" if v is None else str(v)


def float_text(v: float) -> str:
    """Shortest digits that give the number again; with an exponent below 1e-4 and from 1e6 on."""
    if math.isnan(v) or math.isinf(v):
        return "NaN" if math.isnan(v) else "+Inf" if v > 0 else "-Inf"
    sign = "-" if math.copysign(1, v) < 0 else ""
    if v == 0:
        return sign + "0"
    mantissa, _, power = f"{abs(v)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    exponent = int(power or 0) + (len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0")) + 1))
    digits = digits.rstrip("0") or "0"
    if not LOW_EXPONENT <= exponent < FROM_EXPONENT:
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{digits}"
    digits = digits.ljust(exponent + 1, "0")
    return f"{sign}{digits[: exponent + 1]}{'.' + digits[exponent + 1 :] if len(digits) > exponent + 1 else ''}"


#: Decimal exponents that are written without an exponent: from LOW_EXPONENT to below FROM_EXPONENT.
LOW_EXPONENT, FROM_EXPONENT = -4, 6


def number(v: Any) -> bool:
    return kind(v) in ("int", "float")


def equal(a: Any, b: Any) -> bool:
    """Numbers by value, lists and maps by their items; other pairs of kinds are an error."""
    ka, kb = kind(a), kind(b)
    if number(a) and number(b) or ka == kb and ka in ("bool", "string"):
        return a == b
    if ka == kb == "list":
        return len(a) == len(b) and all(equal(x, y) for x, y in zip(a, b, strict=True))
    if ka == kb == "map":
        return a.keys() == b.keys() and all(equal(x, b[k]) for k, x in a.items())
    raise LanguageError(f"{ka} and {kb} cannot be compared")


def less(a: Any, b: Any) -> bool:
    if number(a) and number(b) or kind(a) == kind(b) == "string":
        return a < b
    raise LanguageError(f"{kind(a)} and {kind(b)} have no order")


def contains(a: Any, b: Any) -> bool:
    """a ~ b: an item or a list (repeats count) in a list, a text in a text, a key in a map."""
    if kind(b) == "list":
        if kind(a) != "list":
            return any(same(a, x) for x in b)
        left = list(b)
        for x in a:
            at = next((k for k, y in enumerate(left) if same(x, y)), None)
            if at is None:
                return False
            left.pop(at)
        return True
    if kind(b) in ("string", "map") and kind(a) == "string":
        return a in b
    raise LanguageError(f"no {kind(a)} in a {kind(b)}")


def same(a: Any, b: Any) -> bool:
    try:
        return equal(a, b)
    except LanguageError:
        return False


def _numbers(op: str, a: Any, b: Any) -> None:
    if not (number(a) and number(b)):
        raise LanguageError(f"{op} is not possible on {kind(a)} and {kind(b)}")


def _ints(op: str, a: Any, b: Any) -> None:
    if not kind(a) == kind(b) == "int":
        raise LanguageError(f"{op} needs whole numbers, not {kind(a)} and {kind(b)}")


def arithmetic(op: str, f: Callable) -> Callable[[Any, Any], Any]:
    def run(a: Any, b: Any) -> Any:
        _numbers(op, a, b)
        return wrap(f(a, b)) if kind(a) == kind(b) == "int" else f(float(a), float(b))

    return run


def plus(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        return a + text_of(b)
    if kind(a) == kind(b) == "list":
        return a + b
    if kind(a) == kind(b) == "map":
        if both := a.keys() & b.keys():
            raise LanguageError(f"{', '.join(sorted(both))} is in both maps")
        return a | b
    return arithmetic("+", lambda x, y: x + y)(a, b)


def divide(a: Any, b: Any) -> float:
    _numbers("/", a, b)
    a, b = float(a), float(b)
    return a / b if b else math.nan if not a or math.isnan(a) else math.copysign(math.inf, a)


def modulo(a: Any, b: Any) -> int:
    _ints("%", a, b)
    if not b:
        raise LanguageError("modulo by zero")
    return wrap(abs(a) % abs(b) * (-1 if a < 0 else 1))


def power(a: Any, b: Any) -> Any:
    """Whole numbers: an exact product that wraps for exponents from 1 to 9, else by floats."""
    _numbers("^", a, b)
    if kind(a) == kind(b) == "int" and 0 < b < 10:
        return wrap(a**b)
    try:
        found = math.pow(a, b)
    except OverflowError:
        found = math.inf
    except ValueError:
        found = math.inf if a == 0 else math.nan
    if kind(a) == kind(b) == "int":
        return max(min(int(found), 2**63 - 1), -(2**63)) if math.isfinite(found) else -(2**63)
    return found


def shift(op: str) -> Callable[[int, int], int]:
    def run(a: Any, b: Any) -> int:
        _ints(op, a, b)
        if b < 0:
            raise LanguageError("a shift count is negative")
        return (wrap(a << b) if b < 64 else 0) if op == "<<" else a >> min(b, 63)

    return run


def _bools(op: str, f: Callable) -> Callable[[Any, Any], bool]:
    def run(a: Any, b: Any) -> bool:
        if not kind(a) == kind(b) == "bool":
            raise LanguageError(f"{op} needs bools, not {kind(a)} and {kind(b)}")
        return f(a, b)

    return run


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "|": _bools("|", lambda a, b: a or b),
    "&": _bools("&", lambda a, b: a and b),
    "=": equal,
    "!=": lambda a, b: not equal(a, b),
    "~": contains,
    "<": less,
    ">": lambda a, b: less(b, a),
    "<=": lambda a, b: less(a, b) or equal(a, b),
    ">=": lambda a, b: less(b, a) or equal(a, b),
    "+": plus,
    "-": arithmetic("-", lambda a, b: a - b),
    "<<": shift("<<"),
    ">>": shift(">>"),
    "*": arithmetic("*", lambda a, b: a * b),
    "%": modulo,
    "/": divide,
    "^": power,
}


def negate(a: Any) -> Any:
    if not number(a):
        raise LanguageError(f"no - of a {kind(a)}")
    return wrap(-a) if kind(a) == "int" else -a


def invert(a: Any) -> bool:
    if kind(a) != "bool":
        raise LanguageError(f"no ! of a {kind(a)}")
    return not a


UNARY: dict[str, Callable[[Any], Any]] = {"-": negate, "!": invert}

"""A language with a host's own additions: functions, operators, overloads, types with methods, keywords and options.

Everything is compiled to Columns where a text works on tables, so additions work on constants and on columns alike; a user
type is a Python class with `language_type` on the driver, and a struct with the type's fields in a table."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluentlake.lang.compiler import ROW, Compiler
from fluentlake.lang.parser import Grammar, LanguageError, Node, parse, rewrite


@dataclass(frozen=True)
class Function:
    """A static function: least and most arguments (most -1: any number), and whether equal arguments give equal results."""

    name: str
    call: Callable
    least: int
    most: int
    pure: bool = True
    description: str = ""


@dataclass(frozen=True)
class UserType:
    """fields: the struct's, in order; make: the value from them, whose attributes have the fields' names."""

    name: str
    fields: tuple[str, ...]
    make: Callable
    description: str = ""
    methods: dict[str, Callable] = field(default_factory=dict)


class Language:
    def __init__(self, grammar: Grammar = Grammar(), implicit_row: bool = False):  # noqa: B008
        self.grammar, self.implicit_row = grammar, implicit_row
        self.functions: dict[str, Function] = {}
        self.types: dict[str, UserType] = {}
        self.binary: dict[tuple[str, str, str], Callable] = {}
        self.prefixed: dict[tuple[str, str], Callable] = {}
        self.optimizers: list[Callable[[Node], Node | None]] = []

    # functions
    def function(self, name: str, call: Callable, least: int | None = None, most: int | None = None, pure: bool = True, description: str = "") -> Language:
        """Adds a function; its arity comes from its signature unless given."""
        if least is None:
            plain = [p for p in inspect.signature(call).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
            least = sum(p.default is p.empty for p in plain)
            most = -1 if any(p.kind == p.VAR_POSITIONAL for p in inspect.signature(call).parameters.values()) else len(plain)
        self.functions[name] = Function(name, call, least, least if most is None else most, pure, description)
        return self

    def wrap(self, name: str, around: Callable[[Callable], Callable]) -> Language:
        """Replaces a function by what `around` makes of it; a built-in one too."""
        old = self.functions.get(name)
        call = old.call if old else lambda *args: Compiler({}).static(name, list(args), _no_context(), 0)
        new = around(call)
        self.functions[name] = replace(old, call=new) if old else Function(name, new, 0, -1)
        return self

    def found(self, name: str, n: int, line: int) -> Callable | None:
        if (f := self.functions.get(name)) is None:
            return None
        if n < f.least or f.most >= 0 and n > f.most:
            raise LanguageError(f"{name} needs {f.least if f.least == f.most else f'{f.least} to {f.most}' if f.most >= 0 else f'{f.least} or more'} arguments in line {line}")
        return f.call

    # operators
    def operator(self, sign: str, call: Callable | None = None, above: str | None = None) -> Language:
        """Adds a binary operator with a priority just above that of another one (none: the lowest)."""
        if sign in self.grammar.operators:
            raise ValueError(f"there is an operator {sign}")
        held = list(self.grammar.operators)
        held.insert(held.index(above) + 1 if above else 0, sign)
        self.grammar = replace(self.grammar, operators=tuple(held))
        if call:
            self.binary[sign, "", ""] = call
        return self

    def overloads(self, sign: str, left: str, right: str, call: Callable) -> Language:
        """The operator for a pair of kinds."""
        if (sign, left, right) in self.binary:
            raise ValueError(f"{left} {sign} {right} is there")
        self.binary[sign, left, right] = call
        return self

    def unary(self, sign: str, kind: str, call: Callable) -> Language:
        if (sign, kind) in self.prefixed:
            raise ValueError(f"{sign}{kind} is there")
        self.prefixed[sign, kind] = call
        return self

    def overload(self, sign: str, left: str, right: str) -> Callable | None:
        if sign == "!=" and (f := self.binary.get(("=", left, right))):
            return lambda a, b: ~x if isinstance(x := f(a, b), Column) else not x
        if sign == ">" and (f := self.binary.get(("<", right, left))):
            return lambda a, b: f(b, a)
        return self.binary.get((sign, left, right)) or self.binary.get((sign, "", ""))

    def unary_overload(self, sign: str, kind: str) -> Callable | None:
        return self.prefixed.get((sign, kind))

    # types
    def type(self, name: str, fields: tuple[str, ...], make: Callable, description: str = "", **methods: Callable) -> Language:
        self.types[name] = UserType(name, tuple(fields), make, description, dict(methods))
        return self

    def method(self, kind: str, name: str) -> Callable | None:
        held = self.types.get(kind)
        return held.methods.get(name) if held else None

    def type_of_struct(self, text: str) -> str | None:
        """The user type whose fields a struct type has."""
        return next((t.name for t in self.types.values() if text.startswith("struct<") and [x.partition(":")[0] for x in text[7:-1].split(",")] == list(t.fields)), None)

    # front end
    def optimizer(self, change: Callable[[Node], Node | None]) -> Language:
        """change gets each node of a tree, parts first, and may return another one."""
        self.optimizers.append(change)
        return self

    def optimized(self, node: Node) -> Node:
        for change in self.optimizers:
            node = rewrite(node, change)
        return node

    def run(self, text: str, **bindings: Any) -> Any:
        return Compiler(bindings, None, self).run(text)

    def compile(self, text: str, *names: str) -> Callable:
        """A text as a function of the named arguments, parsed once. With implicit_row and one name, the fields of that
        argument are names of the text."""
        node = self.optimized(parse(text, self.grammar))

        def call(*args: Any) -> Any:
            if len(args) != len(names):
                raise LanguageError(f"{len(names)} arguments are needed")
            bindings = dict(zip(names, args, strict=True))
            if self.implicit_row and len(names) == 1:
                bindings[ROW] = args[0]
            return Compiler(bindings, None, self).run_node(node)

        call.arity = len(names)
        return call

    def describe(self) -> list[dict[str, str]]:
        """What a host added."""
        functions = [{"kind": "function", "name": f.name, "arguments": str(f.least) if f.least == f.most else f"{f.least}..{f.most if f.most >= 0 else ''}", "description": f.description} for f in self.functions.values()]
        methods = [{"kind": "method", "name": f"{t.name}.{m}", "arguments": "", "description": (f.__doc__ or "").strip()} for t in self.types.values() for m, f in t.methods.items()]
        return functions + [{"kind": "type", "name": t.name, "arguments": ", ".join(t.fields), "description": t.description} for t in self.types.values()] + methods


def _no_context():
    from fluentlake.lang.compiler import Context

    return Context()


class Measured:
    """A value with its error: the interval from val - err to val + err."""

    language_type = "measured"

    def __init__(self, val: float, err: float):
        self.val, self.err = float(val), abs(float(err))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Measured) and (self.val, self.err) == (other.val, other.err)

    __hash__ = None

    def __str__(self) -> str:
        from fluentlake.lang.values import text_of

        return f"{text_of(self.val)}±{text_of(self.err)}"


def measured_language() -> Language:
    """A language with measured values: a +- e, err(e), val, err; + - * / by interval bounds, = where intervals overlap."""

    def parts(x: Any) -> tuple[Any, Any]:
        if isinstance(x, Measured):
            return x.val, x.err
        if isinstance(x, Column):
            return x, F.lit(0.0)
        return float(x), 0.0

    def struct(x: Column) -> tuple[Column, Column]:
        return x.getField("val"), x.getField("err")

    def make(val: Any, err: Any) -> Any:
        if isinstance(val, Column) or isinstance(err, Column):
            val, err = (x if isinstance(x, Column) else F.lit(float(x)) for x in (val, err))
            return F.struct(val.cast("double").alias("val"), F.abs(err).cast("double").alias("err"))
        return Measured(val, err)

    def bounds(op: Callable, a: tuple, b: tuple) -> Any:
        """The interval that holds op of any two values of a and b."""
        ends = [op(a[0] + s * a[1], b[0] + t * b[1]) for s in (-1, 1) for t in (-1, 1)]
        low, high = (F.least(*ends), F.greatest(*ends)) if any(isinstance(x, Column) for x in ends) else (min(ends), max(ends))
        return make((low + high) / 2, (high - low) / 2)

    def distance(a: Any, b: Any) -> Any:
        d = a - b
        return F.abs(d) if isinstance(d, Column) else abs(d)

    rules = {
        "+": lambda a, b: make(a[0] + b[0], a[1] + b[1]),
        "-": lambda a, b: make(a[0] - b[0], a[1] + b[1]),
        "*": lambda a, b: bounds(lambda x, y: x * y, a, b),
        "/": lambda a, b: bounds(lambda x, y: x / y, a, b),
        "=": lambda a, b: distance(a[0], b[0]) <= a[1] + b[1],
        "<": lambda a, b: a[0] + a[1] < b[0] - b[1],
    }
    both = lambda f, left, right: lambda a, b: f(_open(a, left), _open(b, right))

    def _open(x: Any, kind: str) -> tuple:
        return struct(x) if kind == "measured" and isinstance(x, Column) else parts(x)

    language = Language().type("measured", ("val", "err"), make, "a value and its error", val=lambda x: _open(x, "measured")[0], err=lambda x: _open(x, "measured")[1], string=lambda x: F.concat(x.getField("val").cast("string"), F.lit("±"), x.getField("err").cast("string")) if isinstance(x, Column) else str(x))
    for sign, f in rules.items():
        for left, right in (("measured", "measured"), ("measured", "float"), ("float", "measured"), ("measured", "int"), ("int", "measured")):
            language.overloads(sign, left, right, both(f, left, right))
    language.unary("-", "measured", lambda a: make(-a.val, a.err))
    language.operator("+-", make, above="^")
    return language.function("err", lambda e: make(0.0, e), description="a measured value of 0 with this error")

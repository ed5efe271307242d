"""Syntax tree to plans. A value is a Python constant (number, text, bool, list, dict, function), a Column of the record at
hand, or a Table. Closures are applied while compiling and never reach Spark. A group's `values` only ever become
aggregates of one groupBy, so groups are not collected. Expressions over constants are worked out here."""

from __future__ import annotations

import functools
import math
import random
import sys
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluentlake.functions import scalars as S
from fluentlake.lang import values as V
from fluentlake.lang.parser import Grammar, LanguageError, Node, parse, visit
from fluentlake.lang.values import text_of
from fluentlake.operators import sequential as Q
from fluentlake.operators.table import Interpolation, Record, Sorted, Table

_DEPTH = 20_000
_MATHS = {"sqrt": (math.sqrt, S.sqrt), "ln": (lambda x: math.log(x) if x else -math.inf, S.ln), "log10": (lambda x: math.log10(x) if x else -math.inf, S.log10), "exp": (math.exp, F.exp), "sin": (math.sin, F.sin), "cos": (math.cos, F.cos), "tan": (math.tan, F.tan), "asin": (math.asin, S.asin), "acos": (math.acos, S.acos), "atan": (math.atan, F.atan), "floor": (lambda x: float(math.floor(x)), S.floor), "ceil": (lambda x: float(math.ceil(x)), S.ceil), "trunc": (lambda x: float(math.trunc(x)), S.trunc)}


class Context:
    """The DataFrame whose columns are in reach, for their types. A fold's function is compiled twice, as the variables of a
    higher-order function have no types of their own: over columns, noting the types asked for, and then over the variables
    with the noted ones."""

    def __init__(self, df=None, noted: list[str] | None = None, told: list[str] | None = None):
        self.df, self.noted, self.told = df, noted, told

    def kind(self, v: Any) -> str:
        if not isinstance(v, Column):
            return {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(v), "other")
        if self.told is not None:
            return self.told.pop(0)
        try:
            found = self.df.select(v.alias("x")).schema["x"].dataType.simpleString()
        except AnalysisException:  # a variable of a higher-order function
            found = "other"
        if self.noted is not None:
            self.noted.append(found)
        return found


class Portable:
    """A function of the language without tables and columns, for Python workers."""

    def __init__(self, node: Node):
        self.node, self.arity, self.env = node, len(node.value), {}

    def __call__(self, *args, context: Context | None = None):
        if len(args) != self.arity:
            raise LanguageError(f"{self.arity} arguments are needed in line {self.node.line}")
        return Compiler({}).eval(self.node.parts[0], self.env | dict(zip(self.node.value, args, strict=True)), Context())


def portable(v: Any, memo: dict[int, Any] | None = None) -> Any:
    """v without what only the driver has; functions keep the constants and functions that they see."""
    memo = {} if memo is None else memo
    if id(v) in memo:
        return memo[id(v)]
    if hasattr(v, "node") and hasattr(v, "env"):
        memo[id(v)] = out = Portable(v.node)
        out.env = {k: p for k, x in v.env.items() if (p := portable(x, memo)) is not None}
        return out
    owner = getattr(v, "__self__", None)
    if isinstance(owner, LowPass):
        return getattr(LowPass(owner.name, portable(owner.time, memo), portable(owner.value, memo), owner.tau), v.__name__)
    if isinstance(v, dict):
        return {k: p for k, x in v.items() if (p := portable(x, memo)) is not None}
    if isinstance(v, list):
        return [portable(x, memo) for x in v]
    return v if isinstance(v, bool | int | float | str | Interpolation) else None


class Group:
    """A group while it is compiled: its key, and its values as aggregates that are noted down."""

    def __init__(self, base: Table, noted: dict[str, Column], only: Column | None = None):
        self.base, self.noted, self.only = base, noted, only

    def those(self, column: Column) -> Column:
        """The column where the sub-list's condition holds."""
        return column if self.only is None else F.when(self.only, column)

    def aggregate(self, column: Column) -> Column:
        name = next((k for k, c in self.noted.items() if str(c) == str(column)), f"_agg{len(self.noted)}")
        self.noted[name] = column
        return F.col(name)


class Grouped:
    """groupBy that waits for what is asked of its groups."""

    def __init__(self, base: Table, key: Column, steps: tuple = (), first_seen: bool = False):
        self.base, self.key, self.steps, self.first_seen = base, key, steps, first_seen

    def then(self, kind: str, f: Callable) -> Grouped:
        return Grouped(self.base, self.key, (*self.steps, (kind, f)), self.first_seen)

    def table(self, make: Callable | None = None) -> Table:
        noted: dict[str, Column] = {}
        done = [(kind, f(Group(self.base, noted))) for kind, f in self.steps]
        made = make(Group(self.base, noted)) if make else {"key": F.col("key")}
        made = made if isinstance(made, dict) else {"value": made}
        aggregates = [c.alias(k) for k, c in noted.items()] or [F.count("*").alias("_n")]
        if self.first_seen:
            aggregates.append(F.min(self.base._key()).alias("_first"))
        df = self.base.df.groupBy(self.key.alias("key")).agg(*aggregates)
        out = Table(df, ("_first",) if self.first_seen else ("key",))
        for kind, column in done:
            if kind == "accept":
                out = out.accept(lambda _, c=column: c)
            else:
                out = out.sort(lambda _, c=column: c, reverse=kind == "orderRev")
        columns = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in made.items()]
        hidden = [F.col(c).alias(f"_o{k}") for k, c in enumerate(out.order)]
        df = out.df.select(*columns, *hidden)
        names = tuple(f"_o{k}" for k in range(len(out.order)))
        if isinstance(out, Sorted):
            sorted_table = Sorted(df, names[0] if out.key else None, out.reversed, names[1:] if out.key else names, ())
            return sorted_table
        return Table(df, names)


class Exists:
    """present of another table inside a row's function: a semi join, or an anti join if negated."""

    def __init__(self, table: Table, other, test: Column, negated: bool = False):
        self.table, self.other, self.test, self.negated = table, other, test, negated

    def filter(self, t: Table) -> Table:
        return t._with(t.df.join(self.other, self.test, "left_anti" if self.negated else "left_semi"))


class Matches:
    """accept of another table inside a row's function, until an aggregate follows: a left join and one groupBy."""

    def __init__(self, table: Table, other, test: Column, value: Column | None = None, how: str = ""):
        self.table, self.other, self.test, self.value, self.how = table, other, test, value, how

    def column(self) -> Column:
        hit = F.col("_other__hit")
        if self.how == "size":
            return F.count(hit)
        return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[self.how](self.value)


def _renamed(t: Table):
    """Another table's rows with names that clash with no other."""
    return t.df.select(*[F.col(c).alias(f"_other_{c}") for c in t.df.columns], F.lit(1).alias("_other__hit"))


class Compiler:
    """functions, types and overloads: what a Language adds."""

    def __init__(self, bindings: dict[str, Any], functions: dict[str, Callable] | None = None, language: Any = None):
        self.bindings, self.functions, self.language = bindings, functions or {}, language

    def run(self, text: str) -> Any:
        node = parse(text, self.language.grammar if self.language else Grammar())
        return self.run_node(self.language.optimized(node) if self.language else node)

    def run_node(self, node: Node) -> Any:
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, _DEPTH))
        try:
            return self.eval(node, dict(self.bindings), Context())
        except RecursionError:
            raise LanguageError("the recursion is too deep") from None
        finally:
            sys.setrecursionlimit(before)

    def binary(self, op: str, a: Any, b: Any, line: int) -> Any:
        """An operator on constants: overloads of user types first."""
        try:
            if self.language and (f := self.language.overload(op, V.kind(a), V.kind(b))):
                return f(a, b)
            if op not in V.BINARY:
                raise LanguageError(f"no operator {op} on {V.kind(a)} and {V.kind(b)}")
            return V.BINARY[op](a, b)
        except LanguageError as error:
            raise error if " line " in str(error) else LanguageError(f"{error} in line {line}") from None

    def unary(self, op: str, v: Any, line: int) -> Any:
        if isinstance(v, Exists) and op == "!":
            return Exists(v.table, v.other, v.test, not v.negated)
        if isinstance(v, Column):
            return -v if op == "-" else ~v
        if self.language and (f := self.language.unary_overload(op, V.kind(v))):
            return f(v)
        try:
            return V.UNARY[op](v)
        except LanguageError as error:
            raise LanguageError(f"{error} in line {line}") from None

    def function(self, node: Node, env: dict, ctx: Context) -> Callable:
        f = self.eval(node, env, ctx)
        if not callable(f):
            raise LanguageError(f"a function is needed in line {node.line}")
        return f

    def eval(self, n: Node, env: dict, ctx: Context) -> Any:
        match n.kind:
            case "const":
                return n.value
            case "name":
                if n.value in env:
                    return env[n.value]
                if n.value == "pi":
                    return math.pi
                row = env.get(ROW)
                if isinstance(row, Record) and n.value in row._df.columns or isinstance(row, dict) and n.value in row:
                    return self.field(row, n.value, n.line)
                raise LanguageError(f"{n.value} is not known in line {n.line}")
            case "let":
                return self.eval(n.parts[1], env | {n.value: self.eval(n.parts[0], env, ctx)}, ctx)
            case "func":
                name, params = n.value
                inner = dict(env)

                def named(*args, context: Context | None = None):
                    if len(args) != len(params):
                        raise LanguageError(f"{name} needs {len(params)} arguments in line {n.line}")
                    return self.eval(n.parts[0], inner | dict(zip(params, args, strict=True)), context or ctx)

                named.arity, named.node, named.env = len(params), Node("lambda", params, (n.parts[0],), n.line), inner
                inner[name] = named
                return self.eval(n.parts[1], inner, ctx)
            case "lambda":
                def call(*args, context: Context | None = None):
                    if len(args) != len(n.value):
                        raise LanguageError(f"{len(n.value)} arguments are needed in line {n.line}")
                    return self.eval(n.parts[0], env | dict(zip(n.value, args, strict=True)), context or ctx)

                call.arity, call.node, call.env = len(n.value), n, env
                return call
            case "list":
                items = [self.eval(x, env, ctx) for x in n.parts]
                return F.array(*[S.col(x) for x in items]) if any(isinstance(x, Column) for x in items) else items
            case "map":
                return dict(zip(n.value, (self.eval(x, env, ctx) for x in n.parts), strict=True))
            case "neg":
                return self.unary("-", self.eval(n.parts[0], env, ctx), n.line)
            case "not":
                return self.unary("!", self.eval(n.parts[0], env, ctx), n.line)
            case "if":
                test = self.eval(n.parts[0], env, ctx)
                if not isinstance(test, Column):
                    if not isinstance(test, bool):
                        raise LanguageError(f"the condition is no bool in line {n.line}")
                    return self.eval(n.parts[1 if test else 2], env, ctx)
                return F.when(test, S.col(self.eval(n.parts[1], env, ctx))).otherwise(S.col(self.eval(n.parts[2], env, ctx)))
            case "switch":
                v, *cases, other = (self.eval(x, env, ctx) for x in n.parts)
                out = other
                for k in range(len(cases) - 2, -1, -2):
                    same = S.col(v) == S.col(cases[k]) if isinstance(v, Column) or isinstance(cases[k], Column) else V.equal(v, cases[k])
                    out = F.when(same, S.col(cases[k + 1])).otherwise(S.col(out)) if isinstance(same, Column) else cases[k + 1] if same else out
                return out
            case "try":
                return self.attempt(n, env, ctx)
            case "field":
                return self.field(self.eval(n.parts[0], env, ctx), n.value, n.line)
            case "index":
                v, k = (self.eval(x, env, ctx) for x in n.parts)
                if isinstance(v, Column):
                    k = S.col(k)
                    return S.failing((k < 0) | (k >= F.size(v)), f"an index is out of range in line {n.line}", F.get(v, k.cast("int")))
                if not isinstance(v, list) or V.kind(k) != "int" or k < 0 or k >= len(v):
                    raise LanguageError(f"index {text_of(k)} is out of range in line {n.line}")
                return v[k]
            case "call":
                if n.parts[0].kind == "name" and n.parts[0].value not in env:
                    return self.static(n.parts[0].value, [self.eval(x, env, ctx) for x in n.parts[1:]], ctx, n.line)
                return self.function(n.parts[0], env, ctx)(*(self.eval(x, env, ctx) for x in n.parts[1:]))
            case "method":
                return self.method(self.eval(n.parts[0], env, ctx), n.value, [self.eval(x, env, ctx) for x in n.parts[1:]], ctx, n.line)
            case "op":
                return self.operate(n, env, ctx)
        raise LanguageError(f"cannot compile {n.kind}")

    def attempt(self, n: Node, env: dict, ctx: Context) -> Any:
        """For columns, what would raise an error is null, and null is the other value; constants are tried here."""
        value, other = n.parts
        try:
            with S.forgiving():
                found = self.eval(value, env, ctx)
            if not isinstance(found, Column):
                return found
        except Exception as error:  # the language catches any error
            fallback = self.eval(other, env, ctx)
            return fallback(str(error)) if callable(fallback) else fallback
        fallback = self.eval(other, env, ctx)
        return F.coalesce(found, S.col(fallback("error") if callable(fallback) else fallback))

    def field(self, v: Any, name: str, line: int) -> Any:
        if isinstance(v, dict):
            if name not in v:
                raise LanguageError(f"no field {name} in line {line}; there are {', '.join(v)}")
            return v[name]
        if isinstance(v, Group):
            if name == "key":
                return F.col("key")
            if name == "values":
                return ("values", v)
            raise LanguageError(f"a group has key and values, no {name}")
        if isinstance(v, Column):
            return v.getField(name)
        if isinstance(v, Record | _Neighbour):
            try:
                return v[name]
            except KeyError as error:
                raise LanguageError(f"{error.args[0]} in line {line}") from None
        raise LanguageError(f"a {V.kind(v)} has no field {name} in line {line}")

    def operate(self, n: Node, env: dict, ctx: Context) -> Any:
        a = self.eval(n.parts[0], env, ctx)
        if n.value in ("&", "|") and isinstance(a, bool):
            if a != (n.value == "&"):
                return a
            b = self.eval(n.parts[1], env, ctx)
            return b if isinstance(b, Column | Exists) else self.binary(n.value, a, b, n.line)
        b = self.eval(n.parts[1], env, ctx)
        a, b = (fields_of(x) if isinstance(x, Record) else x for x in (a, b))
        if isinstance(a, Table) and isinstance(b, Table) and n.value == "+":
            return a.append_list(b)
        if n.value == "~" and isinstance(b, Table) and isinstance(a, Column):
            other = _renamed(b)
            names = [c for c in b.df.columns if c not in b.order] or list(b.df.columns)
            return Exists(b, other, a == F.col(f"_other_{names[0]}"))
        if isinstance(a, dict) and isinstance(b, dict) and n.value == "+":
            return V.plus(a, b)
        if not (isinstance(a, Column) or isinstance(b, Column)):
            return self.binary(n.value, a, b, n.line)
        if self.language and (f := self.language.overload(n.value, self.kind(a, ctx), self.kind(b, ctx))):
            return f(a, b)
        match n.value:
            case "=":
                return S.col(a) == S.col(b)
            case "!=":
                return S.col(a) != S.col(b)
            case "<":
                return S.col(a) < S.col(b)
            case ">":
                return S.col(a) > S.col(b)
            case "<=":
                return S.col(a) <= S.col(b)
            case ">=":
                return S.col(a) >= S.col(b)
            case "-":
                return S.col(a) - S.col(b)
            case "*":
                return S.col(a) * S.col(b)
            case "&":
                return S.col(a) & S.col(b)
            case "|":
                return S.col(a) | S.col(b)
            case "+":
                if ctx.kind(a) == "string":
                    return F.concat(S.col(a), self.to_text(b, ctx))
                if ctx.kind(a).startswith("array") or isinstance(a, list):
                    return F.concat(as_column(a), as_column(b))
                return S.col(a) + S.col(b)
            case "/":
                return S.divide(a, b)
            case "%":
                return S.modulo(a, b)
            case "^":
                return S.power(a, b, ctx.kind(a) in ("bigint", "int") and ctx.kind(b) in ("bigint", "int"))
            case "<<":
                return S.shift_left(a, b)
            case ">>":
                return S.shift_right(a, b)
            case "~":
                if isinstance(b, list):
                    return a.isin(*b)
                if ctx.kind(b).startswith("array"):
                    return F.array_contains(b, S.col(a))
                return F.contains(S.col(b), S.col(a))
        raise LanguageError(f"no operator {n.value} in line {n.line}")

    def kind(self, v: Any, ctx: Context) -> str:
        """The kind of a constant or column, for overloads."""
        if not isinstance(v, Column):
            return V.kind(v)
        name = ctx.kind(v)
        return {"boolean": "bool", "bigint": "int", "double": "float"}.get(name) or (self.language.type_of_struct(name) or name)

    def to_text(self, v: Any, ctx: Context) -> Column:
        if not isinstance(v, Column):
            return F.lit(text_of(v))
        return S.float_text(v) if ctx.kind(v) in ("double", "float") else v.cast("string")

    def static(self, name: str, args: list, ctx: Context, line: int) -> Any:
        column = any(isinstance(a, Column) for a in args)
        whole = bool(args) and ctx.kind(args[0]) in ("bigint", "int") if column else bool(args) and isinstance(args[0], int)
        if name in self.functions:
            return self.functions[name](*args)
        if self.language and (f := self.language.found(name, len(args), line)):
            return f(*args)
        if name in _MATHS:
            try:
                return _MATHS[name][column](*args)
            except (TypeError, ValueError, OverflowError) as error:
                raise LanguageError(f"{name}: {error} in line {line}") from None
        match name:
            case "throw":
                if ctx.df is not None:  # in a row's function: an error of the row, if its branch is taken
                    return S.error(S.col(args[0]).cast("string"))
                raise LanguageError(text_of(args[0]))
            case "random":
                if ctx.df is None:
                    return random.randrange(args[0]) if args else random.random()
                return F.floor(F.rand() * args[0]) if args else F.rand()
            case "randomConst":
                return random.randrange(args[0]) if args else random.random()
            case "createLowPass":
                return low_pass(*args)
            case "string":
                return self.to_text(args[0], ctx) if column else text_of(args[0])
            case "float":
                return args[0].cast("double") if column else float(args[0])
            case "int":
                return args[0].cast("bigint") if column else int(args[0])
            case "round":
                return S.round_(args[0]) if column else int(math.copysign(math.floor(abs(args[0]) + 0.5), args[0]))
            case "abs":
                return F.abs(args[0]) if column else abs(args[0])
            case "sqr":
                return args[0] * args[0] if column else V.BINARY["*"](args[0], args[0])
            case "sign":
                return S.sign(args[0], whole) if column else type(args[0])((args[0] > 0) - (args[0] < 0))
            case "isInt" | "isFloat":
                return whole == (name == "isInt") and ctx.kind(args[0]) in ("bigint", "int", "double", "float")
            case "min" | "max":
                return (S.least if name == "min" else S.greatest)(*args) if column else (min if name == "min" else max)(args)
            case "binAnd" | "binOr":
                a, b = args
                return (S.col(a).bitwiseAND(b) if name == "binAnd" else S.col(a).bitwiseOR(b)) if column else a & b if name == "binAnd" else a | b
            case "numbers":
                return list(range(args[0]))
            case "goto":
                return {"state": args[0]}
            case "bisection":
                return Q.bisection(*args)
            case "sprintf":
                return F.format_string(args[0].replace("%v", "%s"), *args[1:]) if column else args[0].replace("%v", "%s") % tuple(text_of(a) if isinstance(a, float | bool | list) and "%v" in args[0] else a for a in args[1:]) if args else ""
        raise LanguageError(f"no function {name} in line {line}")

    def method(self, v: Any, name: str, args: list, ctx: Context, line: int) -> Any:
        if isinstance(v, dict) and callable(v.get(name)):
            return v[name](*args)
        if isinstance(v, tuple) and v and v[0] == "values":
            return self.of_group(v[1], name, args, line)
        if isinstance(v, Table) and ctx.df is not None and name in ("present", "accept"):
            other = _renamed(v)
            test = args[0](Record(other, "_other_"), context=Context(ctx.df.join(other, F.lit(True))))
            return (Exists if name == "present" else Matches)(v, other, test)
        if isinstance(v, Matches):
            if name == "map":
                return Matches(v.table, v.other, v.test, args[0](Record(v.other, "_other_"), context=Context(v.other)))
            if name == "size" or name in ("sum", "mean", "min", "max") and v.value is not None:
                return Matches(v.table, v.other, v.test, v.value, name)
            raise LanguageError(f"no method {name} of the matches of a row in line {line}")
        if isinstance(v, Interpolation) and name in ("args", "invoke"):
            return 1 if name == "args" else v(*args[0])
        if self.language and (f := self.language.method(self.kind(v, ctx) if isinstance(v, Column) and ctx.df is not None else V.kind(v), name)):
            return f(v, *args)
        if isinstance(v, Record):
            v = fields_of(v)
        if isinstance(v, dict) and any(isinstance(x, Column) for x in v.values()) and name in ("list", "string"):
            if name == "list":
                alike = len({ctx.kind(x) for x in v.values()}) == 1  # else values are texts, as an array has one type
                return F.array(*[F.struct(F.lit(k).alias("key"), (S.col(x) if alike else self.to_text(x, ctx)).alias("value")) for k, x in v.items()])
            parts = [F.concat(F.lit(f"{k}:"), self.to_text(x, ctx)) for k, x in v.items()]
            return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
        for kind, table in ((Table, self.of_table), (Grouped, self.of_grouped), (Column, self.of_column), (list, of_list), (str, of_text), (dict, of_map)):
            if isinstance(v, kind):
                return table(v, name, args, ctx) if kind in (Table, Grouped, Column) else table(v, name, args)
        if name == "string":
            return text_of(v)
        if callable(v) and name in ("args", "invoke"):
            return v.arity if name == "args" else v(*args[0])
        raise LanguageError(f"no method {name} in line {line}")

    def row(self, f: Callable, t: Table) -> Callable:
        return lambda r: f(r, context=Context(t.df))

    def of_group(self, g: Group, name: str, args: list, line: int) -> Column:
        record = Record(g.base.df)
        inner = Context(g.base.df)
        match name:
            case "accept":
                test = args[0](record, context=inner)
                return ("values", Group(g.base, g.noted, test if g.only is None else g.only & test))
            case "size":
                return g.aggregate(F.count(g.those(F.lit(1))))
            case "present":
                return g.aggregate(F.coalesce(F.bool_or(g.those(args[0](record, context=inner))), F.lit(False)))
            case "map":
                return _Mapped(g, g.those(args[0](record, context=inner)))
        raise LanguageError(f"values.{name} is no aggregate in line {line}")

    def of_grouped(self, g: Grouped, name: str, args: list, ctx: Context) -> Any:
        if name in ("order", "orderRev", "accept"):
            return g.then(name, args[0])
        if name == "map":
            return g.table(args[0])
        return self.of_table(g.table(), name, args, ctx)

    def of_table(self, t: Table, name: str, args: list, ctx: Context) -> Any:
        f = self.row(args[0], t) if args and callable(args[0]) else None
        match name:
            case "accept":
                made = f(Record(t.df))
                return made.filter(t) if isinstance(made, Exists) else t.accept(lambda _: S.col(made))
            case "map":
                return self.mapped(t, f(Record(t.df)))
            case "sum" | "mean" | "min" | "max":
                column = F.col(only_column(t))
                return t.aggregate(value={"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[name](column))
            case "reduce" | "mapReduce" | "visit":
                return self.folded(t, args[-1], None if name == "reduce" else args[0])
            case "append":
                return appended(t, self.record(args[0]))
            case "set":
                return t.set(args[0], **{k: as_column(v) for k, v in self.record(args[1]).items()})
            case "orderLess":
                body, param, reverse = key_of_less(args[0])
                return t.sort(lambda r: self.eval(body, {**self.bindings, param: r}, Context(t.df)), reverse=reverse)
            case "merge":
                body, _, reverse = key_of_less(args[1])
                if body.kind != "field" or reverse:
                    raise LanguageError("merge of tables needs (a,b)->a.key<b.key")
                return t.merge(args[0], body.value)
            case "iir" | "iirCombine" | "iirApply":
                initial, follow = (args[0]["initial"], args[0]["filter"]) if name == "iirApply" else args
                return self.recursive(t, initial, follow, pairs=name != "iir")
            case "fsm":
                return self.machine(t, args[0])
            case "linearReg":
                x, y = (g(Record(t.df), context=Context(t.df)) for g in args)
                return t.linear_regression(lambda _: x, lambda _: y)
            case "createInterpolation":
                x, y = (g(Record(t.df), context=Context(t.df)) for g in args)
                return Interpolation.of(t.df.select(x.cast("double").alias("x"), y.cast("double").alias("y")))
            case "binning":
                index, value = (S.col(g(Record(t.df), context=Context(t.df))) for g in args[3:])
                return t.binning(*args[:3], lambda _: index, lambda _: value)
            case "binning2d":
                x, y, value = (S.col(g(Record(t.df), context=Context(t.df))) for g in args[6:])
                return t.binning2d(tuple(args[:3]), tuple(args[3:6]), lambda _: x, lambda _: y, lambda _: value)
            case "order" | "orderRev":
                return t.sort(f, reverse=name == "orderRev")
            case "reverse":
                return t.reverse()
            case "top" | "skip":
                return getattr(t, name)(args[0])
            case "groupByString":
                return Grouped(t, self.to_text(f(Record(t.df)), Context(t.df)))
            case "groupByInt":
                return Grouped(t, f(Record(t.df)).cast("bigint"))
            case "groupByEqual":
                return Grouped(t, f(Record(t.df)), first_seen=True)
            case "uniqueString" | "uniqueInt":
                return t.unique(lambda r: self.to_text(f(r), Context(t.df)) if name == "uniqueString" else f(r).cast("bigint"))
            case "compact":
                body, param, _ = key_of_less(args[0], "=")
                return t.compact(lambda r: self.eval(body, {**self.bindings, param: r}, Context(t.df)))
            case "size":
                return t.size()
            case "first" | "last" | "single":
                return getattr(t, name)()
            case "present":
                return t.present(f)
            case "indexWhere":
                return t.index_where(f)
            case "replaceList":
                return args[0](t)
            case "eval":
                return Table(t.df.cache(), t.order, t.by)
            case "number":
                if not args:
                    return t.number()
                numbered = t.number("_number")
                return self.mapped(numbered, args[0](F.col("_number"), Record(t.df), context=Context(numbered.df)))
            case "minMax":
                return t.min_max(f, lambda _: F.struct(*t.df.columns))
            case "combine" | "combine3":
                n = 2 if name == "combine" else 3
                return t.combine(n, lambda get: self.record(args[0](*(_Neighbour(get, k, t.df) for k in range(n)), context=Context(t.df))))
            case "combineN":
                return t.combine(args[0], lambda get: self.record(args[1]([_Neighbour(get, k, t.df) for k in range(args[0])], context=Context(t.df))))
            case "cross":
                other = args[0]

                def make(a: Record, b: Record) -> dict[str, Column]:
                    places = {f"_a{k}": F.col(f"a_{c}") for k, c in enumerate(t.order)} | {f"_b{k}": F.col(f"b_{c}") for k, c in enumerate(other.order)}
                    return places | self.record(args[1](a, b, context=Context(a._df.crossJoin(b._df))))

                return Table(t.cross(other, make), (*(f"_a{k}" for k in range(len(t.order))), *(f"_b{k}" for k in range(len(other.order)))))
            case "multiUse":
                group = Group(t, noted := {})
                made = {k: use(("values", group), context=Context(t.df)) for k, use in args[0].items()}
                return t.df.groupBy(*t.by).agg(*[c.alias(k) for k, c in noted.items()]).select(*t.by, *[c.alias(k) for k, c in made.items()])
        raise LanguageError(f"no method {name} of a table")

    def mapped(self, t: Table, made: Any) -> Table:
        """The rows that a function makes; order and series columns that it doesn't make are kept aside, so the order stays."""
        columns = self.record(made)
        aside = {c: f"_o_{c}" for c in (*t.by, *t.order) if c not in columns or isinstance(t, Sorted)}
        matches = {k: c for k, c in columns.items() if isinstance(c, Matches)}
        if not matches:
            df = t.df.select(*[S.col(c).alias(k) for k, c in columns.items()], *[F.col(c).alias(x) for c, x in aside.items()])
        else:
            numbered = t.df.withColumn("_row", F.monotonically_increasing_id())
            one = next(iter(matches.values()))
            if any(str(m.test) != str(one.test) or m.table is not one.table for m in matches.values()):
                raise LanguageError("one map can look up one list by one condition")
            joined = numbered.join(one.other, one.test, "left").groupBy("_row")
            df = joined.agg(*[(c.column() if k in matches else F.first(S.col(c))).alias(k) for k, c in columns.items()], *[F.first(c).alias(x) for c, x in aside.items()]).drop("_row")
        order = tuple(aside.get(c, c) for c in t.order)
        by = tuple(aside.get(c, c) for c in t.by)
        return Sorted(df, aside.get(t.key, t.key), t.reversed, tuple(c for c in order if c != aside.get(t.key, t.key)) if t.key else order, by) if isinstance(t, Sorted) else Table(df, order, by)

    def folded(self, t: Table, f: Callable, start: Any):
        """reduce, mapReduce and visit: a general fold, so the series is one array of its row, in order."""
        names = [c for c in t.df.columns if c not in t.by and not c.startswith("_o_")]
        single = names == ["value"]
        item = F.col("value") if single else F.struct(*names)
        items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*t.order).alias("at"), item.alias("item")))), lambda x: x["item"])
        df = t.df.groupBy(*t.by).agg(items.alias("items"))
        first = item if start is None else F.lit(start).cast("bigint") if V.kind(start) == "int" else as_column(start)
        noted: list[str] = []
        pair = t.df.select(first.alias("_acc"), item.alias("_item"))
        made = as_column(f(F.col("_acc"), F.col("_item"), context=Context(pair, noted)))
        if isinstance(start, int) and pair.select(made.alias("x")).schema["x"].dataType.simpleString() in ("double", "float"):
            first, noted = first.cast("double"), []
            pair = t.df.select(first.alias("_acc"), item.alias("_item"))
            f(F.col("_acc"), F.col("_item"), context=Context(pair, noted))
        rest = F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))) if start is None else F.col("items")
        begin = F.element_at("items", 1) if start is None else first
        empty = S.failing(F.size("items") == 0, "the list is empty", F.lit(True)) if start is None else F.lit(True)
        return df.where(empty).select(*t.by, F.aggregate(rest, begin, lambda a, x: as_column(f(a, x, context=Context(df, told=list(noted))))).alias("value"))

    def recursive(self, t: Table, initial: Callable, follow: Callable, pairs: bool) -> Table:
        """iir and its kin by general functions: an ordered scan per series, with the language's own functions on constants."""
        inner = Context(t.df)
        names = [c for c in t.df.columns if not c.startswith("_o_")]
        made = self.record(initial(Record(t.df), context=inner))
        schema = t.df.select(*[S.col(c).alias(k) for k, c in made.items()]).schema
        whole = list(schema.names) != ["value"] or isinstance(initial(Record(t.df), context=inner), dict | Record)

        return self.scanned(t, names, schema, recursive_step(names, schema, portable(initial), portable(follow), pairs, whole))

    def machine(self, t: Table, f: Callable) -> Table:
        """fsm: the state after each item, beside the item's fields. The state begins as {state: 0}."""
        used, pure = fields_used(f, 1)
        names = [c for c in t.df.columns if not c.startswith("_o_") and (used is None or c in used)]
        return self.scanned(t, names, StructType().add("state", "long"), machine_step(names, portable(f), pure and used is not None), keep=True)

    def scanned(self, t: Table, names: list[str], schema: StructType, step: Callable, keep: bool = False) -> Table:
        if not t.order:
            raise LanguageError("this needs a list with an order")
        aside = {c: c if keep else f"_o_{c}" for c in (*t.by, *t.order)}
        df = t.df.select("*", *[F.col(c).alias(x) for c, x in aside.items() if x != c])
        kept = [c for c in t.df.columns if c not in schema.names] if keep else list(aside.values())
        return Table(Q.ordered_scan(df, list(t.by), list(t.order), names, kept, schema, step), tuple(aside[c] for c in t.order), tuple(aside[c] for c in t.by))

    def record(self, made: Any) -> dict[str, Any]:
        """The columns of a made item; a value that is no map gets the name value."""
        made = fields_of(made) if isinstance(made, Record) else made
        columns = made if isinstance(made, dict) else {"value": made}
        return {k: c if isinstance(c, Column | Matches) else as_column(c) for k, c in columns.items()}

    def of_column(self, c: Column, name: str, args: list, ctx: Context) -> Column:
        if isinstance(c, _Mapped):
            return c.method(name)
        simple = {"len": S.byte_len, "trim": S.trim, "toLower": F.lower, "toUpper": F.upper, "toInt": S.to_int, "toFloat": S.to_float, "size": lambda x: F.size(x).cast("bigint"), "reverse": F.reverse, "first": lambda x: F.element_at(x, 1), "last": lambda x: F.element_at(x, -1), "max": F.array_max, "min": F.array_min}
        if name in simple:
            return simple[name](c)
        if name == "string":
            return self.to_text(c, ctx)
        with_args = {"contains": lambda x, a: F.contains(x, S.col(a)), "indexOf": S.index_of, "split": S.split, "cut": S.cut, "behind": S.behind, "behindList": S.behind_list, "replace": S.replace, "accept": lambda x, f: F.filter(x, lambda e: f(e)), "map": lambda x, f: F.transform(x, lambda e: f(e)), "present": lambda x, f: F.exists(x, lambda e: f(e)), "mapReduce": lambda x, s, f: F.aggregate(x, S.col(s), lambda a, e: f(a, e)), "top": lambda x, n: F.slice(x, 1, n), "skip": lambda x, n: F.slice(x, n + 1, 2**31 - 1), "append": F.array_append}
        if name in with_args:
            return with_args[name](c, *args)
        raise LanguageError(f"no method {name} of a column")


#: The name under which an expression's implicit row is bound.
ROW = "this row"


def fields_of(r: Record) -> dict[str, Column]:
    return {c.removeprefix(r._prefix): F.col(c) for c in r._df.columns if c.startswith(r._prefix) and not c.startswith("_o_")}


def as_column(v: Any) -> Column:
    """Lists as arrays, maps as structs."""
    if isinstance(v, Column):
        return v
    if isinstance(v, Record):
        v = fields_of(v)
    if isinstance(v, dict):
        return F.struct(*[as_column(x).alias(k) for k, x in v.items()])
    return F.array(*map(as_column, v)) if isinstance(v, list) else F.lit(v)


def recursive_step(names: list[str], schema: StructType, initial: Callable, follow: Callable, pairs: bool, whole: bool) -> Callable:
    """A step of Q.ordered_scan: the state is the item before and the last result."""

    def step(state, *values):
        item = dict(zip(names, values, strict=True))
        if state is None:
            last = initial(item)
        else:
            last = follow(state[0], item, state[1]) if pairs else follow(item, state[1])
        return (item, last), tuple(convert(last[f.name] if whole else last, f.dataType) for f in schema)

    return step


#: Transitions of a state machine that a worker remembers; beyond it, it starts anew.
MOST_KNOWN = 100_000


def fields_used(f: Callable, k: int) -> tuple[set[str] | None, bool]:
    """The fields that a function reads of its k-th argument (None: perhaps all), and whether equal arguments give equal
    results."""
    node = getattr(f, "node", None)
    if node is None or len(node.value) <= k:
        return None, False
    param, fields, bare, pure = node.value[k], set(), False, True

    def seen(n: Node) -> bool | None:
        nonlocal bare, pure
        if n.kind == "field" and n.parts[0].kind == "name" and n.parts[0].value == param:
            fields.add(n.value)
            return False
        bare |= n.kind == "name" and n.value == param or n.kind in ("lambda", "func", "let")
        pure &= not (n.kind == "call" and (n.parts[0].kind != "name" or n.parts[0].value not in ("goto", "abs", "int", "float", "string", "round", "min", "max")))
        return None

    visit(node.parts[0], seen)
    return None if bare else fields, pure


def machine_step(names: list[str], f: Callable, known: bool) -> Callable:
    """known: the next state follows from the state and the fields alone, so transitions are remembered."""
    table: dict[tuple, dict] = {}

    def step(state, *values):
        state = {"state": 0} if state is None else state
        key = (*state.items(), values) if known and all(isinstance(x, bool | int | float | str) for x in state.values()) else None
        if key is None or (after := table.get(key)) is None:
            after = f(state, dict(zip(names, values, strict=True)))
            if key is not None:
                if len(table) >= MOST_KNOWN:
                    table.clear()
                table[key] = after
        return after, (after["state"],)

    return step


def convert(v: Any, kind: Any) -> Any:
    return float(v) if kind.simpleString() in ("double", "float") and isinstance(v, int) else v


def only_column(t: Table) -> str:
    names = [c for c in t.df.columns if not c.startswith("_o_")]
    if names != ["value"]:
        names = [c for c in names if c not in (*t.order, *t.by)]
    if len(names) != 1:
        raise LanguageError(f"a list of single values is needed; there are {', '.join(names)}")
    return names[0]


def appended(t: Table, item: dict[str, Column]) -> Table:
    """t with an item behind its last one. Order columns that the item lacks are null, which comes after _src."""
    one = t.df.sparkSession.range(1).select(*[as_column(c).alias(k) for k, c in item.items()])
    both = t.df.withColumn("_src", F.lit(0)).unionByName(one.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return t._with(both, ("_src", *t.order))


def key_of_less(f: Callable, op: str = "<") -> tuple[Node, str, bool]:
    """From (a,b)->key(a)<key(b): the key's tree, its parameter, and whether the order is reversed."""
    node = getattr(f, "node", None)
    if node is None or len(node.value) != 2 or node.parts[0].kind != "op" or node.parts[0].value not in (op, ">" if op == "<" else op):
        raise LanguageError(f"tables need (a,b)->key(a){op}key(b) here")
    a, b = node.value
    left, right = node.parts[0].parts

    def renamed(n: Node, old: str, new: str) -> Node:
        return Node(n.kind, new if n.kind == "name" and n.value == old else n.value, tuple(renamed(x, old, new) for x in n.parts), 0)

    reverse = node.parts[0].value == ">"
    for x, y in ((a, b), (b, a)):
        if renamed(left, x, "x") == renamed(right, y, "x") and renamed(left, y, "?") == renamed(left, "?", "?"):
            return left, x, reverse != (x == b)
    raise LanguageError("both sides must be the same key")


class LowPass:
    """A first-order low-pass; items get the field name."""

    def __init__(self, name: str, time: Callable, value: Callable, tau: float):
        self.name, self.time, self.value, self.tau = name, time, value, tau

    def initial(self, item: Any, context: Context | None = None) -> dict:
        v = self.value(item, context=context) if context else self.value(item)
        return (fields_of(item) if isinstance(item, Record) else item) | {self.name: v.cast("double") if isinstance(v, Column) else float(v)}

    def follow(self, before: dict, item: dict, last: dict) -> dict:
        x = self.value(item)
        return item | {self.name: x + (last[self.name] - x) * math.exp(-(self.time(item) - self.time(before)) / self.tau)}


def low_pass(name: str, time: Callable, value: Callable, tau: float) -> dict[str, Callable]:
    """createLowPass: initial and filter for iirApply."""
    made = LowPass(name, time, value, tau)
    return {"initial": made.initial, "filter": made.follow}


class _Neighbour:
    """The row that lies k behind this one, by field."""

    def __init__(self, get: Callable, k: int, df):
        self._get, self._k, self._df = get, k, df

    def __getitem__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise KeyError(f"no field {name!r}; there are {', '.join(self._df.columns)}")
        return self._get(name, self._k)

    __getattr__ = __getitem__


class _Mapped(Column):
    """values.map(f) of a group, until an aggregate follows."""

    def __new__(cls, group: Group, column: Column):
        return object.__new__(cls)

    def __init__(self, group: Group, column: Column):
        self.group, self.column = group, column

    def method(self, name: str) -> Column:
        f = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "size": F.count}.get(name)
        if f is None:
            raise LanguageError(f"values.map(...).{name} is no aggregate")
        return self.group.aggregate(f(self.column))


def _grouped(rows: list, key: Callable, convert: Callable) -> list:
    out: list[dict] = []
    for r in rows:
        k = convert(key(r))
        found = next((g for g in out if g["key"] == k), None)
        if found is None:
            out.append({"key": k, "values": [r]})
        else:
            found["values"].append(r)
    return out


def _fold_all(rows: list, f: Callable) -> Any:
    if not rows:
        raise LanguageError("the list is empty")
    return functools.reduce(f, rows)


def of_list(v: list, name: str, args: list) -> Any:
    f = args[0] if args and callable(args[0]) else None
    plus, before = V.plus, V.less
    table: dict[str, Callable] = {
        "accept": lambda: [x for x in v if f(x)], "map": lambda: [f(x) for x in v], "number": lambda: [f(k, x) for k, x in enumerate(v)], "size": lambda: len(v),
        "present": lambda: any(f(x) for x in v), "indexWhere": lambda: next((k for k, x in enumerate(v) if f(x)), -1), "reverse": lambda: v[::-1], "top": lambda: v[: args[0]], "skip": lambda: v[args[0] :],
        "order": lambda: sorted(v, key=f), "orderRev": lambda: sorted(v, key=f, reverse=True), "orderLess": lambda: sorted(v, key=functools.cmp_to_key(lambda a, b: -1 if f(a, b) else 1 if f(b, a) else 0)),
        "reduce": lambda: _fold_all(v, f), "mapReduce": lambda: functools.reduce(args[1], v, args[0]), "visit": lambda: functools.reduce(args[1], v, args[0]), "sum": lambda: _fold_all(v, plus), "mean": lambda: V.divide(_fold_all(v, plus), len(v)),
        "min": lambda: _fold_all(v, lambda a, b: b if before(b, a) else a), "max": lambda: _fold_all(v, lambda a, b: b if before(a, b) else a), "first": lambda: _fold_all(v, lambda a, b: a), "last": lambda: _fold_all(v, lambda a, b: b),
        "single": lambda: v[0] if len(v) == 1 else _fail(f"the list has {len(v)} items"), "append": lambda: [*v, args[0]], "set": lambda: [args[1] if k == args[0] else x for k, x in enumerate(v)] if 0 <= args[0] < len(v) else _fail("index out of range"),
        "combine": lambda: [f(a, b) for a, b in zip(v, v[1:], strict=False)], "combine3": lambda: [f(*x) for x in zip(v, v[1:], v[2:], strict=False)], "combineN": lambda: [args[1](v[k : k + args[0]]) for k in range(len(v) - args[0] + 1)],
        "iir": lambda: Q.iir(v, args[0], args[1]), "iirCombine": lambda: Q.iir_combine(v, args[0], args[1]), "iirApply": lambda: Q.iir_combine(v, args[0]["initial"], args[0]["filter"]), "fsm": lambda: Q.fsm(v, f), "compact": lambda: Q.compact(v, f),
        "movingWindow": lambda: Q.moving_window(v, f), "movingWindowRemove": lambda: Q.moving_window_remove(v, f), "cross": lambda: [args[1](a, b) for a in v for b in args[0]], "merge": lambda: Q.merge(v, args[0], args[1]),
        "groupByString": lambda: _grouped(v, f, text_of), "groupByInt": lambda: _grouped(v, f, int), "groupByEqual": lambda: _grouped(v, f, lambda x: x), "uniqueString": lambda: [g["key"] for g in _grouped(v, f, text_of)], "uniqueInt": lambda: [g["key"] for g in _grouped(v, f, int)],
        "replaceList": lambda: f(v), "eval": lambda: v, "string": lambda: text_of(v), "multiUse": lambda: {k: g(v) for k, g in args[0].items()},
        "linearReg": lambda: _regression([(float(args[0](x)), float(args[1](x))) for x in v]), "createInterpolation": lambda: Interpolation([(float(args[0](x)), float(args[1](x))) for x in v]),
        "binning": lambda: _histogram(v, *args), "collectBinning": lambda: [functools.reduce(V.BINARY["+"], x) for x in zip(*v, strict=True)],
        "minMax": lambda: {"min": min(map(f, v)), "max": max(map(f, v)), "minItem": min(v, key=f), "maxItem": max(v, key=f), "valid": True} if v else {"min": 0, "max": 0, "minItem": 0, "maxItem": 0, "valid": False},
    }
    return table[name]() if name in table else _fail(f"no method {name} of a list")


def _regression(points: list[tuple[float, float]]) -> dict[str, Any]:
    n = len(points)
    mx, my = (sum(p[k] for p in points) / n if n else math.nan for k in (0, 1))
    spread = sum((x - mx) ** 2 for x, _ in points)
    a = sum((x - mx) * (y - my) for x, y in points) / spread if n > 1 and spread else math.nan
    b = my - a * mx

    def line(x: Any) -> Any:
        return a * x + b

    line.arity = 1
    return {"a": a, "b": b, "lineFunc": line}


def _histogram(v: list, start: float, size: float, count: int, index: Callable, value: Callable) -> list[float]:
    bins = [0.0] * (count + 2)
    for x in v:
        bins[min(max(math.floor((index(x) - start) / size) + 1, 0), count + 1)] += value(x)
    return bins


def _fail(message: str) -> Any:
    raise LanguageError(message)


def _behind_list(s: str, header: str) -> list[str]:
    lines = [x.strip() for x in s.split("\n")]
    rest = lines[lines.index(header) + 1 :] if header in lines else []
    return rest[: rest.index("")] if "" in rest else rest


def of_text(s: str, name: str, args: list) -> Any:
    def behind(prefix: str) -> str:
        return next((line.partition(prefix)[2].strip() for line in s.split("\n") if prefix in line), "")

    table: dict[str, Callable] = {
        "len": lambda: len(s.encode()), "string": lambda: s, "trim": s.strip, "toLower": s.lower, "toUpper": s.upper, "contains": lambda: args[0] in s, "indexOf": lambda: s.encode().find(args[0].encode()), "split": lambda: s.split(args[0]),
        "behindList": lambda: _behind_list(s, args[0]),
        "cut": lambda: s[max(args[0], 0) :][: args[1] if args[1] > 0 else None], "replace": lambda: s.replace(*args), "behind": lambda: behind(args[0]), "toInt": lambda: int(s) if s.strip() == s else _fail("not an integer"), "toFloat": lambda: float(s) if s.strip() == s else _fail("not a number"),
    }
    return table[name]() if name in table else _fail(f"no method {name} of a string")


def of_map(m: dict, name: str, args: list) -> Any:
    table: dict[str, Callable] = {
        "size": lambda: len(m), "string": lambda: text_of(m), "list": lambda: [{"key": k, "value": x} for k, x in m.items()], "accept": lambda: {k: x for k, x in m.items() if args[0](k, x)}, "map": lambda: {k: args[0](k, x) for k, x in m.items()},
        "isAvail": lambda: all(k in m for k in args), "get": lambda: m[args[0]] if args[0] in m else _fail(f"no key {args[0]}"), "put": lambda: _fail(f"{args[0]} is there") if args[0] in m else {args[0]: args[1], **m},
        "replace": lambda: m | {k: x for k, x in args[0](m).items() if k in m}, "combine": lambda: {k: args[1](x, args[0][k]) if k in args[0] else _fail(f"no key {k}") for k, x in m.items()}, "replaceMap": lambda: args[0](m), "eval": lambda: dict(m),
    }
    return table[name]() if name in table else _fail(f"no method {name} of a map")


def run_text(text: str, bindings: dict[str, Any] | None = None, functions: dict[str, Callable] | None = None, language: Any = None) -> Any:
    """Compiles and evaluates a text; tables and scalars enter by name."""
    return Compiler(bindings or {}, functions, language).run(text)

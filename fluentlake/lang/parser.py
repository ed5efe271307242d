"""Text to syntax tree. Every binary operator has a priority of its own, in the order of OPERATORS, lowest first, and all
associate to the left; a unary minus binds looser than * and ^."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

OPERATORS = ["|", "&", "=", "!=", "~", "<", ">", "<=", ">=", "+", "-", "<<", ">>", "*", "%", "/", "^"]
KEYWORDS = {"let", "func", "if", "then", "else", "switch", "case", "default", "const", "try", "catch"}
UNICODE = {"•": "*", "×": "*", "÷": "/", "–": "-", "ˆ": "^"}
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


class LanguageError(Exception):
    """An error of the text, with its line."""


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    line: int


@dataclass(frozen=True)
class Node:
    kind: str
    value: Any = None
    parts: tuple = ()
    line: int = 0


@dataclass(frozen=True)
class Grammar:
    """What a text may have. operators: binary ones, each with a priority of its own, lowest first. comments: // and /* */.
    comfort: 2x, 2(x) and (a)(b) are products. text_operators: words that stand for operators. keywords: other names for
    some of KEYWORDS."""

    operators: tuple[str, ...] = tuple(OPERATORS)
    comments: bool = True
    comfort: bool = False
    text_operators: tuple[tuple[str, str], ...] = ()
    keywords: tuple[tuple[str, str], ...] = ()

    def pattern(self) -> re.Pattern:
        signs = sorted({*self.operators, "->", "!", "-", *UNICODE}, key=lambda x: (-len(x), x))
        comment = r"(?P<comment>//[^\n]*|/\*.*?\*/)|" if self.comments else ""
        number = r"(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
        return re.compile(rf"\s*(?:{number}|(?P<super>[{SUPERSCRIPTS}]+)|(?P<name>[^\W\d](?:(?![{SUPERSCRIPTS}])\w)*)|'(?P<quoted>[^']*)'|\"(?P<text>(?:[^\"\\]|\\.)*)\"|{comment}(?P<op>{'|'.join(map(re.escape, signs))})|(?P<mark>[()\[\]{{}},;:.]))", re.S)


def tokens(text: str, grammar: Grammar = Grammar()) -> list[Token]:  # noqa: B008
    out, at, pattern = [], 0, grammar.pattern()
    words, renamed = dict(grammar.text_operators), dict(grammar.keywords)
    keys = {renamed.get(k, k): k for k in KEYWORDS}
    end = len(text.rstrip())
    while at < end:
        m = pattern.match(text, at)
        if not m:
            raise LanguageError(f"unexpected {text[at:].strip()[:1]!r} in line {text.count(chr(10), 0, at) + 1}")
        at = m.end()
        line = text.count("\n", 0, at) + 1
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "comment":
            continue
        if kind == "super":
            out.append(Token("op", "^", line))
            kind, value = "number", "".join(str(SUPERSCRIPTS.index(c)) for c in value)
        elif kind == "quoted":
            kind = "name"
        elif kind == "name" and value in words:
            kind, value = "op", words[value]
        elif kind == "name" and value in keys:
            kind, value = "key", keys[value]
        elif kind == "op":
            value = UNICODE.get(value, value)
        elif kind == "text":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e[1], e[1]), value)
        if grammar.comfort and out and (kind in ("name", "number") or (kind, value) == ("mark", "(")):
            last = out[-1]
            if last.kind == "number" or (last.kind, last.value) == ("mark", ")") and value != ".":
                out.append(Token("op", "*", line))
        out.append(Token(kind, value, line))
    return [*out, Token("end", "", text.count("\n") + 1)]


class Parser:
    def __init__(self, text: str, grammar: Grammar = Grammar()):  # noqa: B008
        self.items, self.at, self.operators = tokens(text, grammar), 0, grammar.operators

    def peek(self, ahead: int = 0) -> Token:
        return self.items[min(self.at + ahead, len(self.items) - 1)]

    def next(self) -> Token:
        self.at += 1
        return self.items[self.at - 1]

    def has(self, kind: str, value: str | None = None) -> bool:
        return self.peek().kind == kind and (value is None or self.peek().value == value)

    def take(self, kind: str, value: str | None = None) -> Token | None:
        return self.next() if self.has(kind, value) else None

    def need(self, kind: str, value: str | None = None) -> Token:
        if not self.has(kind, value):
            raise LanguageError(f"expected {value or kind}, found {self.peek().value!r} in line {self.peek().line}")
        return self.next()

    def parse(self) -> Node:
        node = self.body()
        self.need("end")
        return node

    def body(self) -> Node:
        if t := self.take("key", "let"):
            name = self.need("name").value
            self.need("op", "=")
            value = self.expression()
            self.need("mark", ";")
            return Node("let", name, (value, self.body()), t.line)
        if t := self.take("key", "const"):
            name = self.need("name").value
            self.need("op", "=")
            value = self.expression()
            self.need("mark", ";")
            return Node("let", name, (value, self.body()), t.line)
        if t := self.take("key", "func"):
            name = self.need("name").value
            self.need("mark", "(")
            params = self.names()
            value = self.expression()
            self.need("mark", ";")
            return Node("func", (name, params), (value, self.body()), t.line)
        return self.expression()

    def names(self) -> tuple[str, ...]:
        out = []
        while not self.take("mark", ")"):
            out.append(self.need("name").value)
            self.take("mark", ",")
        return tuple(out)

    def expression(self) -> Node:
        return self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(self.operators):
            return self.unary()
        left = self.binary(level + 1)
        while self.has("op", self.operators[level]):
            t = self.next()
            left = Node("op", t.value, (left, self.binary(level + 1)), t.line)
        return left

    def unary(self) -> Node:
        if t := self.take("op", "-"):
            return Node("neg", None, (self.binary(self.operators.index("*")),), t.line)
        if t := self.take("op", "!"):
            return Node("not", None, (self.postfix(),), t.line)
        return self.postfix()

    def postfix(self) -> Node:
        node = self.literal()
        while True:
            t = self.peek()
            if self.take("mark", "."):
                name = self.need("name").value
                if self.take("mark", "("):
                    node = Node("method", name, (node, *self.arguments(")")), t.line)
                else:
                    node = Node("field", name, (node,), t.line)
            elif self.take("mark", "("):
                node = Node("call", None, (node, *self.arguments(")")), t.line)
            elif self.take("mark", "["):
                index = self.expression()
                self.need("mark", "]")
                node = Node("index", None, (node, index), t.line)
            else:
                return node

    def arguments(self, close: str) -> tuple[Node, ...]:
        out = []
        while not self.take("mark", close):
            out.append(self.expression())
            if not self.has("mark", close):
                self.need("mark", ",")
        return tuple(out)

    def literal(self) -> Node:
        t = self.next()
        if t.kind == "number":
            return Node("const", int(t.value) if t.value.isdigit() else float(t.value), (), t.line)
        if t.kind == "text":
            return Node("const", t.value, (), t.line)
        if t.kind == "name":
            if self.take("op", "->"):
                return Node("lambda", (t.value,), (self.expression(),), t.line)
            return Node("const", t.value == "true", (), t.line) if t.value in ("true", "false") else Node("name", t.value, (), t.line)
        if t.kind == "mark" and t.value == "(":
            k = 0
            while self.peek(k).kind == "name" and self.peek(k + 1).value == ",":
                k += 2
            if self.peek(k).kind == "name" and self.peek(k + 1).value == ")" and self.peek(k + 2).value == "->":
                params = self.names()
                self.next()
                return Node("lambda", params, (self.expression(),), t.line)
            inner = self.body()
            self.need("mark", ")")
            return inner
        if t.kind == "mark" and t.value == "[":
            return Node("list", None, self.arguments("]"), t.line)
        if t.kind == "mark" and t.value == "{":
            keys, values = [], []
            while not self.take("mark", "}"):
                keys.append(self.need("name").value)
                self.need("mark", ":")
                values.append(self.expression())
                if not self.has("mark", "}"):
                    self.need("mark", ",")
            if len(set(keys)) < len(keys):
                raise LanguageError(f"a key occurs twice in line {t.line}")
            return Node("map", tuple(keys), tuple(values), t.line)
        if t.kind == "key" and t.value == "if":
            test = self.expression()
            self.need("key", "then")
            yes = self.expression()
            self.need("key", "else")
            return Node("if", None, (test, yes, self.expression()), t.line)
        if t.kind == "key" and t.value == "switch":
            parts = [self.expression()]
            while self.take("key", "case"):
                parts.append(self.expression())
                self.need("mark", ":")
                parts.append(self.expression())
            self.need("key", "default")
            return Node("switch", None, (*parts, self.expression()), t.line)
        if t.kind == "key" and t.value == "try":
            value = self.expression()
            self.need("key", "catch")
            return Node("try", None, (value, self.expression()), t.line)
        raise LanguageError(f"unexpected {t.value!r} in line {t.line}")


def parse(text: str, grammar: Grammar = Grammar()) -> Node:  # noqa: B008
    return Parser(text, grammar).parse()


def visit(node: Node, seen: Callable[[Node], bool | None]) -> None:
    """Calls seen for each node, parents first; where it returns False, the parts are left out."""
    if seen(node) is not False:
        for x in node.parts:
            visit(x, seen)


def rewrite(node: Node, change: Callable[[Node], Node | None]) -> Node:
    """The tree with every node replaced by what change makes of it (None: itself), parts first."""
    node = Node(node.kind, node.value, tuple(rewrite(x, change) for x in node.parts), node.line)
    return change(node) or node


def pretty(node: Node) -> str:
    """Source text of a tree."""
    p = [pretty(x) for x in node.parts]
    match node.kind:
        case "const":
            return '"' + node.value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(node.value, str) else str(node.value).lower() if isinstance(node.value, bool) else str(node.value)
        case "name":
            return node.value
        case "op":
            return f"({p[0]}{node.value}{p[1]})"
        case "neg":
            return f"(-{p[0]})"
        case "not":
            return f"!{p[0]}"
        case "field":
            return f"{p[0]}.{node.value}"
        case "method":
            return f"{p[0]}.{node.value}({', '.join(p[1:])})"
        case "call":
            return f"{p[0]}({', '.join(p[1:])})"
        case "index":
            return f"{p[0]}[{p[1]}]"
        case "list":
            return f"[{', '.join(p)}]"
        case "map":
            return "{" + ", ".join(f"{k}:{v}" for k, v in zip(node.value, p, strict=True)) + "}"
        case "lambda":
            return f"({', '.join(node.value)})->{p[0]}" if len(node.value) != 1 else f"{node.value[0]}->{p[0]}"
        case "if":
            return f"if {p[0]} then {p[1]} else {p[2]}"
        case "switch":
            return f"switch {p[0]} " + " ".join(f"case {a}: {b}" for a, b in zip(p[1:-1:2], p[2:-1:2], strict=True)) + f" default {p[-1]}"
        case "try":
            return f"try {p[0]} catch {p[1]}"
        case "let":
            return f"let {node.value}={p[0]};\n{p[1]}"
        case "func":
            return f"func {node.value[0]}({', '.join(node.value[1])}) {p[0]};\n{p[1]}"
    raise LanguageError(f"no text for {node.kind}")

"""The expression language of APPLY and FILTER: a tokenizer and a precedence-climbing parser that builds Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from .scalars import FUNCTIONS, ExpressionError
from .values import Typed, compare, divide, number, remainder, truth

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf\b)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<prop>@(?:\\.|[\w.$:\-\[\]])+)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%^<>!(),])|(?P<name>[A-Za-z_][\w]*))""",
    re.X,
)
#: operator -> (left binding power, right binding power)
_POWER = {"||": (1, 2), "&&": (3, 4), "==": (7, 8), "!=": (7, 8), "<": (7, 8), "<=": (7, 8), ">": (7, 8), ">=": (7, 8), "+": (9, 10), "-": (9, 10), "*": (11, 12), "/": (11, 12), "%": (11, 12), "^": (14, 13)}


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        if source[at:].isspace():
            break
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"can't read the expression at {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    def __init__(self, source: str, resolve: Callable[[str], Typed], functions: dict | None = None):
        self.toks, self.at, self.resolve = tokens(source), 0, resolve
        self.functions = FUNCTIONS | (functions or {})

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at] if self.at < len(self.toks) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        tok = self.peek()
        if value is not None and tok[1] != value:
            raise ExpressionError(f"expected {value!r}, found {tok[1]!r}")
        self.at += 1
        return tok

    def parse(self) -> Typed:
        out = self.expr(0)
        if self.peek()[0] != "end":
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def expr(self, least: int) -> Typed:
        left = self.prefix()
        while (tok := self.peek())[0] == "op" and tok[1] in _POWER and _POWER[tok[1]][0] >= least:
            self.take()
            left = self.infix(tok[1], left, self.expr(_POWER[tok[1]][1]))
        return left

    def prefix(self) -> Typed:
        kind, value = self.take()
        if kind == "num":
            x = float(value)
            return Typed(F.lit(x), "number", x)
        if kind == "str":
            x = re.sub(r"\\(.)", r"\1", value[1:-1])
            return Typed(F.lit(x), "string", x)
        if kind == "prop":
            return self.resolve(re.sub(r"\\(.)", r"\1", value[1:]))
        if value == "(":
            out = self.expr(0)
            self.take(")")
            return out
        if value == "!":
            return Typed(~truth(self.expr(12)), "bool")
        if value == "-":
            x = self.expr(12)
            return Typed(-number(x), "number", -x.value if isinstance(x.value, float) else None)
        if value == "+":
            return self.expr(12)
        if kind == "name":
            if value.upper() == "NULL" and self.peek()[1] != "(":
                return Typed(F.lit(None), "null")
            return self.call(value)
        raise ExpressionError(f"unexpected {value or 'end'!r}")

    def call(self, name: str) -> Typed:
        self.take("(")
        args = []
        if self.peek()[1] != ")":
            args.append(self.expr(0))
            while self.peek()[1] == ",":
                self.take()
                args.append(self.expr(0))
        self.take(")")
        if name.lower() not in self.functions:
            raise ExpressionError(f"unknown function {name}")
        low, high, build = self.functions[name.lower()]
        if not low <= len(args) <= high:
            raise ExpressionError(f"{name} takes {low} to {high} arguments, not {len(args)}")
        return build(*args)

    @staticmethod
    def infix(op: str, a: Typed, b: Typed) -> Typed:
        if op in ("==", "!=", "<", "<=", ">", ">="):
            return Typed(compare(op, a, b), "bool")
        if op == "&&":
            return Typed(truth(a) & truth(b), "bool")
        if op == "||":
            return Typed(truth(a) | truth(b), "bool")
        x, y = number(a), number(b)
        made = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "%": lambda: remainder(x, y), "^": lambda: F.pow(x, y)}[op]()
        return Typed(made, "number")


def build(source: str, resolve: Callable[[str], Typed], functions: dict | None = None) -> Typed:
    return Parser(source, resolve, functions).parse()

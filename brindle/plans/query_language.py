"""The retrieval language: syntax tree and parser. AND binds tighter than OR (dialect 2); dialect 1 turns this round."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    pass


@dataclass
class Node:
    weight: float = field(default=1.0, kw_only=True)
    fields: tuple[str, ...] | None = field(default=None, kw_only=True)
    attrs: dict[str, Any] = field(default_factory=dict, kw_only=True)


@dataclass
class Phrase(Node):
    """All children; exact: adjacent and in order."""

    children: list[Node]
    exact: bool = False
    slop: int = -1
    inorder: bool = False


@dataclass
class Union(Node):
    children: list[Node]


@dataclass
class Token(Node):
    term: str
    verbatim: bool = False


@dataclass
class Numeric(Node):
    name: str
    low: float
    high: float
    low_open: bool = False
    high_open: bool = False


@dataclass
class Not(Node):
    child: Node


@dataclass
class Optional(Node):
    child: Node


@dataclass
class Geo(Node):
    name: str
    lon: float
    lat: float
    radius: float
    unit: str


@dataclass
class Geometry(Node):
    name: str
    relation: str
    wkt: str


@dataclass
class Prefix(Node):
    term: str
    kind: str = "prefix"


@dataclass
class Ids(Node):
    keys: tuple


@dataclass
class Wildcard(Node):
    pass


@dataclass
class Tag(Node):
    name: str
    children: list[Node]


@dataclass
class Fuzzy(Node):
    term: str
    distance: int = 1


@dataclass
class Vector(Node):
    name: str
    vector: tuple[float, ...]
    k: int | None = None
    radius: float | None = None
    alias: str | None = None
    child: Node | None = None


@dataclass
class WildcardQuery(Node):
    pattern: str


@dataclass
class Null(Node):
    pass


@dataclass
class Missing(Node):
    name: str


_WORD = r"(?:\\.|[^\s\\\-|~(){}\[\]\"'@:;,.<>!=%*$&+^/?`#])+"
_UNIT = ("m", "km", "ft", "mi")
_OPS = ("==", "!=", ">=", "<=", ">", "<")


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


class Parser:
    def __init__(self, text: str, params: dict[str, Any] | None = None, stopwords: set[str] | frozenset = frozenset(), dialect: int = 2, verbatim: bool = False):
        self.s, self.i = text, 0
        self.params, self.stop, self.dialect, self.verbatim = params or {}, stopwords, dialect, verbatim

    # -- reading ---------------------------------------------------------------------------------------------------

    def space(self) -> None:
        while self.i < len(self.s) and (self.s[self.i].isspace() or self.s[self.i] in ".,;"):
            self.i += 1

    def at(self, what: str) -> bool:
        self.space()
        return self.s.startswith(what, self.i)

    def eat(self, what: str) -> bool:
        if self.at(what):
            self.i += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.eat(what):
            raise QueryError(f"syntax error at {self.i}: expected {what!r} near {self.s[self.i : self.i + 15]!r}")

    def match(self, pattern: str) -> str | None:
        self.space()
        m = re.compile(pattern).match(self.s, self.i)
        if not m:
            return None
        self.i = m.end()
        return m[0]

    def param(self, name: str):
        if name not in self.params:
            raise QueryError(f"no parameter ${name}")
        return self.params[name]

    def number(self) -> float:
        self.space()
        m = self.match(r"\$\w+")
        if m:
            return float(self.param(m[1:]))
        m = self.match(r"[+-]?(?:inf|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)")
        if m is None:
            raise QueryError(f"expected a number near {self.s[self.i : self.i + 15]!r}")
        return float(m)

    # -- grammar ---------------------------------------------------------------------------------------------------

    def parse(self) -> Node:
        self.space()
        if self.i >= len(self.s):
            return Null()
        node = self.union(None)
        node = self.vector_suffix(node)
        self.space()
        if self.i < len(self.s):
            raise QueryError(f"syntax error at {self.i} near {self.s[self.i : self.i + 15]!r}")
        return node

    def union(self, fields) -> Node:
        if self.dialect == 1:
            return self.all_of(fields, lambda f: self.any_of(f, self.attributed))
        return self.any_of(fields, lambda f: self.all_of(f, self.attributed))

    def any_of(self, fields, below) -> Node:
        kids = [below(fields)]
        while self.at("|"):
            self.eat("|")
            kids.append(below(fields))
        kept = [k for k in kids if not isinstance(k, Null)]
        return kids[0] if len(kids) == 1 else Union(kept, fields=fields) if len(kept) > 1 else (kept or [Null()])[0]

    def all_of(self, fields, below) -> Node:
        kids = []
        while True:
            self.space()
            if self.i >= len(self.s) or self.s[self.i] in ")|}]" or self.s.startswith("=>", self.i):
                break
            kids.append(below(fields))
        if not kids:
            raise QueryError(f"syntax error at {self.i}: an empty expression")
        kept = [k for k in kids if not isinstance(k, Null)]
        if not kept:
            return Null()
        return kept[0] if len(kept) == 1 else Phrase(kept, fields=fields)

    def attributed(self, fields) -> Node:
        node = self.unary(fields)
        while self.at("=>") and re.match(r"=>\s*\{", self.s[self.i :]):
            self.eat("=>")
            self.need("{")
            while not self.eat("}"):
                name = self.match(r"\$\w+")
                if name is None:
                    raise QueryError("an attribute begins with $")
                self.need(":")
                self.space()
                m = re.compile(r"\$\w+|[^;}]+").match(self.s, self.i)
                if not m:
                    raise QueryError(f"attribute {name} has no value")
                self.i = m.end()
                value = m[0].strip()
                self.attribute(node, name[1:].lower(), str(self.param(value[1:])) if value.startswith("$") else value)
                self.eat(";")
        return node

    @staticmethod
    def attribute(node: Node, name: str, value: str) -> None:
        if name == "weight":
            if float(value) < 0:
                raise QueryError("$weight is 0 or more")
            node.weight = float(value)
        elif name in ("slop", "inorder") and isinstance(node, Phrase):
            setattr(node, name, int(value) if name == "slop" else value.lower() == "true")
        elif name in ("slop", "inorder"):
            node.attrs[name] = value
        elif name == "phonetic":
            node.attrs["phonetic"] = value.lower() == "true"
        elif name == "yield_distance_as" and isinstance(node, Vector):
            node.alias = value
        elif name in ("ef_runtime", "epsilon", "hybrid_policy", "batch_size", "shard_k_ratio"):
            node.attrs[name] = value
        else:
            raise QueryError(f"no attribute ${name} here")

    def unary(self, fields) -> Node:
        if self.eat("-"):
            return Not(self.attributed(fields), fields=fields)
        if self.eat("~"):
            return Optional(self.attributed(fields), fields=fields)
        return self.primary(fields)

    def primary(self, fields) -> Node:
        self.space()
        if self.eat("("):
            node = self.union(fields)
            node = self.vector_suffix(node)
            self.need(")")
            return node
        if self.at('"'):
            return self.quoted(fields)
        if self.at("@"):
            return self.field_clause()
        m = self.match(r"ismissing\s*\(\s*@")
        if m:
            name = self.name()
            self.need(")")
            return Missing(name)
        return self.term(fields)

    def name(self) -> str:
        m = self.match(r"(?:\\.|[\w.$])+")
        if m is None:
            raise QueryError(f"expected a field near {self.s[self.i : self.i + 15]!r}")
        return _plain(m)

    def quoted(self, fields) -> Node:
        m = self.match(r'"((?:\\.|[^"\\])*)"')
        if m is None:
            raise QueryError("a phrase isn't closed")
        from ..functions.analysis import tokens_of

        terms = [Token(t, verbatim=True, fields=fields) for t in tokens_of(m[1:-1], list(self.stop))]
        return Null() if not terms else terms[0] if len(terms) == 1 else Phrase(terms, exact=True, fields=fields)

    def field_clause(self) -> Node:
        self.need("@")
        names = [self.name()]
        while self.s.startswith("|", self.i) and re.match(r"\|\s*@?[\w\\]", self.s[self.i :]):
            self.eat("|")
            self.eat("@")
            names.append(self.name())
        for op in _OPS:
            if self.eat(op):
                return self.comparison(names[0], op)
        self.need(":")
        if self.at("["):
            return self.bracket(names[0])
        if self.at("{"):
            return self.tag(names[0])
        fields = tuple(names)
        return self.unary(fields)

    def comparison(self, name: str, op: str) -> Node:
        v = self.number()
        inf = float("inf")
        made = {"==": (v, v, False, False), "!=": (v, v, False, False), ">": (v, inf, True, False), ">=": (v, inf, False, False), "<": (-inf, v, False, True), "<=": (-inf, v, False, False)}[op]
        node = Numeric(name, *made)
        return Not(node) if op == "!=" else node

    def bracket(self, name: str) -> Node:
        self.need("[")
        m = self.match(r"(?i)VECTOR_RANGE\b")
        if m:
            radius = self.number()
            vector = self.vector_value()
            self.need("]")
            return Vector(name, vector, radius=radius)
        m = self.match(r"(?i)(WITHIN|CONTAINS|INTERSECTS|DISJOINT)\b")
        if m:
            p = self.match(r"\$\w+")
            wkt = str(self.param(p[1:])) if p else self.match(r"[A-Za-z]+\s*\([^\]]*\)")
            if wkt is None:
                raise QueryError("expected a shape")
            self.need("]")
            return Geometry(name, m.upper(), wkt)
        values, opens = [], []
        while not self.eat("]"):
            if self.i >= len(self.s):
                raise QueryError("a bracket isn't closed")
            self.eat(",")
            if values and len(values) == 3 and (u := self.match(r"(?i)(km|m|ft|mi)\b|\$\w+")):
                unit = str(self.param(u[1:])) if u.startswith("$") else u
                self.need("]")
                return Geo(name, values[0], values[1], values[2], unit.lower())
            opens.append(self.eat("("))
            values.append(self.number())
        if len(values) == 1:
            return Numeric(name, values[0], values[0])
        if len(values) != 2:
            raise QueryError("a range has one or two values")
        return Numeric(name, values[0], values[1], opens[0], opens[1])

    def tag(self, name: str) -> Node:
        self.need("{")
        kids: list[Node] = []
        while True:
            while self.i < len(self.s) and self.s[self.i].isspace():
                self.i += 1
            if self.s.startswith('""', self.i):
                self.i += 2
                kids.append(Token(""))
            elif m := re.compile(r"w'((?:\\.|[^'\\])*)'").match(self.s, self.i):
                self.i = m.end()
                kids.append(WildcardQuery(m[1]))
            elif m := re.compile(r'"((?:\\.|[^"\\])*)"').match(self.s, self.i):
                self.i = m.end()
                kids.append(Token(_plain(m[1])))
            else:
                m = re.compile(r"(?:\\.|[^|}\\])+").match(self.s, self.i)
                if not m:
                    raise QueryError("an empty tag")
                self.i = m.end()
                raw = m[0].strip()
                if raw.startswith("$"):
                    kids.append(Token(str(self.param(raw[1:]))))
                else:
                    front, back = raw.startswith("*"), raw.endswith("*") and not raw.endswith("\\*")
                    body = _plain(raw.strip("*") if front or back else raw)
                    kids.append(Prefix(body, "contains" if front and back else "suffix" if front else "prefix") if front or back else Token(body))
            while self.i < len(self.s) and self.s[self.i].isspace():
                self.i += 1
            if self.s.startswith("|", self.i):
                self.i += 1
                continue
            self.need("}")
            return Tag(name, kids)

    def term(self, fields) -> Node:
        m = self.match(r"w'((?:\\.|[^'\\])*)'")
        if m:
            return WildcardQuery(m[2:-1].lower(), fields=fields)
        m = self.match(r"(%{1,3})(" + _WORD + r")\1")
        if m:
            n = len(re.match(r"%+", m)[0])
            return Fuzzy(_plain(m.strip("%")).lower(), n, fields=fields)
        m = self.match(r"\*" + _WORD + r"\*?")
        if m:
            body = _plain(m.strip("*")).lower()
            return Prefix(body, "contains" if m.endswith("*") else "suffix", fields=fields)
        if self.match(r"\*"):
            return Wildcard()
        m = self.match(_WORD + r"\*")
        if m:
            return Prefix(_plain(m[:-1]).lower(), "prefix", fields=fields)
        m = self.match(r"\$\w+")
        if m:
            return self.word(str(self.param(m[1:])), fields)
        m = self.match(_WORD)
        if m is None:
            raise QueryError(f"syntax error at {self.i} near {self.s[self.i : self.i + 15]!r}")
        return self.word(_plain(m), fields)

    def word(self, w: str, fields) -> Node:
        w = w.lower()
        return Null() if w in self.stop else Token(w, verbatim=self.verbatim, fields=fields)

    def vector_value(self) -> tuple[float, ...]:
        m = self.match(r"\$\w+")
        if m is None:
            raise QueryError("a vector is given as a parameter")
        return vector_of(self.param(m[1:]))

    def vector_suffix(self, node: Node) -> Node:
        if not (self.at("=>") and re.match(r"=>\s*\[\s*KNN", self.s[self.i :], re.I)):
            return node
        self.eat("=>")
        self.need("[")
        self.match(r"(?i)KNN")
        k = int(self.number())
        self.need("@")
        out = Vector(self.name(), self.vector_value(), k=k, child=node)
        while not self.eat("]"):
            word = self.match(r"\w+")
            if word is None:
                raise QueryError("KNN isn't closed")
            if word.upper() == "AS":
                out.alias = self.match(r"\$\w+|[\w.]+")
            else:
                out.attrs[word.lower()] = self.match(r"\$?[\w.]+")
        while self.at("=>") and re.match(r"=>\s*\{", self.s[self.i :]):
            m = re.compile(r"=>\s*\{([^}]*)\}").match(self.s, self.i)
            self.i = m.end()
            for part in filter(None, (p.strip() for p in m[1].split(";"))):
                key, _, value = part.partition(":")
                self.attribute(out, key.strip()[1:].lower(), value.strip())
        out.alias = out.alias or f"__{out.name}_score"
        return out


def vector_of(value) -> tuple[float, ...]:
    """A parameter as a vector: numbers, or the bytes of little-endian 32-bit floats."""
    if isinstance(value, (bytes, bytearray)):
        import struct

        return struct.unpack(f"<{len(value) // 4}f", value)
    return tuple(float(x) for x in value)


def parse(text: str, params: dict[str, Any] | None = None, stopwords=frozenset(), dialect: int = 2, verbatim: bool = False) -> Node:
    return Parser(text, params, stopwords, dialect, verbatim).parse()


def explain(node: Node, depth: int = 0) -> str:
    """The tree, one node a line."""
    from dataclasses import fields as parts

    own = {p.name: getattr(node, p.name) for p in parts(node) if p.name not in ("children", "child", "attrs", "fields", "weight")}
    extra = {k: v for k, v in (("fields", node.fields), ("weight", node.weight if node.weight != 1 else None), *node.attrs.items()) if v is not None}
    line = "  " * depth + type(node).__name__.upper() + (" " + ", ".join(f"{k}={v!r}" for k, v in {**own, **extra}.items()) if own or extra else "")
    kids = getattr(node, "children", None) or ([node.child] if getattr(node, "child", None) is not None else [])
    return "\n".join([line, *(explain(k, depth + 1) for k in kids)])

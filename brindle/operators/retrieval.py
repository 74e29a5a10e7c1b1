"""A query's syntax tree as row-local Columns: a match predicate, term frequencies, positions and distances.

Every predicate reads one row, so retrieval has no shuffle: it is a scan with pruned columns. What a score needs from the
whole collection (document count, lengths, document frequencies) is one more scan that returns a single row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import analysis, geo, geometry
from ..plans import query_language as q
from ..plans.catalog import IndexDef
from .vector import distance


@dataclass
class Options:
    verbatim: bool = False
    infields: tuple[str, ...] | None = None
    slop: int | None = None
    inorder: bool = False
    min_prefix: int = 2
    max_expansions: int | None = None
    language: str | None = None
    expanders: dict = field(default_factory=dict)


class Retrieval:
    """Compiles one tree for one index. `df` must be index.prepared()."""

    def __init__(self, index: IndexDef, df: DataFrame, options: Options | None = None):
        self.index, self.df, self.options = index, df, options or Options()
        self.text = [f.name for f in index.of_type("TEXT")]
        self.distances: dict[str, Column] = {}
        self.expansions: dict[int, list[str]] = {}

    # -- text ------------------------------------------------------------------------------------------------------

    def fields_of(self, node: q.Node) -> list[str]:
        names = list(node.fields) if node.fields else list(self.options.infields or self.text)
        for n in names:
            if self.index.field(n).type != "TEXT":
                raise q.QueryError(f"@{n} isn't a text field")
        return names

    def hit(self, node: q.Node, name: str):
        """A predicate over one token (a Column to a Column) and, for stems and codes, over the columns beside it."""
        if isinstance(node, q.Token):
            terms = self.terms(node)
            return lambda t: t.isin(terms) if len(terms) > 1 else t == terms[0]
        if isinstance(node, q.Prefix):
            if node.kind == "prefix" and len(node.term) < self.options.min_prefix:
                return lambda t: F.lit(False)
            made = affix(node.kind, node.term)
        elif isinstance(node, q.Fuzzy):
            made = lambda t: F.levenshtein(t, F.lit(node.term), node.distance) >= 0
        elif isinstance(node, q.WildcardQuery):
            made = like(node.pattern)
        else:
            raise q.QueryError(f"{type(node).__name__} isn't a term")
        return made if self.options.max_expansions is None else self.expanded(node, made)

    def terms(self, node: q.Token) -> list[str]:
        """What a word stands for: itself, its synonyms and what expanders give."""
        terms = [node.term]
        if not node.verbatim and not self.options.verbatim:
            terms += [t for t in self.index.synonyms.get(node.term, ()) if t != node.term]
            for expand in self.options.expanders.values():
                terms += [t for t in expand(node.term) if t not in terms]
        return terms

    def expanded(self, node: q.Node, hit):
        """Only the first `max_expansions` terms, in their order, that a prefix, pattern or fuzzy word finds in the collection."""
        if id(node) not in self.expansions:
            every = F.array_distinct(F.flatten(F.array(*[F.filter(F.col(f"__tok_{n}"), hit) for n in self.fields_of(node)])))
            rows = self.df.select(F.explode(every).alias("term")).distinct().orderBy("term").limit(self.options.max_expansions).collect()
            self.expansions[id(node)] = [r["term"] for r in rows]
        terms = self.expansions[id(node)]
        return lambda t: t.isin(terms) if terms else F.lit(False)

    def needed(self, node: q.Node) -> Column | None:
        """A cheap test of the raw texts that every match passes, or None: most rows then never become tokens."""
        if isinstance(node, (q.Token, q.Prefix)):
            tests = F.lit(False)
            for name in self.fields_of(node):
                if self.extra(node, name) or not isinstance(self.df.schema[name].dataType, StringType):
                    return None
                text = F.lower(F.col(f"`{name}`"))
                for term in self.terms(node) if isinstance(node, q.Token) else [node.term]:
                    # a backslash keeps the next character: such texts are looked at as a whole
                    tests = tests | text.contains(term)
                tests = tests | text.contains("\\")
            return tests
        if isinstance(node, q.Phrase):
            known = [c for c in map(self.needed, node.children) if c is not None]
            return reduce(lambda a, b: a & b, known) if known else None
        if isinstance(node, q.Union):
            known = list(map(self.needed, node.children))
            return None if not known or any(c is None for c in known) else reduce(lambda a, b: a | b, known)
        return self.needed(node.child) if isinstance(node, q.Vector) and node.child is not None else None

    def extra(self, node: q.Node, name: str) -> tuple[str, str] | None:
        """The column of stems or codes that a token also matches in, and the value there."""
        f = self.index.field(name)
        if not isinstance(node, q.Token) or node.verbatim or self.options.verbatim:
            return None
        if node.attrs.get("phonetic", f.phonetic) and f.phonetic and len(node.term) >= self.index.min_phonetic:
            return f"__phon_{name}", analysis.phonetic(node.term)
        if not f.nostem and len(node.term) >= self.index.min_stem:
            make = analysis.STEMMERS.get((self.options.language or self.index.language).lower())
            if make:
                return f"__stem_{name}", make(node.term)
        return None

    def matches(self, node: q.Node, name: str) -> Column:
        tok = F.col(f"__tok_{name}")
        if isinstance(node, q.Token) and not (self.index.synonyms.get(node.term) or self.options.expanders):
            found = F.array_contains(tok, node.term)
        else:
            found = F.exists(tok, self.hit(node, name))
        more = self.extra(node, name)
        return found | F.array_contains(F.col(more[0]), more[1]) if more else found

    def frequency(self, node: q.Node) -> Column:
        """Occurrences in the node's fields, each counted by the field's weight as a whole number, 1 at least."""
        total = F.lit(0)
        for name in self.fields_of(node):
            f = self.index.field(name)
            n = F.size(F.filter(F.col(f"__tok_{name}"), self.hit(node, name)))
            more = self.extra(node, name)
            if more:
                hit, other, value = self.hit(node, name), F.col(more[0]), more[1]
                tok = F.col(f"__tok_{name}")
                n = n + F.size(F.filter(F.zip_with(tok, other, lambda t, s: (~hit(t)) & (s == value)), lambda x: x)) if more[0].startswith("__stem") else F.size(F.filter(other, lambda s: s == value))
            total = total + n * max(1, int(f.weight))
        return total

    def positions(self, node: q.Node, name: str) -> Column:
        """0-based places of a term in a field, ascending. The tokens are read once, however many places there are."""
        hit, more = self.hit(node, name), self.extra(node, name)
        if more:
            pairs = F.arrays_zip(F.col(f"__tok_{name}").alias("t"), F.col(more[0]).alias("s"))
            found = F.transform(pairs, lambda x, i: F.when(hit(x["t"]) | (x["s"] == more[1]), i))
            return F.filter(found, lambda i: i.isNotNull())
        return places(F.col(f"__tok_{name}"), hit, 0)

    def phrase(self, node: q.Phrase) -> Column:
        """Whether one field has the terms at places that follow each other: each term's places, moved back, share one."""
        leaves = node.children
        out = F.lit(False)
        for name in self.fields_of(leaves[0]):
            tok = F.col(f"__tok_{name}")
            here, starts = F.lit(True), None
            for k, leaf in enumerate(leaves):
                # tokens first: most rows fail there and never look at places
                here = here & self.matches(leaf, name)
                mine = places(tok, self.hit(leaf, name), k)
                starts = mine if starts is None else F.array_intersect(starts, mine)
            out = out | (here & (F.size(starts) > 0))
        return out

    def near(self, node: q.Phrase, slop: int, inorder: bool) -> Column:
        """Whether one field has all terms within a span with `slop` other places at most, and in order if asked."""
        leaves = [c for c in node.children if isinstance(c, (q.Token, q.Prefix, q.Fuzzy, q.WildcardQuery))]
        if len(leaves) < 2:
            return F.lit(True)
        most = (slop if slop >= 0 else 1 << 30) + len(leaves) - 1
        out = F.lit(False)
        for name in self.fields_of(leaves[0]):
            lists = [self.positions(leaf, name) for leaf in leaves]
            ok = in_order(lists, most) if inorder else in_span(lists, most)
            out = out | ok
        return out

    # -- predicate -------------------------------------------------------------------------------------------------

    def match(self, node: q.Node) -> Column:
        col = lambda name: F.col(f"`{name}`")
        if isinstance(node, q.Wildcard):
            return F.lit(True)
        if isinstance(node, q.Null):
            return F.lit(False)
        if isinstance(node, (q.Token, q.Prefix, q.Fuzzy, q.WildcardQuery)):
            out = F.lit(False)
            for name in self.fields_of(node):
                out = out | self.matches(node, name)
            return out
        if isinstance(node, q.Phrase):
            if node.exact and node.slop < 0:
                return self.phrase(node)
            out = F.lit(True)
            for c in node.children:
                out = out & self.match(c)
            slop = node.slop if node.slop >= 0 else (self.options.slop if self.options.slop is not None else -1)
            inorder = node.inorder or self.options.inorder
            return out & self.near(node, slop, inorder) if slop >= 0 or inorder else out
        if isinstance(node, q.Union):
            out = F.lit(False)
            for c in node.children:
                out = out | self.match(c)
            return out
        if isinstance(node, q.Not):
            return ~F.coalesce(self.match(node.child), F.lit(False))
        if isinstance(node, q.Optional):
            return F.lit(True)
        if isinstance(node, q.Numeric):
            self.typed(node.name, "NUMERIC")
            low, high = (lambda v: v > node.low) if node.low_open else (lambda v: v >= node.low), (lambda v: v < node.high) if node.high_open else (lambda v: v <= node.high)
            both = lambda v: (low(v) if node.low != float("-inf") else v.isNotNull()) & (high(v) if node.high != float("inf") else v.isNotNull())
            c = col(node.name)
            kind = self.df.schema[node.name].dataType
            if isinstance(kind, ArrayType):
                return F.coalesce(F.exists(c, lambda v: both(v.cast("double"))), F.lit(False))
            return F.coalesce(both(c if kind.typeName() != "string" else c.try_cast("double")), F.lit(False))
        if isinstance(node, q.Geo):
            self.typed(node.name, "GEO")
            return geo.within(col(node.name), node.lon, node.lat, node.radius, node.unit)
        if isinstance(node, q.Geometry):
            self.typed(node.name, "GEOSHAPE")
            return geometry.relates(col(node.name), node.relation, node.wkt, self.index.field(node.name).coords)
        if isinstance(node, q.Ids):
            return F.col("__key").isin(list(node.keys))
        if isinstance(node, q.Missing):
            return col(node.name).isNull()
        if isinstance(node, q.Tag):
            return self.tag(node)
        if isinstance(node, q.Vector):
            f = self.index.field(node.name)
            d = distance(col(node.name), node.vector, f.metric)
            self.distances[node.alias or f"__{node.name}_score"] = d
            if node.radius is not None:
                return F.coalesce(d <= node.radius, F.lit(False))
            return self.match(node.child) & d.isNotNull()
        raise q.QueryError(f"can't evaluate {type(node).__name__}")

    def typed(self, name: str, kind: str) -> None:
        if self.index.field(name).type != kind:
            raise q.QueryError(f"@{name} isn't a {kind} field")

    def tag(self, node: q.Tag) -> Column:
        f = self.index.field(node.name)
        if f.type != "TAG":
            raise q.QueryError(f"@{node.name} isn't a TAG field")
        tags = F.col(f"__tag_{node.name}")
        case = (lambda s: s) if f.case_sensitive else str.lower
        plain = [case(c.term) for c in node.children if isinstance(c, q.Token)]
        out = F.lit(False)
        if len(plain) == 1:
            out = F.array_contains(tags, plain[0])
        elif plain:
            out = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in plain]))
        for c in node.children:
            if isinstance(c, q.Prefix):
                out = out | F.exists(tags, affix(c.kind, case(c.term)))
            elif isinstance(c, q.WildcardQuery):
                out = out | F.exists(tags, like(case(c.pattern)))
        return F.coalesce(out, F.lit(False))


def affix(kind: str, term: str):
    return {"prefix": lambda t: t.startswith(term), "suffix": lambda t: t.endswith(term), "contains": lambda t: t.contains(term)}[kind]


def like(wild: str):
    pattern = like_pattern(wild)
    return lambda t: t.like(pattern)


def places(tok: Column, hit, back: int) -> Column:
    """The places where a token matches, moved back by `back`."""
    return F.filter(F.transform(tok, lambda t, i: F.when(hit(t), i - back)), lambda i: i.isNotNull())


def let(lists: list[Column], test) -> Column:
    """test(names) over arrays that are computed once: inside a lambda an expression would be computed for each element."""
    return F.exists(F.array(F.struct(*[x.alias(f"p{i}") for i, x in enumerate(lists)])), lambda s: test([s[f"p{i}"] for i in range(len(lists))]))


def in_order(lists: list[Column], most: int) -> Column:
    """Whether places p1 < p2 < ... can be taken, one of each list, with the last at most `most` after the first."""

    def test(ps: list[Column]) -> Column:
        end = lambda p: F.aggregate(F.array(*ps[1:]), p, lambda acc, x: F.array_min(F.filter(x, lambda i: i > acc)))
        return F.exists(ps[0], lambda p: F.coalesce(end(p) - p <= most, F.lit(False)))

    return let(lists, test)


def in_span(lists: list[Column], most: int) -> Column:
    """Whether places, one of each list in any order, lie within `most` of each other."""

    def test(ps: list[Column]) -> Column:
        far = F.lit(1 << 30)
        top = lambda m: F.aggregate(F.array(*ps), m, lambda acc, x: F.greatest(acc, F.coalesce(F.array_min(F.filter(x, lambda i: i >= m)), far)))
        return F.exists(F.flatten(F.array(*ps)), lambda m: top(m) - m <= most)

    return let(lists, test)


def like_pattern(wild: str) -> str:
    """* and ? as % and _, with the characters that mean something in either one escaped."""
    out, i = [], 0
    while i < len(wild):
        c = wild[i]
        if c == "\\" and i + 1 < len(wild):
            i += 1
            c = wild[i]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append({"*": "%", "?": "_"}.get(c) or ("\\" + c if c in "%_\\" else c))
        i += 1
    return "".join(out)


def simplify(node: q.Node) -> q.Node:
    """Flattens single children, drops what can't match, folds double negation."""
    if isinstance(node, q.Not):
        node.child = simplify(node.child)
        if isinstance(node.child, q.Null):
            return q.Wildcard()
        if isinstance(node.child, q.Wildcard):
            return q.Null()
        return node.child.child if isinstance(node.child, q.Not) else node
    if isinstance(node, q.Optional):
        node.child = simplify(node.child)
        return q.Wildcard() if isinstance(node.child, q.Null) else node
    if isinstance(node, q.Union):
        node.children = [k for k in map(simplify, node.children) if not isinstance(k, q.Null)]
        return q.Null() if not node.children else node.children[0] if len(node.children) == 1 and node.weight == 1 else node
    if isinstance(node, q.Phrase) and not node.exact:
        node.children = list(map(simplify, node.children))
        if any(isinstance(k, q.Null) for k in node.children):
            return q.Null()
    return node


def terms_of(node: q.Node) -> list[str]:
    if isinstance(node, q.Token):
        return [node.term]
    if isinstance(node, (q.Phrase, q.Union)):
        return list(dict.fromkeys(t for c in node.children for t in terms_of(c)))
    if isinstance(node, q.Optional) or isinstance(node, q.Vector) and node.child is not None:
        return terms_of(node.child)
    return []



"""Relevance scores as Columns over a compiled query.

Collection statistics are one scan that returns a row: document count, total length, and for each leaf the number of
documents with the term. They enter the score as literals, so scoring itself is row-local.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import query_language as q
from .retrieval import Retrieval

LEAVES = (q.Token, q.Prefix, q.Fuzzy, q.WildcardQuery)
NAMES = ("BM25STD", "BM25STD.NORM", "BM25STD.TANH", "BM25", "TFIDF", "TFIDF.DOCNORM", "DISMAX", "DOCSCORE", "HAMMING")
DEFAULT = "BM25STD"
TANH_FACTOR = 4


@dataclass
class Context:
    """What a scorer sees: statistics, document columns, and the leaves' frequencies."""

    retrieval: Retrieval
    docs: int = 0
    total_length: int = 0
    frequencies: dict[int, int] = field(default_factory=dict)
    payload: bytes | None = None
    tanh_factor: int = TANH_FACTOR

    @property
    def average_length(self) -> float:
        return self.total_length / self.docs if self.docs else 0.0

    @property
    def length(self) -> Column:
        return doc_length(self.retrieval)

    def idf(self, node: q.Node) -> float:
        return float(math.floor(math.log2(1 + (self.docs + 1) / max(self.frequencies.get(id(node), 0), 1))))

    def idf_std(self, node: q.Node) -> float:
        df = self.frequencies.get(id(node), 0)
        return math.log(1 + (self.docs - df + 0.5) / (df + 0.5))


def doc_length(r: Retrieval) -> Column:
    total = F.lit(0)
    for f in r.index.of_type("TEXT"):
        total = total + F.size(F.filter(F.col(f"__tok_{f.name}"), lambda t: t != "")) * max(1, int(f.weight))
    return total


def max_frequency(r: Retrieval) -> Column:
    """The largest frequency of one term in the document."""
    every = F.flatten(F.array(*[F.col(f"__tok_{f.name}") for f in r.index.of_type("TEXT")]))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(t.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.sort_array(F.filter(every, lambda t: t != "")), start, step, lambda a: a["best"])


def leaves(node: q.Node) -> list[q.Node]:
    if isinstance(node, LEAVES):
        return [node]
    if isinstance(node, (q.Phrase, q.Union)):
        return [x for c in node.children for x in leaves(c)]
    if isinstance(node, q.Optional) or isinstance(node, q.Vector) and node.child is not None:
        return leaves(node.child)
    return []


def statistics(r: Retrieval, node: q.Node, df: DataFrame, postings=None, **extra) -> Context:
    """From postings where there are any that tell, else from one scan of the texts."""
    found = leaves(node)
    known = postings.counted(r, found) if postings is not None else None
    if known is not None:
        return Context(r, known[0], known[1], {id(x): k for x, k in zip(found, known[2], strict=True)}, **extra)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(doc_length(r)).alias("len")]
    aggs += [F.count_if(r.frequency(x) > 0).alias(f"df{i}") for i, x in enumerate(found)]
    row = df.agg(*aggs).first()
    return Context(r, row["n"], row["len"] or 0, {id(x): row[f"df{i}"] for i, x in enumerate(found)}, **extra)


def _tree(ctx: Context, node: q.Node, leaf: Callable[[q.Node, Column], Column], virtual: Callable[[q.Node], Column]) -> Column:
    """Sums over what matched, by node weight."""
    r = ctx.retrieval
    if isinstance(node, LEAVES):
        return leaf(node, r.frequency(node).cast("double")) * node.weight
    if isinstance(node, q.Phrase):
        total = F.lit(0.0)
        for c in node.children:
            total = total + _tree(ctx, c, leaf, virtual)
        return total * node.weight
    if isinstance(node, q.Union):
        total = F.lit(0.0)
        for c in node.children:
            part = _tree(ctx, c, leaf, virtual)
            total = total + (part if isinstance(c, LEAVES) else F.when(r.match(c), part).otherwise(0.0))
        return total * node.weight
    if isinstance(node, q.Optional):
        return F.when(r.match(node.child), _tree(ctx, node.child, leaf, virtual)).otherwise(0.0) * node.weight
    if isinstance(node, q.Vector) and node.child is not None:
        return _tree(ctx, node.child, leaf, virtual)
    return virtual(node) * node.weight


def bm25std(ctx: Context, node: q.Node) -> Column:
    k1, b, avg = 1.2, 0.75, ctx.average_length or 1.0
    tf = lambda f: f * (k1 + 1) / (f + k1 * (1 - b + b * ctx.length / avg))
    made = _tree(ctx, node, lambda n, f: F.lit(ctx.idf_std(n)) * tf(f), lambda n: tf(F.lit(1.0)) if isinstance(n, q.Wildcard) else F.lit(0.0))
    return made * F.col("__score")


def bm25(ctx: Context, node: q.Node) -> Column:
    k1, b = 1.2, 0.5
    tf = lambda f: f / (f + k1 * (1 - b + b * ctx.average_length))
    made = _tree(ctx, node, lambda n, f: F.lit(ctx.idf(n)) * tf(f), lambda n: tf(F.lit(1.0)))
    return made * F.col("__score") / slop(ctx, node)


def tfidf(ctx: Context, node: q.Node, by_length: bool = False) -> Column:
    norm = ctx.length if by_length else max_frequency(ctx.retrieval)
    made = _tree(ctx, node, lambda n, f: F.lit(ctx.idf(n)) * f, lambda n: F.lit(1.0))
    return F.when(norm > 0, made * F.col("__score") / norm / slop(ctx, node)).otherwise(0.0)


def slop(ctx: Context, node: q.Node) -> Column:
    """The root of the summed squares of neighbouring terms' least distances, as a whole number, 1 at least."""
    kids = [c for c in node.children if isinstance(c, LEAVES)] if isinstance(node, q.Phrase) else []
    if len(kids) < 2:
        return F.lit(1)
    r, total = ctx.retrieval, F.lit(0)
    for a, b in zip(kids, kids[1:], strict=False):
        least = F.lit(1 << 15)
        for name in r.fields_of(a):
            x, y = r.positions(a, name), r.positions(b, name)
            least = F.least(least, F.coalesce(least_gap(x, y), F.lit(1 << 15)))
        total = total + least * least
    return F.when(total == 0, F.lit(len(kids) - 1)).otherwise(F.greatest(F.lit(1), F.floor(F.sqrt(total.cast("double"))).cast("int")))


def least_gap(x: Column, y: Column) -> Column:
    return F.array_min(F.transform(x, lambda i: F.array_min(F.transform(y, lambda j: F.abs(i - j)))))


def dismax(ctx: Context, node: q.Node) -> Column:
    r = ctx.retrieval

    def of(n: q.Node) -> Column:
        if isinstance(n, LEAVES):
            return r.frequency(n).cast("double") * n.weight
        if isinstance(n, q.Union):
            parts = [F.when(r.match(c), of(c)).otherwise(0.0) for c in n.children]
            return (F.greatest(*parts) if len(parts) > 1 else parts[0]) * n.weight
        if isinstance(n, q.Phrase):
            total = F.lit(0.0)
            for c in n.children:
                total = total + of(c)
            return total * n.weight
        if isinstance(n, q.Optional):
            return F.when(r.match(n.child), of(n.child)).otherwise(0.0)
        return F.lit(n.weight) if isinstance(n, (q.Wildcard, q.Numeric, q.Tag)) else F.lit(0.0)

    return of(node)


def hamming(ctx: Context, node: q.Node) -> Column:
    """1 / (1 + bits that differ between the payloads); 0 where their sizes differ."""
    name = ctx.retrieval.index.payload_field
    if not name or ctx.payload is None:
        return F.lit(0.0)
    own, n = F.col(f"`{name}`").cast("binary"), len(ctx.payload)
    bits = F.lit(0)
    for i, byte in enumerate(ctx.payload):
        bits = bits + F.bit_count(F.conv(F.hex(F.substring(own, i + 1, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(byte)))
    return F.when(F.octet_length(own) == n, 1.0 / (1 + bits)).otherwise(0.0)


SCORERS: dict[str, Callable[[Context, q.Node], Column]] = {
    "BM25STD": bm25std, "BM25STD.NORM": bm25std, "BM25STD.TANH": lambda c, n: F.tanh(bm25std(c, n) / c.tanh_factor), "BM25": bm25, "TFIDF": tfidf,
    "TFIDF.DOCNORM": lambda c, n: tfidf(c, n, True), "DISMAX": dismax, "DOCSCORE": lambda c, n: F.col("__score"), "HAMMING": hamming,
}


def register(name: str, scorer: Callable[[Context, q.Node], Column]) -> None:
    """A user's scorer, by name."""
    SCORERS[name.upper()] = scorer


def explained(ctx: Context, node: q.Node) -> Column:
    """Each leaf's frequency, document frequency and idf."""
    parts = [F.struct(F.lit(getattr(n, "term", getattr(n, "pattern", ""))).alias("term"), ctx.retrieval.frequency(n).alias("frequency"), F.lit(ctx.frequencies.get(id(n), 0)).alias("documents"), F.lit(ctx.idf_std(n)).alias("idf")) for n in leaves(node)]
    return F.array(*parts) if parts else F.array().cast("array<struct<term:string,frequency:int,documents:bigint,idf:double>>")

"""Search, aggregation over search results, hybrid ranking."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.analysis import STEMMERS, STOPWORDS
from ..functions.values import Typed
from ..plans import query_language as q
from ..plans.catalog import IndexDef
from . import scoring
from .pipeline import Pipeline
from .postings import Postings, few
from .retrieval import Options, Retrieval, simplify, terms_of
from .vector import normalized


@dataclass
class Query:
    """A text of the retrieval language with what surrounds it."""

    text: str = "*"
    params: dict[str, Any] = field(default_factory=dict)
    options: Options = field(default_factory=Options)
    dialect: int = 2
    no_stopwords: bool = False
    inkeys: tuple | None = None
    filters: list[tuple[str, float, float, bool, bool]] = field(default_factory=list)
    geofilters: list[tuple[str, float, float, float, str]] = field(default_factory=list)
    language: str | None = None

    def tree(self, index: IndexDef) -> q.Node:
        stop = frozenset() if self.no_stopwords else frozenset(index.stopwords if index.stopwords is not None else STOPWORDS)
        node = q.parse(self.text, self.params, stop, self.dialect, self.options.verbatim)
        more: list[q.Node] = [q.Numeric(*f) for f in self.filters] + [q.Geo(*g) for g in self.geofilters]
        if self.inkeys is not None:
            more.append(q.Ids(tuple(self.inkeys)))
        if more:
            if isinstance(node, q.Vector) and node.child is not None:
                node.child = q.Phrase([node.child, *more])
            else:
                node = q.Phrase([node, *more])
        return simplify(node)


@dataclass
class Hits:
    """Matching rows, the compiled query and its tree."""

    df: DataFrame
    retrieval: Retrieval
    node: q.Node
    index: IndexDef
    postings: Postings | None = None

    @property
    def functions(self) -> dict:
        """matched_terms() for this query."""
        words = terms_of(self.node)

        def matched(most: Typed | None = None) -> Typed:
            toks = [F.col(f"__tok_{n}") for n in self.retrieval.text]
            own = F.array_distinct(F.flatten(F.array(*toks))) if toks else F.array().cast("array<string>")
            found = F.array_intersect(F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>"), own)
            return Typed(F.slice(found, 1, int(most.value) if most is not None else 100), "array")

        return {"matched_terms": (0, 1, matched)}


def retrieve(index: IndexDef, query: Query | str) -> Hits:
    query = Query(query) if isinstance(query, str) else query
    if query.language and not query.options.language:
        query.options.language = query.language
    df = index.prepared()
    node = query.tree(index)
    r = Retrieval(index, df, query.options)
    found, kept = df, None
    if index.postings:
        kept = Postings(df.sparkSession, index.postings)
        near = kept.candidates(r, node)
        if near is not None and few(near):
            found = index.prepared(near)
    cheap = r.needed(node)
    found = found.where(r.match(node) if cheap is None else cheap & r.match(node))
    for alias, d in r.distances.items():
        found = found.withColumn(alias, d)
    if isinstance(node, q.Vector) and node.k is not None:
        found = found.orderBy(F.col(f"`{node.alias}`").asc(), F.col("__key").asc()).limit(node.k)
    return Hits(found, r, node, index, kept)


def scored(hits: Hits, scorer: str = scoring.DEFAULT, alias: str = "__score", payload: bytes | None = None, tanh_factor: int = scoring.TANH_FACTOR, explain: bool = False) -> DataFrame:
    """The hits with a score. One scan gathers the statistics as a row; the score is computed row by row."""
    name = scorer.upper()
    if name not in scoring.SCORERS:
        raise ValueError(f"no scorer {scorer}")
    needs = name not in ("DOCSCORE", "HAMMING")
    context = scoring.statistics(hits.retrieval, hits.node, hits.retrieval.df, hits.postings, payload=payload, tanh_factor=tanh_factor) if needs else scoring.Context(hits.retrieval, payload=payload)
    columns = {alias: scoring.SCORERS[name](context, hits.node)}
    if explain:
        columns["__explain"] = scoring.explained(context, hits.node)
    out = hits.df.withColumns(columns)
    if name == "BM25STD.NORM":
        best = out.agg(F.max(alias).alias("__best"))  # one row
        out = out.crossJoin(F.broadcast(best)).withColumn(alias, F.when(F.col("__best") != 0, F.col(alias) / F.col("__best")).otherwise(0.0)).drop("__best")
    return out


def visible(df: DataFrame) -> DataFrame:
    """Without the columns the engine made for itself."""
    return df.drop(*[c for c in df.columns if c.startswith(("__tok_", "__stem_", "__phon_", "__tag_"))])


def search(
    index: IndexDef,
    query: Query | str,
    scorer: str = scoring.DEFAULT,
    sortby: tuple[str, bool] | None = None,
    limit: tuple[int, int] = (0, 10),
    returns: list[str | tuple[str, str]] | None = None,
    nocontent: bool = False,
    with_scores: bool = False,
    with_sort_keys: bool = False,
    with_payloads: bool = False,
    explain_score: bool = False,
    payload: bytes | None = None,
    tanh_factor: int = scoring.TANH_FACTOR,
    highlight: dict | None = None,
    summarize: dict | None = None,
) -> DataFrame:
    """The best documents in order: by score, or by a field, ties by key. A score is computed only where it is used.

    A limit with a negative count gives all documents from its offset on.
    """
    hits = retrieve(index, query)
    knn = isinstance(hits.node, q.Vector) and hits.node.k is not None
    by_score = sortby is None and not knn
    df = hits.df
    if by_score or with_scores or explain_score:
        df = scored(hits, scorer, payload=payload, tanh_factor=tanh_factor, explain=explain_score)
    if sortby:
        name, down = sortby
        order = [F.col(f"`{name}`").desc_nulls_last() if down else F.col(f"`{name}`").asc_nulls_last(), F.col("__key").asc()]
    elif knn:
        order = [F.col(f"`{hits.node.alias}`").asc(), F.col("__key").asc()]
    else:
        order = [F.col("__score").desc(), F.col("__key").asc()]
    if with_sort_keys:
        df = df.withColumn("__sortkey", F.col(f"`{sortby[0]}`") if sortby else F.lit(None).cast("string"))
    offset, n = limit
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    df = df if n < 0 else df.limit(n)
    if highlight is not None or summarize is not None:
        from .highlight import highlighted, summarized

        words = terms_of(hits.node)
        if not hits.retrieval.options.verbatim:
            words = list(dict.fromkeys([*words, *(o for w in words for o in index.synonyms.get(w, ()))]))
        if summarize is not None:
            df = summarized(df, words, **summarize)
        if highlight is not None:
            make = None if hits.retrieval.options.verbatim else STEMMERS.get((hits.retrieval.options.language or index.language).lower())
            df = highlighted(df, words, **highlight, stemmers={f.name: make for f in index.of_type("TEXT") if make and not f.nostem}, least=index.min_stem)
    extra = [c for c, on in (("__score", with_scores), ("__sortkey", with_sort_keys), ("__explain", explain_score), (index.payload_field or "", with_payloads and index.payload_field)) if on]
    if nocontent:
        return df.select("__key", *extra)
    if returns is not None:
        cols = [F.col(f"`{r}`") if isinstance(r, str) else F.col(f"`{r[0]}`").alias(r[1]) for r in returns]
        return df.select("__key", *extra, *cols)
    out = visible(df)
    return out if "__score" in extra else out.drop("__score")


def count(index: IndexDef, query: Query | str) -> int:
    return retrieve(index, query).df.count()


def aggregate(index: IndexDef, query: Query | str, add_scores: bool = False, scorer: str = scoring.DEFAULT, strict: bool = False, tanh_factor: int = scoring.TANH_FACTOR) -> Pipeline:
    """A pipeline over the hits. __score is the document score unless scores are asked for."""
    hits = retrieve(index, query)
    df = scored(hits, scorer, tanh_factor=tanh_factor) if add_scores else hits.df
    return Pipeline(df, "__key", hits.functions, strict)


#: rows of a hybrid result that are broadcast to fetch their documents
MOST_WINDOWS = 100_000
RRF_CONSTANT, WINDOW, ALPHA, BETA, KNN_K = 60.0, 20, 0.3, 0.7, 10


@dataclass
class VectorSide:
    field: str
    vector: tuple[float, ...]
    k: int | None = KNN_K
    radius: float | None = None
    filter: Query | str | None = None
    alias: str | None = None


def ranked(df: DataFrame, order: list[Column], n: int, rank: str) -> DataFrame:
    """The first n rows, numbered. Only n rows meet in one place: the top-k runs in each task first."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def hybrid(
    index: IndexDef,
    text: Query | str,
    vsim: VectorSide,
    scorer: str = scoring.DEFAULT,
    combine: str = "RRF",
    constant: float = RRF_CONSTANT,
    window: int = WINDOW,
    alpha: float = ALPHA,
    beta: float = BETA,
    text_alias: str | None = None,
    score_alias: str = "__score",
    explain: bool = False,
) -> Pipeline:
    """Text and vector results fused by reciprocal ranks or by weights: __key, __score and the documents' fields."""
    hits = retrieve(index, text)
    left = scored(hits, scorer, alias="__text")
    left = ranked(left.select("__key", "__text"), [F.col("__text").desc(), F.col("__key").asc()], window, "__text_rank")
    f = index.field(vsim.field)
    base = retrieve(index, vsim.filter or "*")
    from .vector import distance

    near = base.df.select("__key", distance(F.col(f"`{vsim.field}`"), tuple(vsim.vector), f.metric).alias("__distance")).where("__distance is not null")
    if vsim.radius is not None:
        near = near.where(F.col("__distance") <= vsim.radius)
    most = window if vsim.radius is not None else min(vsim.k or KNN_K, window)
    right = ranked(near, [F.col("__distance").asc(), F.col("__key").asc()], most, "__vector_rank")
    right = right.withColumn("__vector", normalized(F.col("__distance"), f.metric))
    both = left.join(right, "__key", "full_outer")
    if combine.upper() == "RRF":
        part = lambda c: F.coalesce(1.0 / (F.lit(float(constant)) + F.col(c)), F.lit(0.0))
        fused = part("__text_rank") + part("__vector_rank")
    elif combine.upper() == "LINEAR":
        fused = alpha * F.coalesce("__text", F.lit(0.0)) + beta * F.coalesce("__vector", F.lit(0.0))
    else:
        raise ValueError(f"COMBINE takes RRF or LINEAR, not {combine}")
    out = both.withColumn("__fused", fused)
    keep = [F.col("__fused").alias(score_alias)]
    if text_alias:
        keep.append(F.col("__text").alias(text_alias))
    if vsim.alias:
        keep.append(F.col("__vector").alias(vsim.alias))
    if explain:
        keep.append(F.struct("__text", "__text_rank", "__vector", "__vector_rank").alias("__explain"))
    out = out.select("__key", *keep)
    docs = visible(index.source()).drop("__score")
    # at most two windows of rows
    joined = docs.join(F.broadcast(out) if 2 * window <= MOST_WINDOWS else out, "__key")
    return Pipeline(joined.orderBy(F.col(score_alias).desc(), F.col("__key").asc()), "__key", hits.functions)

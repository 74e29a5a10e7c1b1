"""The inverted form of an index: a table of postings dealt by term, for queries on few terms of a large collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

from ..functions.analysis import stemmer
from ..plans.catalog import IndexDef

BUCKETS = 64
STEM = "\x01"
#: tokens that a task groups at once; a longer document is grouped as a whole
MOST_TOKENS = 1_000_000
#: a query's candidates are broadcast up to so many keys and bytes; with more, the collection is read without them
MOST_CANDIDATES, MOST_BYTES = 1_000_000, 32 << 20


def _arrow_pass(index: IndexDef, stems: bool, make, schema: StructType) -> DataFrame:
    """make(keys, name, weight, terms, code, doc, place) of each text field, and where asked of its stems, in pieces of documents.

    A task groups its documents' tokens by itself: the texts are read into tokens once, and no token is dealt out alone.
    """
    df = index.prepared()
    fields = index.of_type("TEXT")
    stemmed = [stems and f"__stem_{f.name}" in df.columns for f in fields]
    language = F.lower(F.col(f"`{index.language_field}`")) if index.language_field else F.lit(None).cast("string")
    read = df.select("__key", "__score", F.coalesce(language, F.lit(index.language)).alias("language"), *[F.col(f"__tok_{f.name}") for f in fields])
    return read.mapInArrow(_grouped([f.name for f in fields], [max(1, int(f.weight)) for f in fields], stemmed, index.min_stem, make, schema.names), schema)


def _once(df: DataFrame) -> bool:
    """Whether no key repeats."""
    return df.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def blocks(index: IndexDef, stems: bool = False) -> DataFrame:
    """term, field, keys, frequency, positions, scores: a row a term of a piece of the documents, with its documents.

    stems: also rows of the stems, named by STEM and the stem. Rows without a field or a term have the documents themselves,
    with their lengths as frequencies and their scores.
    """
    key = index.source().schema["__key"].dataType
    ints = ArrayType(IntegerType())
    schema = StructType().add("term", StringType()).add("field", StringType()).add("keys", ArrayType(key)).add("frequency", ints).add("positions", ArrayType(ints)).add("scores", ArrayType(DoubleType()))
    return _arrow_pass(index, stems, _blocks, schema)


def postings(index: IndexDef, stems: bool = False) -> DataFrame:
    """term, field, __key, frequency, positions. stems: also rows of the stems, named by STEM and the stem.

    Where keys repeat, the rows of their documents are put together.
    """
    out = flat(blocks(index, stems).where("field IS NOT NULL"))
    if _once(index.source()):
        return out
    places = F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")
    return out.groupBy("term", "field", "__key").agg(F.sum("frequency").cast("int").alias("frequency"), places).select("term", "field", "__key", "frequency", "positions")


def flat(table: DataFrame) -> DataFrame:
    """Blocks as a row a term and document."""
    row = F.explode(F.arrays_zip(F.col("keys").alias("k"), F.col("frequency").alias("f"), F.col("positions").alias("p"))).alias("r")
    return table.select("term", "field", row).select("term", "field", F.col("r.k").alias("__key"), F.col("r.f").alias("frequency"), F.col("r.p").alias("positions"))


def vocabulary(index: IndexDef) -> DataFrame:
    """term, field, documents, occurrences: the postings counted."""
    if not _once(index.source()):
        return postings(index).groupBy("term", "field").agg(F.count("__key").alias("documents"), F.sum("frequency").alias("occurrences"))
    schema = StructType().add("term", StringType()).add("field", StringType()).add("documents", LongType()).add("occurrences", LongType())
    return _arrow_pass(index, False, _counts, schema).groupBy("term", "field").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


def _grouped(names: list[str], weights: list[int], stemmed: list[bool], least: int, make, columns: list[str]):
    """Batches of (__key, __score, language, tokens of each field) to what make() gives, of about MOST_TOKENS at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                keys, scores, languages = part.columns[:3]
                length = np.zeros(len(keys), np.int64)
                for name, weight, stem, tokens in zip(names, weights, stemmed, part.columns[3:], strict=True):
                    lengths = _lengths(tokens)
                    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                    place = (np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                    coded = tokens.flatten().dictionary_encode()
                    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
                    full = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                    if not full.all():  # empty tokens only keep places
                        code, doc, place = code[full], doc[full], place[full]
                    length += np.bincount(doc, minlength=len(keys)) * weight
                    for t, c, d, p in ((terms, code, doc, place), *([_stems(terms, code, doc, place, languages, least)] if stem else [])):
                        if len(c):
                            yield pa.RecordBatch.from_arrays(make(keys, name, weight, t, c, d, p), names=columns)
                if make is _blocks and len(keys):
                    yield pa.RecordBatch.from_arrays(_documents(keys, scores, length), names=columns)
            pa.default_memory_pool().release_unused()

    return run


def _lengths(tokens: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of whole documents."""
    piece = np.cumsum(sum(map(_lengths, batch.columns[3:]))) // MOST_TOKENS if batch.num_columns > 3 else np.zeros(batch.num_rows)
    at = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(at, at[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _stems(terms: pa.Array, code: np.ndarray, doc: np.ndarray, place: np.ndarray, languages: pa.Array, least: int):
    """The tokens as stems by their documents' languages, marked by STEM: each word of a language is stemmed once."""
    coded = languages.dictionary_encode()
    make, words = [stemmer(x, least) for x in coded.dictionary.to_pylist()], terms.to_pylist()
    both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc] * len(words) + code if len(make) > 1 else code
    known = np.zeros(max(1, len(make)) * len(words), bool)
    known[both] = True
    pairs = np.flatnonzero(known)
    found = []
    for x in pairs.tolist():
        f, w = make[x // len(words)], words[x % len(words)]
        w = w if f is None else f(w)
        found.append(STEM + w if w else "")
    made = pa.array(found, pa.string()).dictionary_encode()
    to = np.zeros(len(known), np.int32)
    to[pairs] = made.indices.to_numpy(zero_copy_only=False)
    new = to[both]
    full = pc.not_equal(made.dictionary, "").to_numpy(zero_copy_only=False)[new] if len(new) else np.zeros(0, bool)
    return made.dictionary, new[full], doc[full], place[full]


def _order(code: np.ndarray) -> np.ndarray:
    """A stable order by code, in passes of 16 bits."""
    order = np.argsort((code & 0xFFFF).astype(np.uint16), kind="stable")
    high = (code >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _runs(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of tokens by term and document; where each document's run begins in it, each run's size, where each term's runs begin."""
    order = _order(code)
    c, d = code[order], doc[order]
    first = np.flatnonzero(np.append(True, (np.diff(c) != 0) | (np.diff(d) != 0)))
    return order, first, np.diff(first, append=len(order)), np.flatnonzero(np.append(True, np.diff(c[first]) != 0))


def _same(value: str | None, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, np.int32)))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _blocks(keys: pa.Array, name: str, weight: int, terms: pa.Array, code: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    order, first, n, start = _runs(code, doc)
    at = order[first]
    of = lambda values: _lists(start, values)
    places = _lists(first, pa.array(place[order]))
    return [terms.take(pa.array(code[at[start]])), _same(name, len(start)), of(keys.take(pa.array(doc[at]))), of(pa.array((n * weight).astype(np.int32))), of(places), pa.nulls(len(start), pa.list_(pa.float64()))]


def _documents(keys: pa.Array, scores: pa.Array, length: np.ndarray) -> list[pa.Array]:
    one = np.zeros(1, np.int64)
    return [_same("", 1), _same(None, 1), _lists(one, keys), _lists(one, pa.array(length.astype(np.int32))), pa.nulls(1, pa.list_(pa.list_(pa.int32()))), _lists(one, scores)]


def _counts(keys: pa.Array, name: str, weight: int, terms: pa.Array, code: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    order, first, n, start = _runs(code, doc)
    return [terms.take(pa.array(code[order[first[start]]])), _same(name, len(start)), pa.array(np.diff(start, append=len(first))), pa.array(np.add.reduceat(n, start) * weight)]


def write_postings(index: IndexDef, path: str, buckets: int = BUCKETS) -> None:
    """Blocks partitioned by a hash of the term, so a query on a term reads one partition. The number of buckets is kept with them.

    The documents' own blocks are in bucket -1; stats has them as rows of __key, length, __score.
    """
    bucket = F.when(F.col("field").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int")
    dealt = blocks(index, stems=True).withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    dealt.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(f"{path}/postings")
    spark = dealt.sparkSession
    rows = spark.read.schema(dealt.schema.add("buckets", IntegerType())).parquet(f"{path}/postings").where("bucket = -1")
    rows = rows.select(F.explode(F.arrays_zip(F.col("keys").alias("k"), F.col("frequency").alias("n"), F.col("scores").alias("s"))).alias("r"))
    rows.select(F.col("r.k").alias("__key"), F.col("r.n").alias("length"), F.col("r.s").alias("__score")).write.mode("overwrite").parquet(f"{path}/stats")


def few(keys: DataFrame) -> bool:
    """Whether a table of __key may be broadcast, by its counted rows and bytes."""
    n, size = keys.agg(F.count("*"), F.sum(F.octet_length(F.col("__key").cast("string")))).first()
    return n <= MOST_CANDIDATES and (size or 0) + 16 * n <= MOST_BYTES


class Postings:
    """Written postings as a query reads them: candidates for its tree, and the statistics of its leaves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table, self.stats = spark.read.parquet(f"{path}/postings").where("bucket >= 0"), spark.read.parquet(f"{path}/stats")

    def rows(self, r, node) -> DataFrame | None:
        """__key of the postings of a leaf in its fields, or None where they don't tell all that it matches."""
        from ..plans import query_language as q

        out = None
        for name in r.fields_of(node):
            more = r.extra(node, name)
            if more and not more[0].startswith("__stem"):
                return None
            if isinstance(node, q.Token):
                terms = [*r.terms(node), *([STEM + more[1]] if more else [])]
                here = F.lit(False)
                for t in terms:
                    here = here | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.col("buckets")))
                mine = self.table.where(here & F.col("term").isin(terms))
            else:
                mine = self.table.where(~F.col("term").startswith(STEM) & r.hit(node, name)(F.col("term")))
            mine = mine.where(F.col("field") == name).select(F.explode("keys").alias("__key"))
            out = mine if out is None else out.unionByName(mine)
        return out

    def candidates(self, r, node) -> DataFrame | None:
        """__key of all documents that a tree can match, or None where postings don't bound them."""
        from ..plans import query_language as q

        if isinstance(node, (q.Token, q.Prefix, q.Fuzzy, q.WildcardQuery)):
            rows = self.rows(r, node)
            return None if rows is None else rows.distinct()
        if isinstance(node, q.Phrase):
            known = [c for c in (self.candidates(r, k) for k in node.children) if c is not None]
            out = known[0] if known else None
            for c in known[1:]:
                out = out.join(c, "__key", "left_semi")
            return out
        if isinstance(node, q.Union):
            known = [self.candidates(r, k) for k in node.children]
            if any(c is None for c in known):
                return None
            out = known[0]
            for c in known[1:]:
                out = out.unionByName(c)
            return out.distinct()
        return self.candidates(r, node.child) if isinstance(node, q.Vector) and node.child is not None else None

    def counted(self, r, nodes: list) -> tuple[int, int, list[int]] | None:
        """Documents, their total length, and for each leaf the documents that have it; None where postings can't tell."""
        rows = [self.rows(r, n) for n in nodes]
        if any(x is None for x in rows):
            return None
        n, total = self.stats.agg(F.count("*"), F.sum("length")).first()
        each = None
        for j, x in enumerate(rows):
            keys = x.select(F.lit(j).alias("leaf"), "__key").distinct()
            each = keys if each is None else each.unionByName(keys)
        found = {} if each is None else {row["leaf"]: row["n"] for row in each.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
        return n, total or 0, [found.get(j, 0) for j in range(len(nodes))]


def read_terms(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of a few terms; the partitions of other terms are pruned."""
    here = F.lit(False)
    for t in terms:
        here = here | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.col("buckets")))
    return flat(spark.read.parquet(f"{path}/postings").where(here & F.col("term").isin(terms)))


def bm25_any(spark: SparkSession, path: str, terms: list[str], every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """__key, score of the documents with any (or every) term, from the postings."""
    rows = read_terms(spark, path, terms).groupBy("term", "__key").agg(F.sum("frequency").alias("f"))
    stats = spark.read.parquet(f"{path}/stats")
    n, avg = stats.agg(F.count("*"), F.avg("length")).first()
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    found = rows.join(F.broadcast(df), "term").join(stats, "__key")
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("length") / (avg or 1.0)))
    out = found.groupBy("__key").agg((F.sum(part) * F.first("__score")).alias("score"), F.count("*").alias("terms"))
    return (out.where(F.col("terms") == len(set(terms))) if every else out).drop("terms")

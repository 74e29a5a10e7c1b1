"""MinHash near-duplicates by min-max hashing: the smallest and the largest hash under each permutation are kept.

Steps. Documents with equal shingle sets form a class; its smallest doc_id stands for it. A representative's signature
has 2 values a permutation, and bands of `rows` values of it are its buckets. Candidate pairs come in two rounds, never as
all pairs of a bucket: first each bucket's members against its most central member (the one whose buckets are largest),
confirmed on full shingle sets and joined to components; then, only among documents of buckets that still hold several
components, pairs across components by the prefixes of their sets (see prefix_pairs), which loses none at the threshold.
A pair inside a component needs no test, as it can't change the result; every other pair that shares a bucket and can
reach the threshold is confirmed on full sets.

With 64 values in 16 bands of 4 a pair at the threshold 0.85 is missed with probability 7e-6; at 0.8, with 96 values in
24 bands, 3e-6.

Defined results. Null, empty or blank text: an empty set, linked with nothing. Rows with one doc_id are one node: what
links one of their texts links them all. Null doc_id: linked with nothing, component null, kept. Ties: the smallest
doc_id. Very long texts: whole, some 30 bytes a word in the task that reads them. An empty table gives an empty table.
Other columns are not read by near_duplicates and pass through drop_near_duplicates, which has to leave one row of a
group and takes distinct (doc_id, text) as nodes instead; input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bounded, discard, free_name, maybe_broadcast, mixed, released, shingles, stored, words_of
from .components import components

_WORDS = WordHashes(300_000)


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    return shingles(_WORDS.of(words_of(text)), width)


class MinMax:
    def __init__(self, permutations: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
        self.rows, self.values = rows, 2 * permutations
        self.salt = np.arange(1, self.values // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """uint32[values]: min, max of each permutation in turn. A permutation multiplies, adds and keeps the high half."""
        low, high = [], []
        for k in range(0, len(s), 4096):
            x = (s[k : k + 4096, None] * self.a[None, :] + self.b[None, :]) >> np.uint64(32)
            low.append(x.min(axis=0))
            high.append(x.max(axis=0))
        return np.stack([np.min(low, axis=0), np.max(high, axis=0)], axis=1).reshape(-1).astype(np.uint32)

    def bands(self, sig: np.ndarray) -> np.ndarray:
        x, out = sig.reshape(-1, self.rows).astype(np.uint64), self.salt.copy()
        for j in range(self.rows):
            out = mixed(out + x[:, j] * np.uint64(0xC2B2AE3D27D4EB4F))
        return out.view(np.int64)


def signatures(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands; written to the shared folder."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        mm = MinMax(permutations, rows)
        for b in (part for whole in batches for part in bounded(whole)):
            cols = b.to_pydict()
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                s = shingle_set(text, width)
                sig = mm.signature(s) if len(s) else None
                values = (doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, mm.bands(sig) if len(s) else None)
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return stored(docs.mapInArrow(released(run), "doc_id long, n_shingles long, digest binary, bands array<long>"), "nd-signatures")


def _squeezed(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in cols["text"]]
            yield pa.RecordBatch.from_pydict({"doc_id": cols["doc_id"], "size": [len(r) for r in raw], "text": [pa.compress(r, codec="zstd", asbytes=True) for r in raw]}, schema=schema)

    return docs.mapInArrow(released(run), "doc_id long, size long, text binary")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets; written."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "nd-ids")
    texts = stored(_squeezed(docs.join(maybe_broadcast(ids, 16), "doc_id", "left_semi")), "nd-texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("size").alias("size_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("size").alias("size_b"), F.col("text").alias("text_b"))
    # the side whose texts repeat comes last, so its texts aren't dealt out again after they were repeated
    both = pairs.join(two, "b").join(one, "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        kept: OrderedDict = OrderedDict()

        def get(doc_id, size, text):
            key = (doc_id, size, text[:64])
            s = kept.get(key)
            if s is None:
                s = kept[key] = shingle_set(pa.decompress(text, size, codec="zstd", asbytes=True) if size else b"", width)
                if len(kept) > 64:
                    kept.popitem(last=False)
            else:
                kept.move_to_end(key)
            return s

        for batch in batches:
            c = batch.to_pydict()
            out_a, out_b = [], []
            for a, b, sa, ta, sb, tb in zip(c["a"], c["b"], c["size_a"], c["text_a"], c["size_b"], c["text_b"], strict=True):
                x, y = get(a, sa, ta), get(b, sb, tb)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                z = np.concatenate([x, y])
                z.sort()
                common = int((z[1:] == z[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common) and common:
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_pydict({"a": out_a, "b": out_b}, schema=schema)

    links = stored(both.select("a", "b", "size_a", "text_a", "size_b", "text_b").mapInArrow(released(run), "a long, b long"), "nd-links")
    discard(ids)
    discard(texts)
    return links


def prefix_pairs(open_: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of `open_` (rep, comp) across components, by prefixes of their shingle sets.

    In one order of all shingles, the rarest first, two sets can only reach the threshold if the first few of the smaller
    set and the first few of the larger one have one in common; so this finds all pairs at the threshold. Shingles that
    one document alone has come first in the order but pair nothing, so they are counted and not dealt out. A large group
    of texts that are all a little too far apart has its own shingles in these places, and gives no pairs.
    """
    schema = pa.schema([("rep", pa.int64()), ("comp", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("token", pa.int64())])

    def run(batches):
        for b in batches:
            for rep, comp, text in zip(b.column("rep").to_pylist(), b.column("comp").to_pylist(), b.column("text"), strict=True):
                s = shingle_set(text.as_py(), width)
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_pydict({"rep": np.full(len(s), rep), "comp": np.full(len(s), comp), "set": np.full(len(s), key), "n": np.full(len(s), len(s)), "token": s.view(np.int64)}, schema=schema)

    texts = docs.join(maybe_broadcast(open_, 24), F.col("doc_id") == F.col("rep")).select("rep", "comp", "text")
    tokens = stored(texts.mapInArrow(released(run), "rep long, comp long, set long, n long, token long"), "nd-tokens")
    shared = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    order = F.sort_array(F.collect_list(F.struct("times", "token")))  # of one document: no longer than its set
    sets = tokens.join(shared, "token").groupBy("rep", "comp", "set", "n").agg(order.alias("tokens"))
    # where the other set is as large or larger, so many are shared at least; where it is smaller, so many
    as_large = F.ceil(2 * percent * F.col("n") / F.lit(100.0 + percent) - 1e-9)
    smaller = F.ceil(percent * F.col("n") / 100.0 - 1e-9)
    first = lambda least: F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - least + 1).cast("int"))
    sets = stored(sets.select("rep", "comp", "n", (F.col("n") - F.size("tokens")).alias("alone"), first(as_large).alias("short"), first(smaller).alias("long")), "nd-prefixes")
    side = lambda k, tokens: sets.select(F.col("rep").alias(k), F.col("comp").alias(f"comp_{k}"), F.col("n").alias(f"n_{k}"), "alone", F.posexplode(f"{tokens}.token").alias("at", "token")).withColumn(f"rest_{k}", F.col(f"n_{k}") - F.col("alone") - F.col("at")).drop("alone", "at")
    near = (F.col("comp_a") != F.col("comp_b")) & (F.struct("n_a", "a") < F.struct("n_b", "b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
    # from their first common shingle on, both sets must be long enough to share what the threshold needs
    near &= (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))
    return side("a", "short").join(side("b", "long"), "token").where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, permutations: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row an input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = signatures(docs, width, permutations, rows)
    named = table.where("doc_id is not null")
    # doc_ids of several rows: one text of each kind is enough, and an id with several sets is one node
    twice = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.coalesce("digest", F.lit(b""))).alias("lo"), F.max(F.coalesce("digest", F.lit(b""))).alias("hi"))
    twice = stored(twice.where("n > 1").select("doc_id", (F.col("lo") != F.col("hi")).alias("differ")), "nd-twice")
    few = maybe_broadcast(twice, 24)
    if twice.limit(1).count():
        docs = stored(docs.join(few, "doc_id", "left_anti").unionByName(docs.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])), "nd-rows")
    full = named.where("digest is not null")
    # a row a class: its representative's bands come with it through the aggregation, as equal sets have equal ones
    reps = stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nd-reps")
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("bucket", "n")
    shared = stored(buckets.join(sizes, "bucket"), "nd-buckets")
    centre = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    leaders = shared.join(centre, "rep").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"))).alias("m")).select("bucket", (-F.col("m.back")).alias("a"))
    pairs = stored(shared.join(leaders, "bucket").where("rep != a").select("a", F.col("rep").alias("b")).distinct(), "nd-pairs")
    links = verified(pairs, docs, width, percent)
    own = stored(full.join(few.where("differ"), "doc_id", "left_semi").select("doc_id", "digest").distinct().join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "nd-own")
    edges = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    labels = components(edges)

    member = shared.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("comp"))
    member = stored(member, "nd-members")
    mixed_ = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("bucket")
    open_ = stored(member.join(mixed_, "bucket").select("rep", "comp").distinct(), "nd-open")
    across = prefix_pairs(open_, docs, width, percent)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = stored(across.join(tested, ["a", "b"], "left_anti"), "nd-more")
    if more.limit(1).count():
        discard(labels)
        again = verified(more, docs, width, percent)
        labels = components(edges.unionByName(again))
        discard(again)
    for t in (shared, pairs, links, member, open_, more):
        discard(t)

    label = labels.withColumnRenamed("id", "rep")
    of_class = reps.select("digest", "rep").join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    columns = "doc_id", "n_shingles", "component_id"
    out = full.join(of_class, "digest").select(*columns)
    # empty sets have no class and aren't dealt out by their missing digest; their doc_id may have rows with words
    of_id = own.join(label, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component"))
    bare = named.where("digest is null").join(of_id, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    unnamed = table.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long"))
    out = out.unionByName(bare.select(*columns)).unionByName(unnamed.select(*columns))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 48, rows: int = 4) -> DataFrame:
    """The documents of which each group keeps one, with the columns they came with.

    A node here is a distinct (doc_id, text), so rows of a null doc_id have groups too, and other texts under a doc_id that
    has gone stay. Equal rows keep the one with the smallest columns in their order; a group keeps its smallest doc_id, a null one last.
    """
    names, key = docs.columns, free_name(docs, "row")
    nodes = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    twice = stored(nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "nd-twice")
    if twice.limit(1).count():
        few = maybe_broadcast(twice, 16)
        one = nodes.join(few, key, "left_semi").groupBy(key, "doc_id", F.coalesce("text", F.lit(""))).agg(F.min(F.struct(*names)).alias("one"))
        nodes = stored(nodes.join(few, key, "left_anti").select(*names, key).unionByName(one.select("one.*", key)), "nd-rows")
    found = near_duplicates(nodes, width, percent, permutations, rows, id_col=key).select(F.col("doc_id").alias(key), "component_id")
    found = stored(found.join(nodes.select(key, "doc_id"), key), "nd-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(key).alias("key")))
    stay = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.key").alias(key))
    gone = stored(found.select(key).join(stay, key, "left_anti"), "nd-gone")
    discard(found)
    return nodes.join(maybe_broadcast(gone, 16), key, "left_anti").select(*names)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

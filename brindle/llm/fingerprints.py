"""Document fingerprints: a homomorphic multiset hash, the sum of wide vectors hashed from paragraphs.

A paragraph (a line with a word) gives one vector: 8 lanes of 64 bits from SHAKE-256 of its words, one lane that counts
paragraphs, and 128 lanes of 32 bits, each the sum of +1 or -1 hashed from the 3-word windows that end in the
paragraph. (A sum modulo 2^64 in few lanes is forged by finding paragraphs whose vectors add up to 0; so the exact part
is 512 bits wide.) A fingerprint is the sum of its paragraphs' vectors, modulo 2^64 and 2^32; a text that
fits a column has fewer windows than would wrap a lane. So it doesn't depend on their
order, equal multisets of paragraphs have equal fingerprints, and a paragraph is put in or taken out by adding or
subtracting its vector (add, remove). The narrow lanes u, v of two documents estimate how much they share:
likeness = 2 u.v / (u.u + v.v), held to 0..1; it is 1 for equal fingerprints.

Written form: lower-case hex of all lanes, little-endian.

Defined results. Null text: empty; the zero vector. Repeated doc_ids: ordered by a hash of the text after doc_id, so each row
has a next one; equal rows stand one after another. Null doc_id: first in the order. An only document is its own next one.
Very long texts: whole, some 100 bytes a word in a task. Other columns are not read, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, bounded, mixed, stored

EXACT, NARROW = 8, 128
WIDE = EXACT + 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SECOND = np.uint64(0xD1B54A32D192ED03)
_WORDS = WordHashes(300_000)


def vector(text: str | bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(wide lanes uint64[9], narrow lanes uint32[128]) of a text."""
    wide, narrow = np.zeros(WIDE, np.uint64), np.zeros(NARROW, np.uint32)
    if not text:
        return wide, narrow
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    flat: list[bytes] = []
    digests = []
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            flat += (b"", b"")
            flat += words
            digests.append(hashlib.shake_256(b" ".join(words)).digest(8 * EXACT))
    if not digests:
        return wide, narrow
    wide[:EXACT] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
    wide[EXACT] = len(digests)
    h = _WORDS.of(flat)
    x = mixed(mixed(h[:-2] * _A + h[1:-1]) * _B + h[2:])
    x = x[np.fromiter(map(bool, flat[2:]), bool, len(flat) - 2)]
    for k, values in enumerate((x, mixed(x + _SECOND))):
        ones = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        narrow[64 * k : 64 * k + 64] = ((2 * ones - len(x)) & 0xFFFFFFFF).astype(np.uint32)
    return wide, narrow


def written(v: tuple[np.ndarray, np.ndarray]) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<u4").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * WIDE], "<u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], "<u4").astype(np.uint32)


def add(fingerprint: str, paragraphs: str) -> str:
    a, b = read(fingerprint), vector(paragraphs)
    return written((a[0] + b[0], a[1] + b[1]))


def remove(fingerprint: str, paragraphs: str) -> str:
    a, b = read(fingerprint), vector(paragraphs)
    return written((a[0] - b[0], a[1] - b[1]))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    u, v = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    both = float(u @ u + v @ v)
    return min(1.0, max(0.0, 2.0 * float(u @ v) / both)) if both else 0.0


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for b in (part for whole in batches for part in bounded(whole)):
            cols = b.to_pydict()
            yield pa.RecordBatch.from_pydict({"doc_id": cols["doc_id"], "fingerprint": [written(vector(t)) for t in cols["text"]]}, schema=schema)

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, own, following: str, other) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    raw = edited.encode("utf-8", "surrogatepass")
    v = vector(raw)
    return doc_id, len(text), hashlib.sha256(raw).hexdigest(), written(own), written(v), likeness(own, v), likeness(own, other)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document in doc_id order.

    Rows are dealt by ranges of doc_id and sorted within them, so the next document is the next row; the last row of a
    range waits for the first one of the next range, and only these rows meet again. Rows of one doc_id, or of none, are
    dealt by their texts' hashes and then, where these are equal, by their places in the input.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["doc_id", "hash", "place"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    full = pa.schema([*RESULT, ("part", pa.int64()), ("edge", pa.string()), ("text", pa.string())])

    def run(batches):
        part = TaskContext.get().partitionId()
        last = None

        def edge(kind, doc_id, text):
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "part": part, "edge": kind, "text": text}], schema=full)

        for batch in (b for whole in batches for b in bounded(whole)):
            cols = batch.to_pydict()
            out = []
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                v = vector(text)
                if last is None:
                    yield edge("first", doc_id, text)
                else:
                    out.append(_compared(*last, text, v))
                last = (doc_id, text, v)
            if out:
                columns = [list(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, full, strict=False)), *(pa.nulls(len(out), f.type) for f in list(full)[len(columns) :])], schema=full)
        if last is not None:
            yield edge("last", last[0], last[1])

    made = stored(dealt.mapInArrow(run, _DDL + ", part long, edge string, text string"), "fingerprints")
    firsts = made.where("edge = 'first'").select("part", F.col("text").alias("first_text"))
    # one row a range, without texts: after a range comes the next one that has rows, after the last one the first
    order = W.orderBy("part")
    ranges = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.min("part").over(W.partitionBy())))
    waiting = made.where("edge = 'last'").select("doc_id", "text", "part").join(ranges, "part")
    waiting = waiting.join(firsts.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "first_text")
    schema = pa.schema(RESULT)

    def finish(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out = [_compared(d, t, vector(t), f, vector(f)) for d, t, f in zip(cols["doc_id"], cols["text"], cols["first_text"], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return made.where("edge is null").select(*schema.names).unionByName(waiting.mapInArrow(finish, _DDL))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))

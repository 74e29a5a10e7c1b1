"""Removal of repeated passages: every byte covered by a `length`-byte string that also starts anywhere else.

The plan asks a ledger about sets of keys (see ledger) instead of joining rows, so a passage that a third of all
documents share costs one entry a batch of documents:

1. Anchors. Of each 200-byte window the smallest of its 101 hashed 100-byte strings is its anchor (the first of equals),
   so equal windows have equal anchors at equal places. Neighbouring windows mostly share one; runs of such windows
   are about 50 long. A run has the anchor's hash and the hash of its whole context (its first window's start to its
   last one's end).
2. Runs whose context occurs twice or more are repeated as a whole. Runs whose anchor occurs nowhere else are not
   repeated at all. What is left are the edges of repeats.
3. There the windows themselves are asked about, by hashes of 64 and 32 bits of their 200 bytes; one run of each repeated context with
   such neighbours takes part, so that edges meet it.
4. A document's repeated windows give its spans, and these are cut out.

Runs are equal where two 64-bit hashes are, an anchor's and its context's, windows by 96 bits, and rows by 128. The
suffix-array form of this operator, external induced sorting, is in suffix_external; the README says why the query
doesn't run it over every byte.

Defined results. Null or empty text: 0 bytes, nothing removed, the empty text's hash. Repeated rows: copies of each other,
so of 200 bytes or more they are removed whole. Null doc_id: kept as a row. Ties: all copies of a string go, none is the first.
Very long texts are hashed in slices of half a megabyte; offsets are unsigned 32-bit, which holds any string column.
Clashing names: with_spans and op4 read the id and the text alone; drop_repeats passes all columns through under any names. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded, discard, free_name, mixed, released, short_batches, stored
from .ledger import ASKED, FAN_BITS, Ledger, asking, expand, expand_sorted, gathered, resolve, squeeze, squeeze_sorted

LENGTH = 200
GRAM = 100
SLICE = 1 << 19
BATCH_BYTES = 4 << 20
_T, _T2 = (np.random.default_rng(k).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (11, 12))
_C, _D = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _C
    x += b
    x ^= x >> _S29
    x *= _D
    x ^= x >> _S32
    return x


def _ladder(data: np.ndarray, table: np.ndarray = _T) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 64-byte and all 128-byte strings of data; data has 128 bytes at least."""
    h = table[data]
    for k in range(6):
        s = 1 << k
        h = _pair(h[:-s], h[s:])
    return h, _pair(h[:-64], h[64:])


def window_hashes(data: np.ndarray, table: np.ndarray = _T) -> np.ndarray:
    """The hash of each 200-byte window of data."""
    h = _ladder(data, table)[1]
    return _pair(h[: len(data) - LENGTH + 1], h[LENGTH - 128 :])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts data[starts[i]:ends[i]]: (anchor hash, context hash, text, first, last window)."""
    h64, h128 = _ladder(data)
    gram = _pair(h64[: len(data) - GRAM + 1], h64[GRAM - 64 :])
    mask = np.uint64((1 << 20) - 1)
    low = (gram & ~mask) | np.arange(len(gram), dtype=np.uint64)
    span, n = LENGTH - GRAM + 1, 1
    while 2 * n <= span:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
    long = np.flatnonzero(ends - starts >= LENGTH)
    counts = ends[long] - starts[long] - LENGTH + 1
    if not len(long):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    text = np.repeat(long, counts)
    at = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(len(text))
    anchor = (low[at] & mask).astype(np.int64)
    new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    first, last = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    lo, hi, anchor, text = at[first], at[last], anchor[first], text[first]
    size = hi + LENGTH - lo
    context = _pair(_pair(h128[lo], h128[lo + (size - 128) // 2]), _pair(h128[hi + LENGTH - 128], (size * 512 + (anchor - lo)).astype(np.uint64)))
    # anchors are the smallest of many hashes: mixed again, they spread evenly over the buckets
    return mixed(gram[anchor]), context, text, lo - starts[text], hi - starts[text]


def _slices(texts: list[bytes]):
    """Groups of (text, offset, bytes) of about SLICE bytes; a longer text comes in slices that overlap by a window."""
    some, size = [], 0
    for i, raw in enumerate(texts):
        if len(raw) < LENGTH:
            continue
        for off in range(0, max(1, len(raw) - LENGTH + 1), SLICE):
            piece = raw[off : off + SLICE + LENGTH - 1]
            some.append((i, off, piece))
            size += len(piece)
            if size >= SLICE // 2:
                yield some
                some, size = [], 0
    if some:
        yield some


def _runs_of(texts: list[bytes]) -> list[np.ndarray]:
    """(anchor hash, context hash, text, first, last) of all runs of texts."""
    found = []
    for group in _slices(texts):
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        h, c, t, lo, hi = anchors(data, ends - sizes, ends)
        which, off = np.array([i for i, _, _ in group]), np.array([o for _, o, _ in group])
        found.append((h, c, which[t], lo + off[t], hi + off[t]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else []


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_key, doc_id, text: the key is a hash of id and text, so copies of a row share one."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(row_key(F.col(id_col), body).alias("doc_key"), F.col(id_col).cast("long").alias("doc_id"), body.alias("text"))


def row_key(doc_id: Column, body: Column) -> Column:
    """128 bits of a row: two 64-bit hashes with the id in front and behind."""
    whole = [F.xxhash64(F.lit(1), doc_id, body), F.xxhash64(body, F.lit(2), doc_id)]
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in whole)))


RUNS = pa.schema([("batch", pa.int64()), ("doc_keys", pa.list_(pa.binary())), ("keys", pa.binary()), ("contexts", pa.binary()), ("doc", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
RUNS_DDL = "batch long, doc_keys array<binary>, keys binary, contexts binary, doc binary, first binary, last binary"


def _pack_runs(batch: int, doc_keys: list[bytes], h, c, doc, first, last) -> pa.RecordBatch:
    order = np.lexsort((c, h))
    row = {"batch": [batch], "doc_keys": [doc_keys], "keys": [squeeze_sorted(h[order])], "contexts": [squeeze(c[order])]}
    row |= {n: [squeeze(x[order].astype(np.uint32))] for n, x in (("doc", doc), ("first", first), ("last", last))}
    return pa.RecordBatch.from_pydict(row, schema=RUNS)


def _collect_runs(batch_bytes: int):
    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        keys, texts, size = [], [], 0

        def flush():
            runs = _runs_of(texts)
            return _pack_runs((task << 24) | count, list(keys), *runs) if runs else None

        for b in batches:
            for key, raw in zip(b.column("doc_key").to_pylist(), b.column("text"), strict=True):
                data = raw.as_py()
                if len(data) < LENGTH:
                    continue
                keys.append(key)
                texts.append(data)
                size += len(data)
                if size >= batch_bytes:
                    if (out := flush()) is not None:
                        yield out
                    count += 1
                    keys, texts, size = [], [], 0
        if texts and (out := flush()) is not None:
            yield out

    return run


def _distinct(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, contexts, whether a run differs from the one before it) of a batch, whose runs are sorted by both."""
    h, c = expand_sorted(r["keys"]), expand(r["contexts"], np.uint64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h, c, new


def _ask(batches):
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            h, c, new = _distinct(r)
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(at, append=len(h)), 2)
            yield pa.RecordBatch.from_pylist([asking(r["batch"], [h[at], c[at], times])], schema=ASKED)


ALONE, EDGE, WHOLE, WHOLE_AND_EDGE = 0, 1, 2, 3


def _twice(columns: list[np.ndarray], number: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.minimum(np.bincount(number, columns[2], n), 2).astype(np.uint8)]


def _answer(columns: list[np.ndarray]) -> list[np.ndarray]:
    """For each distinct (key, context): alone, an edge of a repeat, repeated as a whole, or both."""
    h, _, times = columns
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    key = np.cumsum(new) - 1
    near = np.bincount(key)[key] >= 2 if len(h) else np.zeros(0, bool)
    return [np.where(times >= 2, np.where(near, WHOLE_AND_EDGE, WHOLE), np.where(near, EDGE, ALONE)).astype(np.uint8)]


def _one_edge(answers: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """One of the runs of a repeated context stands for it at its edges."""
    return [np.where((answers[0] == WHOLE_AND_EDGE) & ~first, WHOLE, answers[0]).astype(np.uint8)]


REPEATS = Ledger(values=(np.uint64, np.uint8), answers=(np.uint8,), merge=_twice, decide=_answer, more_key=1, share=_one_edge)


def _marks(r: dict, told: pa.Table) -> np.ndarray:
    """The mark of each run of a batch."""
    return gathered(told, REPEATS)[0][np.cumsum(_distinct(r)[2]) - 1]


SPANS = pa.schema([("doc_key", pa.binary()), ("spans", pa.binary()), ("todo", pa.binary())])
SPANS_DDL = "doc_key binary, spans binary, todo binary"


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [lo, hi) of the union of intervals; those that touch are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[0], np.flatnonzero(lo[1:] > top[:-1]) + 1])
    return lo[first], top[np.concatenate([first[1:], [len(lo)]]) - 1]


def _by_document(r: dict, whole: np.ndarray, edge: np.ndarray) -> dict:
    """Rows of SPANS from a batch's runs."""
    doc, first, last = (expand(r[c], np.uint32).astype(np.int64) for c in ("doc", "first", "last"))
    out = {f.name: [] for f in SPANS}
    some = np.flatnonzero(whole | edge)
    some = some[np.argsort(doc[some], kind="stable")]
    cut = np.searchsorted(doc[some], np.arange(len(r["doc_keys"]) + 1))
    for i in np.unique(doc[some]).tolist():
        mine = some[cut[i] : cut[i + 1]]
        w, e = mine[whole[mine]], mine[edge[mine]]
        lo, hi = union(first[w], last[w] + LENGTH)
        out["doc_key"].append(r["doc_keys"][i])
        out["spans"].append(np.stack([lo, hi], axis=1).astype("<u4").tobytes() if len(w) else None)
        out["todo"].append(np.stack([first[e], last[e]], axis=1).astype("<u4").tobytes() if len(e) else None)
    return out


def _decide(runs: pa.Table, answers: pa.Table) -> pa.Table:
    r = runs.to_pylist()[0]
    m = _marks(r, answers)
    return pa.Table.from_pydict(_by_document(r, m >= WHOLE, (m == EDGE) | (m == WHOLE_AND_EDGE)), schema=SPANS)


def _decide_windows(runs: pa.Table, answers: pa.Table) -> pa.Table:
    r = runs.to_pylist()[0]
    m = _marks(r, answers)
    return pa.Table.from_pydict(_by_document(r, m >= WHOLE, np.zeros(len(m), bool)), schema=SPANS)


def _collect_windows(batch_bytes: int):
    """The windows of runs in todo, as runs of one window with two hashes of the window as key and context."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        keys, found, size = [], [], 0

        def flush():
            h, other, doc, at = (np.concatenate(x) for x in zip(*found, strict=True))
            return _pack_runs((task << 24) | count, list(keys), h, other, doc, at, at)

        for b in batches:
            for key, raw, todo in zip(b.column("doc_key").to_pylist(), b.column("text"), b.column("todo"), strict=True):
                data = np.frombuffer(raw.as_py(), np.uint8)
                lo, hi = union(*(x for x in np.frombuffer(todo.as_py(), "<u4").astype(np.int64).reshape(-1, 2).T + np.array([[0], [1]])))
                for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                    for at in range(a, z, SLICE):
                        piece = data[at : min(at + SLICE, z) + LENGTH - 1]
                        h = window_hashes(piece)
                        found.append((h, window_hashes(piece, _T2) >> _S32, np.full(len(h), len(keys)), np.arange(at, at + len(h))))
                        size += len(h)
                keys.append(key)
                if size >= batch_bytes // 16:
                    yield flush()
                    count += 1
                    keys, found, size = [], [], 0
        if found:
            yield flush()

    return run


def _asked(runs: DataFrame, keys_bytes: int, decide, batch_bytes: int, fan_bits: int) -> DataFrame:
    """Each batch's decisions on its runs after the ledger's answers; written to the shared folder."""
    told, read = resolve(runs.select("batch", "keys", "contexts"), keys_bytes // batch_bytes, REPEATS, fan_bits, ask=_ask)
    decided = stored(runs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(decide, SPANS_DDL), "sd-decided")
    for t in (runs, *read):
        discard(t)
    return decided


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_key, doc_id, text (binary), spans (binary: pairs of unsigned 32-bit offsets, maximal and in order, or null)."""
    base = keyed(docs, id_col, text_col)
    with short_batches(docs.sparkSession):
        runs = stored(base.select("doc_key", "text").mapInArrow(released(_collect_runs(batch_bytes)), RUNS_DDL), "sd-runs")
        size = runs.agg(F.sum(F.octet_length("keys") + F.octet_length("contexts"))).first()[0] or 0
        decided = _asked(runs, size, _decide, batch_bytes, fan_bits)
        # copies of a row in several batches may stand for different runs of it: all their intervals are asked about
        lists = decided.where("todo is not null").groupBy("doc_key").agg(F.collect_set("todo").alias("lists"))
        todo = lists.select("doc_key", F.aggregate("lists", F.lit(b""), lambda x, y: F.concat(x, y)).alias("todo"))
        edges = base.select("doc_key", "text").join(_sized(todo, "todo"), "doc_key")
        windows = stored(edges.mapInArrow(released(_collect_windows(batch_bytes)), RUNS_DDL), "sd-windows")
        size = windows.agg(F.sum(F.octet_length("keys") + F.octet_length("contexts"))).first()[0] or 0
        more = _asked(windows, size, _decide_windows, batch_bytes, fan_bits)
        both = decided.where("spans is not null").select("doc_key", "spans").unionByName(more.where("spans is not null").select("doc_key", "spans"))
        spans = stored(both.groupBy("doc_key").applyInArrow(_merge, "doc_key binary, spans binary"), "sd-spans")
        discard(decided)
        discard(more)
    return base.join(_sized(spans, "spans"), "doc_key", "left")


def _sized(df: DataFrame, column: str) -> DataFrame:
    """df, to be broadcast if its bytes were added up and are few; else both sides are dealt out."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(column))).first()
    return F.broadcast(df) if 32 * n + (size or 0) <= BROADCAST_BYTES else df


def _merge(table: pa.Table) -> pa.Table:
    pairs = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("spans").to_pylist()]).astype(np.int64).reshape(-1, 2)
    lo, hi = union(pairs[:, 0], pairs[:, 1])
    return pa.table({"doc_key": pa.array([table.column("doc_key")[0].as_py()], pa.binary()), "spans": pa.array([np.stack([lo, hi], axis=1).astype("<u4").tobytes()], pa.binary())})


def cut(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, spans removed)."""
    if not spans:
        return raw, 0, 0
    pairs = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
    left, at, gone = [], 0, 0
    for lo, hi in pairs:
        left.append(raw[at:lo])
        gone += hi - lo
        at = hi
    left.append(raw[at:])
    return b"".join(left), gone, len(pairs)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            out = {f.name: [] for f in schema}
            for doc_id, raw, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                data = raw.as_py()
                left, gone, n = cut(data, spans.as_py())
                for name, v in zip(out, (doc_id, len(data), gone, n, hashlib.sha256(left).hexdigest()), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with the columns they came with; n_chars, where there, follows the text.

    A byte cut may split a character: the broken rest is dropped. Documents of which nothing is left stay, empty.
    """
    key, cuts = free_name(docs, "key"), free_name(docs, "spans")
    spans = with_spans(docs).where("spans is not null").select(F.col("doc_key").alias(key), F.col("spans").alias(cuts)).dropDuplicates([key])
    spans = stored(spans, "sd-cut")
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.withColumn(key, row_key(F.col("doc_id"), body)).join(_sized(spans, cuts), key, "left")
    names = docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches):
        for b in (part for whole in batches for part in bounded(whole)):
            cols = {n: b.column(n) for n in names}
            texts, sizes = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column(cuts).to_pylist(), strict=True):
                if spans:
                    text = cut(text.encode("utf-8", "surrogatepass"), spans)[0].decode("utf-8", "ignore")
                texts.append(text)
                sizes.append(None if text is None else len(text))
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return rows.select(*names, cuts).mapInArrow(released(run), ddl)

"""Questions of many batches about hashed keys, answered from all batches together, by levels of buckets.

A batch asks about a sorted set of 64-bit keys with values. Rows with equal keys are merged over all batches, a decision is
taken for each merged key, and every batch gets its own keys' answers back in its order; there is no join on keys.

With `n` batches' worth of keys and a fan of `f`, a batch sends at most f rows up. Up to n = f, these go to the final buckets. With
more, f batches at a time are merged in each bucket, and what is merged asks in turn, about the next bits of its keys:
so there are log_f(n) levels of at most n * f rows each, and no task holds more than about f rows' keys, some one
batch's worth. Answers come back down the same way. Keys have to be spread evenly over their high bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mixed, released, stored

FAN_BITS = 8


def squeeze(x: np.ndarray) -> bytes:
    """Little-endian bytes by place, compressed; the length leads."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(4, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def expand(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(pa.decompress(b[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).reshape(-1).view(dtype)


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


def squeeze_small(x: np.ndarray) -> bytes:
    """squeeze() in the fewest bytes that hold all of x, whole numbers from 0 on."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << (8 * k))
    return bytes([size]) + squeeze(x.astype(f"u{size}"))


def expand_small(b: bytes, dtype) -> np.ndarray:
    return expand(b[1:], f"u{b[0]}").astype(dtype)


@dataclass(frozen=True)
class Ledger:
    """What is asked: a key is 64 bits, and the first `more_key` values are part of it too.

    values, answers: dtypes by place. merge(columns) gets the keys and values of all rows, sorted by key, and for each row
    the number of its merged key; it gives the other values of each merged key. decide(keys, values) gives the answers for merged
    keys, and share(answers, first) those for the rows of a merged key, of which `first` marks one.
    """

    values: tuple
    answers: tuple
    merge: Callable[[list[np.ndarray], np.ndarray, int], list[np.ndarray]]
    decide: Callable[[list[np.ndarray]], list[np.ndarray]]
    more_key: int = 0
    share: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]] | None = None
    #: statistics of a final bucket's merged rows, added up over all buckets
    stats: Callable[[list[np.ndarray]], list[int]] | None = None

    def read(self, rows: list[dict]) -> list[list[np.ndarray]]:
        return [[expand_sorted(r["keys"]), *(expand_small(v, t) for v, t in zip(r["values"], self.values, strict=True))] for r in rows]

    def merged(self, parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(columns of the distinct keys, sorted; for each row of all parts its key's number; whether it is the key's first)."""
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        own = columns[: 1 + self.more_key]
        order = np.lexsort(own[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in own:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
        number = np.cumsum(new) - 1
        n = int(number[-1]) + 1 if len(number) else 0
        kept = [c[order][new] for c in own] + self.merge([c[order] for c in columns], number, n)
        place, first = np.empty(len(order), np.int64), np.empty(len(order), bool)
        place[order], first[order] = number, new
        return kept, place, first


ROWS = pa.schema([("bucket", pa.int64()), ("up", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
ROWS_DDL = "bucket long, up long, batch long, keys binary, values array<binary>"
ASKED = pa.schema([("batch", pa.int64()), ("keys", pa.binary()), ("values", pa.list_(pa.binary()))])
ASKED_DDL = "batch long, keys binary, values array<binary>"
TOLD = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("answers", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64()))])
TOLD_DDL = "batch long, bucket long, answers array<binary>, stats array<long>"


def asking(batch: int, columns: list[np.ndarray]) -> dict:
    """A row of ASKED. columns: sorted keys and their values."""
    return {"batch": batch, "keys": squeeze_sorted(columns[0]), "values": [squeeze_small(c) for c in columns[1:]]}


def _split(ledger: Ledger, done: int, bits: int, groups: int):
    """Rows of the buckets that the next bits name; up: the batch's group in the bucket, which asks on for it."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                (columns,) = ledger.read([r])
                group = int(mixed(np.array([r["batch"]], np.int64).view(np.uint64))[0] % np.uint64(groups))
                at = columns[0] >> np.uint64(64 - done - bits)
                cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
                out = []
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True):
                    k = int(at[lo])
                    out.append({"bucket": k, "up": k * groups + group, **asking(r["batch"], [c[lo:hi] for c in columns])})
                yield pa.RecordBatch.from_pylist(out, schema=ROWS)

    return run


def _told(rows: list[dict], parts: list[list[np.ndarray]], ledger: Ledger, answers: list[np.ndarray], place: np.ndarray, first: np.ndarray) -> list[dict]:
    mine = [a[place] for a in answers]
    if ledger.share is not None:
        mine = ledger.share(mine, first)
    out, at = [], 0
    for r, p in zip(rows, parts, strict=True):
        n = len(p[0])
        out.append({"batch": r["batch"], "bucket": r["bucket"], "answers": [squeeze_small(a[at : at + n]) for a in mine], "stats": None})
        at += n
    return out


def _final(ledger: Ledger):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = ledger.read(rows)
        kept, place, first = ledger.merged(parts)
        out = _told(rows, parts, ledger, ledger.decide(kept), place, first)
        if ledger.stats is not None:
            out.append({"batch": None, "bucket": rows[0]["bucket"], "answers": None, "stats": ledger.stats(kept)})
        return pa.Table.from_pylist(out, schema=TOLD)

    return run


def _up(ledger: Ledger):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        return pa.Table.from_pylist([asking(rows[0]["up"], ledger.merged(ledger.read(rows))[0])], schema=ASKED)

    return run


def _down(ledger: Ledger):
    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        parts = ledger.read(rows)
        _, place, first = ledger.merged(parts)
        return pa.Table.from_pylist(_told(rows, parts, ledger, gathered(told, ledger), place, first), schema=TOLD)

    return run


def gathered(told: pa.Table, ledger: Ledger) -> list[np.ndarray]:
    """The answers of one batch in the order of its keys, from its rows of resolve()."""
    rows = sorted(told.select(["bucket", "answers"]).to_pylist(), key=lambda r: r["bucket"])
    return [np.concatenate([expand_small(r["answers"][j], t) for r in rows] or [np.zeros(0, t)]) for j, t in enumerate(ledger.answers)]


def resolve(asked: DataFrame, n: int, ledger: Ledger, fan_bits: int = FAN_BITS, done: int = 0, ask: Callable | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(batch, bucket, answers, stats) from asked (batch, keys, values), and the stored tables that it reads.

    n: how many batches of a size that fits a task the keys make. stats come in rows without a batch. ask: makes the record
    batches of asked from those of the table given in its place. It runs in the worker that splits them: one mapInArrow
    after another takes two workers a task, and these stay for the stages that follow.
    """

    def dealt(bits: int, groups: int) -> DataFrame:
        split = _split(ledger, done, bits, groups)
        if ask is None:
            return asked.select("batch", "keys", "values").mapInArrow(released(split), ROWS_DDL)
        return asked.mapInArrow(released(lambda batches: split(ask(batches))), ROWS_DDL)

    if n <= 1 << fan_bits:
        rows = dealt(max(3, n.bit_length()), 1)
        return rows.groupBy("bucket").applyInArrow(_final(ledger), TOLD_DDL), []
    groups = -(-n // (1 << fan_bits))
    rows = stored(dealt(fan_bits, groups), "ledger-rows")
    merged = stored(rows.groupBy("bucket", "up").applyInArrow(_up(ledger), ASKED_DDL), "ledger-merged")
    told, below = resolve(merged, groups, ledger, fan_bits, done + fan_bits)
    told = stored(told, "ledger-told")
    for t in (merged, *below):
        discard(t)
    down = rows.groupBy("up").cogroup(told.where("batch is not null").groupBy("batch")).applyInArrow(_down(ledger), TOLD_DDL)
    if ledger.stats is not None:
        down = down.unionByName(told.where("batch is null"))
    return down, [rows, told]

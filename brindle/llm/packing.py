"""Mixture-controlled packing by deficit round-robin, in closed form, so that any task can place any document by itself.

Every source is a queue of tokens. A window of `window` tokens takes from each queue its share of the window; the part
of a token that a queue is owed is its deficit and is carried into the next window. In a run of windows over fixed
shares, what the queues have given by the end of window w follows from r = w * window by halving the queues, in their
order, at about half of their shares, until a queue is alone:

    left = r * shares on the left // shares on both sides;  right = r - left

which is exact in integers, never falls as w grows, adds up to w * window, and stays within a few tokens of the target
for every queue. Hence the deficits need no sequential pass: a document's place follows from the tokens before it in
its queue, which come from sums over (chunk, queue) and a running sum over chunks. A queue's place in a window takes the
halvings on its way alone, some log2(total / its tokens) of them, so there may be many queues.

Shares. Without weights they are the tokens that each queue holds, so all queues end in the last window. With weights,
a run of windows ends before a queue would run out; one window then takes what is left of it and spreads the rest, and
the shares are scaled to the queues still filled.

Queues. Every source is a queue. The driver and each task hold a name and a few numbers for every source. `most_queues`
only shortens the names in the column queue: all but the largest sources are named by a hash, and placed as they were.

Documents are cut where a window ends for their queue. All windows are full but the last.

Defined results. Null or empty text: the end token alone. Null source: a queue of its own. Repeated rows and doc_ids:
each row is packed by itself. Null doc_id: kept. Very long texts: a document's ids in one task, its pieces in batches of 8 MB.
Other columns are not read, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_tree import default_path
from .common import bounded, maybe_broadcast, released, stored
from .tokenizer_files import encoder

WINDOW = 4096
END_ID = 2


class Schedule:
    """Which window takes which tokens of which queue. totals, weights: by queue; order: largest total first."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW):
        self.window = window
        self.order = sorted((q for q in totals if totals[q] > 0), key=lambda q: (-totals[q], q))
        self.index = {q: j for j, q in enumerate(self.order)}
        self.totals = [totals[q] for q in self.order]
        self.total = sum(self.totals)
        self.windows = -(-self.total // window)
        self.end = self.sums(self.totals)
        given = None if weights is None else [max(0, round(weights.get(q, 0.0) * 1_000_000)) for q in self.order]
        #: runs: first window, sums of the tokens before it, sums of the shares or None (a window by itself)
        self.runs: list[tuple[int, list[int], list[int] | None]] = []
        if given is None:
            self.runs.append((0, [0] * len(self.end), self.end))
        else:
            self._plan(given)
        self.firsts = [r[0] for r in self.runs]
        self.ways: dict[tuple[int, int], list[tuple[bool, int, int]]] = {}
        self.near: dict[int, tuple[int, tuple[int, int], tuple[int, int]]] = {}

    @staticmethod
    def sums(values: list[int]) -> list[int]:
        """Running sums from 0 on, one more than there are values."""
        return list(accumulate(values, initial=0))

    @staticmethod
    def half(sums: list[int], lo: int, hi: int) -> int:
        """Where queues lo to hi - 1, two at least, are halved: next to half of their shares."""
        m = bisect_left(sums, (sums[lo] + sums[hi]) / 2, lo + 1, hi - 1)
        return m - 1 if m - 1 > lo and sums[m] + sums[m - 1] > sums[lo] + sums[hi] else m

    @classmethod
    def split(cls, r: int, shares: list[int]) -> list[int]:
        sums, out = cls.sums(shares), [0] * len(shares)
        todo = [(0, len(shares), r)]
        while todo:
            lo, hi, r = todo.pop()
            if hi - lo == 1:
                out[lo] = r
            elif r:
                m = cls.half(sums, lo, hi)
                left = r * (sums[m] - sums[lo]) // (sums[hi] - sums[lo])
                todo += [(lo, m, left), (m, hi, r - left)]
        return out

    def _plan(self, weights: list[int]) -> None:
        used, w = [0] * len(self.order), 0
        while (left := [t - u for t, u in zip(self.totals, used, strict=True)]) and any(left):
            shares = [x if n else 0 for x, n in zip(weights, left, strict=True)]
            if not any(shares):
                shares = left  # only queues without a weight are left: they follow by what they hold
            lo, hi = 0, sum(left) // self.window
            while lo < hi:
                m = (lo + hi + 1) // 2
                lo, hi = (m, hi) if all(c <= n for c, n in zip(self.split(m * self.window, shares), left, strict=True)) else (lo, m - 1)
            if lo:
                self.runs.append((w, self.sums(used), self.sums(shares)))
                used = [u + c for u, c in zip(used, self.split(lo * self.window, shares), strict=True)]
                w += lo
                continue
            take, room = [0] * len(left), min(self.window, sum(left))
            while room:
                open_ = [s if t < n else 0 for s, t, n in zip(shares, take, left, strict=True)]
                if not any(open_):
                    open_ = [n - t for t, n in zip(take, left, strict=True)]
                for j, c in enumerate(self.split(room, open_)):
                    c = min(c, left[j] - take[j])
                    take[j] += c
                    room -= c
            self.runs.append((w, self.sums(used), None))
            used = [u + c for u, c in zip(used, take, strict=True)]
            w += 1

    def _way(self, run: int, queue: int) -> list[tuple[bool, int, int]]:
        """The halvings down to a queue: whether it is on the right, the shares on the left and on both sides."""
        sums, lo, hi, out = self.runs[run][2], 0, len(self.order), []
        while hi - lo > 1:
            m = self.half(sums, lo, hi)
            out.append((queue >= m, sums[m] - sums[lo], sums[hi] - sums[lo]))
            lo, hi = (m, hi) if queue >= m else (lo, m)
        return out

    def before(self, queue: int, w: int) -> tuple[int, int]:
        """Tokens before window w of all earlier queues, and of this one."""
        if w >= self.windows:
            return self.end[queue], self.totals[queue]
        run = bisect_right(self.firsts, w) - 1
        first, used, shares = self.runs[run]
        earlier, mine = used[queue], used[queue + 1] - used[queue]
        if shares is not None and w > first:
            way = self.ways.get((run, queue))
            if way is None:
                way = self.ways[run, queue] = self._way(run, queue)
            r = (w - first) * self.window
            for right, some, both in way:
                c = r * some // both if r else 0
                if right:
                    earlier += c
                    r -= c
                else:
                    r = c
            mine += r
        return earlier, mine

    def find(self, queue: int, at: int, hint: int = 0) -> int:
        """The window of token `at` of a queue."""
        if self.before(queue, hint)[1] > at:
            lo, hi = 0, hint - 1
        else:
            lo, step = hint, 1
            while lo + step < self.windows and self.before(queue, lo + step)[1] <= at:
                lo, step = lo + step, 2 * step
            hi = min(lo + step, self.windows) - 1
        while lo < hi:
            m = (lo + hi + 1) // 2
            lo, hi = (m, hi) if self.before(queue, m)[1] <= at else (lo, m - 1)
        return lo

    def pieces(self, queue: int, at: int, n: int):
        """(start in the document, length, window, offset there) of a document of n tokens, `at` tokens into its queue."""
        done, (w, low, high) = 0, self.near.get(queue, (0, (0, 0), (0, 0)))
        while done < n:
            if not low[1] <= at + done < high[1]:
                w = self.find(queue, at + done, w)
                low, high = self.before(queue, w), self.before(queue, w + 1)
            k = min(n - done, high[1] - at - done)
            yield done, k, w, high[0] - low[0] + at + done - low[1]
            done += k
            self.near[queue] = w, low, high
            if done < n:
                w, low, high = w + 1, high, self.before(queue, w + 2)


def named(totals: dict[str, int], weights: dict[str, float], most: int | None) -> dict[str, str]:
    """The names of queues where there are more than `most`: the first half are the weighted and the largest ones' own."""
    if most is None or len(totals) <= most:
        return {}
    order = sorted(totals, key=lambda q: (q not in weights, -totals[q], q))
    own = max(most // 2, sum(q in weights for q in totals))
    return {q: f"#{crc32(q.encode('utf-8', 'surrogatepass')) % max(1, most - own)}" for q in order[own:]}


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, queue, chunk, before (tokens of the queue earlier in the chunk), n, ids; written to the shared folder."""
    source = F.coalesce(F.concat(F.lit("s:"), F.col(source_col)), F.lit("null")) if source_col in docs.columns else F.lit("null")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("queue"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("chunk", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        enc, chunk, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        narrow = enc.vocab_size <= 1 << 16
        for batch in (b for whole in batches for b in bounded(whole)):
            cols = batch.to_pydict()
            before, ns, ids = [], [], []
            for q, text in zip(cols["queue"], cols["text"], strict=True):
                x = np.frombuffer(enc.encode(text) + end, "<u4")
                before.append(seen[q])
                ns.append(len(x))
                seen[q] += len(x)
                ids.append(x.astype("<u2").tobytes() if narrow else x.tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": cols["doc_id"], "queue": cols["queue"], "chunk": [chunk] * len(ns), "before": before, "n": ns, "ids": ids}, schema=schema)

    return stored(rows.mapInArrow(released(run), "doc_id long, queue string, chunk long, before long, n long, ids binary"), "packing-ids")


def pack_documents(docs: DataFrame, path: str | None = None, weights: dict[str, float] | None = None, window: int = WINDOW, most_queues: int | None = None, **columns) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, queue, ids (binary, unsigned 32-bit)."""
    path = path or default_path()
    rows = tokenised(docs, path, **columns)
    sums = stored(rows.groupBy("chunk", "queue").agg(F.sum("n").alias("tokens")), "packing-sums")
    totals = {r["queue"]: r["tokens"] for r in sums.groupBy("queue").agg(F.sum("tokens").alias("tokens")).collect()}  # a row a source
    given = {f"s:{k}": v for k, v in (weights or {}).items()}
    plan, names = Schedule(totals, None if weights is None else given, window), named(totals, given, most_queues)
    earlier = W.partitionBy("queue").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("chunk", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    placed = rows.join(maybe_broadcast(starts, 64), ["chunk", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("queue", pa.string()), ("ids", pa.binary())])
    def run(batches):
        for batch in (b for whole in batches for b in bounded(whole)):
            cols = batch.to_pydict()
            out: dict[str, list] = {f.name: [] for f in schema}
            size = 0
            for doc_id, q, at, n, raw in zip(*(cols[c] for c in ("doc_id", "queue", "at", "n", "ids")), strict=True):
                j = plan.index[q]
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                for start, k, w, offset in plan.pieces(j, at, n):
                    for name, value in zip(out, (doc_id, start, k, n, w, offset, names.get(q, q), ids[4 * start : 4 * (start + k)]), strict=True):
                        out[name].append(value)
                size += len(ids)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, size = {f.name: [] for f in schema}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return placed.mapInArrow(released(run), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, queue string, ids binary")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


__all__ = ["Schedule", "pack_documents", "op1"]

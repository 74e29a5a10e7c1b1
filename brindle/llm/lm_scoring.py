"""Language-model scoring by deleted interpolation.

Model. The probability of a token w after h is l2 * c(h w) / c(h) + l1 * c(w) / N + l0 * (c(w) + 1) / (N + V + 1), with
weights that depend on the bucket of c(h) (its power of two). A text's history begins with its end token. Counts for the
weights come from six of the seven parts less one: documents with remainder 2 take no part in learning, those with
remainder 3 are the held-out counts on which expectation-maximisation fits the weights, the others give the maximum
likelihood estimates. The final estimates use both.

Plan. The corpus is cut into batches of about `batch_bytes` of text, each with its own word list, written once. A batch
asks a ledger (see ledger) about its distinct words and pairs, with their counts in it, so repeated words cost one entry a
batch however frequent they are. The ledger adds up the counts of all batches and answers every batch with the counts
of its n-grams: there is no join on words. Scoring then needs a batch and its answers alone. All counts cover all
of the corpus. For the weights, held-out tokens are added up in cells (bucket, log2 ratios of the estimates in
eighths), of which there are at most BUCKETS * 512 * 64, some 790,000, whatever the corpus.

n-grams are identified by 63-bit hashes, with one bit more for words or pairs.

Defined results. Null or empty text: the end token alone. Repeated rows and doc_ids: a row each. Null doc_id: its
text is "" in the split. Very long texts: whole, one batch each, some 40 bytes a word in a task. Other columns are not read,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, bounded, discard, mixed, small, stored, words_of
from .ledger import ASKED, ASKED_DDL, FAN_BITS, Ledger, asking, expand, expand_sorted, gathered, resolve, squeeze, squeeze_sorted

PARTS, SCORED_ONLY, HELD = 7, 2, 3
TEST, HELD_OUT, TRAIN = 0, 1, 2
BATCH_BYTES = 8 << 20
BLOCK = 1 << 17
BUCKETS, GRID = 24, 8
_WORDS = WordHashes(300_000)
_ONE, PAIR = np.uint64(1), np.uint64(1 << 63)
END = np.uint64(_WORDS[b"\n"]) >> _ONE
_A = np.uint64(0x9E3779B97F4A7C15)


def part_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % PARTS


TOKENS = pa.schema([("batch", pa.int64()), ("cls", pa.int32()), ("bytes", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])
TOKENS_DDL = "batch long, cls int, bytes long, doc_ids array<long>, lengths binary, words binary, tokens binary"


def _batches(batch_bytes: int):
    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {TEST: [[], [], 0], HELD_OUT: [[], [], 0], TRAIN: [[], [], 0]}

        def flush(cls):
            nonlocal count
            ids, arrays, size = held[cls]
            flat = np.concatenate(arrays)
            words, tokens = np.unique(flat, return_inverse=True)
            row = {"batch": [(task << 24) | count], "cls": [cls], "bytes": [size], "doc_ids": [ids], "lengths": [squeeze(np.array([len(a) for a in arrays], np.uint32))], "words": [squeeze_sorted(words)], "tokens": [squeeze(tokens.astype(np.uint32))]}
            count += 1
            held[cls] = [[], [], 0]
            return pa.RecordBatch.from_pydict(row, schema=TOKENS)

        for b in (part for whole in batches for part in bounded(whole)):
            cols = b.to_pydict()
            for doc_id, text in zip(cols["doc_id"], cols["text"], strict=True):
                p = part_of(doc_id)
                cls = TEST if p == SCORED_ONLY else HELD_OUT if p == HELD else TRAIN
                words = words_of(text)
                words.append(b"\n")
                mine = held[cls]
                mine[0].append(doc_id)
                mine[1].append(_WORDS.of(words) >> _ONE)
                mine[2] += len(text or "") + 1
                if mine[2] >= batch_bytes:
                    yield flush(cls)
        for cls in (TEST, HELD_OUT, TRAIN):
            if held[cls][0]:
                yield flush(cls)

    return run


def _pairs(words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of (h, w) for every token, index of h in words or -1 for the end token before a text)."""
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    starts = np.cumsum(lengths[:-1], dtype=np.int64)
    before[0] = -1
    before[starts] = -1
    h = words[before]
    h[before < 0] = END
    return (mixed(mixed(h) * _A + words[tokens]) >> _ONE) | PAIR, before


def _ask(batches):
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            words, tokens, lengths = expand_sorted(r["words"]), expand(r["tokens"], np.uint32), expand(r["lengths"], np.uint32)
            pairs, times = np.unique(_pairs(words, tokens, lengths)[0], return_counts=True)
            counts = np.concatenate([np.bincount(tokens, minlength=len(words)), times])
            none = np.zeros(len(counts), np.uint8)
            train, held = counts if r["cls"] == TRAIN else none, counts if r["cls"] == HELD_OUT else none
            yield pa.RecordBatch.from_pylist([asking(r["batch"], [np.concatenate([words, pairs]), train, held])], schema=ASKED)


def _sums(columns: list[np.ndarray], number: np.ndarray, n: int) -> list[np.ndarray]:
    starts = np.searchsorted(number, np.arange(n))
    return [np.add.reduceat(c, starts, dtype=np.uint64) if n else c for c in columns[1:]]


def _stats(columns: list[np.ndarray]) -> list[int]:
    """Distinct words and tokens: of the texts that estimate, and of all that are learned from."""
    words = columns[0] < PAIR
    train, both = columns[1][words], (columns[1] + columns[2])[words]
    return [int((train > 0).sum()), int(train.sum()), int((both > 0).sum()), int(both.sum())]


COUNTS = Ledger(values=(np.uint64, np.uint64), answers=(np.uint64, np.uint64), merge=_sums, decide=lambda columns: columns[1:], stats=_stats)


class Resolved:
    """One batch with the counts of its n-grams, and for each token the places of w, h and h w among them."""

    def __init__(self, tokens: pa.Table, told: pa.Table):
        self.row = r = tokens.to_pylist()[0]
        words, self.w = expand_sorted(r["words"]), expand(r["tokens"], np.uint32)
        self.lengths = expand(r["lengths"], np.uint32)
        self.train, self.held = gathered(told, COUNTS)
        pairs, before = _pairs(words, self.w, self.lengths)
        self.h = np.where(before < 0, np.searchsorted(words, END), before).astype(np.uint32)
        self.hw = (np.unique(pairs, return_inverse=True)[1] + len(words)).astype(np.uint32)

    def blocks(self, counts: np.ndarray):
        """(range of tokens, c(w), c(h), c(h w)), some tokens at a time, so that a batch's estimates take little memory."""
        for lo in range(0, len(self.w), BLOCK):
            at = slice(lo, min(lo + BLOCK, len(self.w)))
            yield at, *(counts[x[at]].astype(np.float64) for x in (self.w, self.h, self.hw))


def bucket_of(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _estimates(w, h, hw, v: int, n: int):
    """(bigram, unigram, add-one) probabilities of each token."""
    return np.divide(hw, h, out=np.zeros(len(w)), where=h > 0), w / max(n, 1), (w + 1) / (n + v + 1)


#: steps of the two estimates' ratios to the add-one one, and where 1 lies: from 2^-20 to 2^43, and from 2^-4 to 2^4, as
#: the unigram and the add-one estimates of a token differ by a factor of 3 at most
STEPS2, ONE2, STEPS1, ONE1 = 512, 160, 64, 31


def _cells(v: int, n: int):
    # step 0: no such n-gram
    grid = lambda f, f0, steps, one: np.where(f > 0, np.clip(np.round(GRID * np.log2(np.maximum(f, 1e-300) / f0)) + one, 1, steps - 1), 0).astype(np.int64)

    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        batch = Resolved(tokens, told)
        found = []
        for _, w, h, hw in batch.blocks(batch.train):
            f2, f1, f0 = _estimates(w, h, hw, v, n)
            found.append(np.unique((bucket_of(h) * STEPS2 + grid(f2, f0, STEPS2, ONE2)) * STEPS1 + grid(f1, f0, STEPS1, ONE1), return_counts=True))
        cells, times = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"cell": pa.array(cells, pa.int64()), "times": pa.array(times, pa.int64())})

    return run


def fit(cells: np.ndarray, times: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights[bucket, (bigram, unigram, add-one)] by expectation-maximisation over the cells."""
    weights = np.tile(np.array([0.6, 0.35, 0.05]), (BUCKETS, 1))
    weights[0] = (0.0, 0.85, 0.15)
    b, g2, g1 = cells // (STEPS2 * STEPS1), cells // STEPS1 % STEPS2, cells % STEPS1
    ratio = np.stack([np.where(g > 0, 2.0 ** ((g - one) / GRID), 0.0) for g, one in ((g2, ONE2), (g1, ONE1))] + [np.ones(len(cells))], axis=1)
    prior = 0.5 * weights
    for _ in range(rounds):
        part = weights[b] * ratio
        part *= (times / part.sum(axis=1))[:, None]
        new = prior.copy()
        np.add.at(new, b, part)
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(v: int, n: int, weights: np.ndarray):
    def run(tokens: pa.Table, told: pa.Table) -> pa.Table:
        batch = Resolved(tokens, told)
        size = len(batch.w)
        base, score, known = np.empty(size), np.empty(size), np.empty(size, np.int64)
        for at, w, h, hw in batch.blocks(batch.train + batch.held):
            f2, f1, f0 = _estimates(w, h, hw, v, n)
            by = weights[bucket_of(h)]
            base[at], known[at] = np.log10(f0), w > 0
            score[at] = np.log10(by[:, 0] * f2 + by[:, 1] * f1 + by[:, 2] * f0)
        starts = np.concatenate([[0], np.cumsum(batch.lengths[:-1], dtype=np.int64)])
        add = lambda x: np.add.reduceat(x, starts)
        k = len(starts)
        return pa.Table.from_pydict({"doc_id": batch.row["doc_ids"], "held_out": [batch.row["cls"] == TEST] * k, "n_tokens": batch.lengths.astype(np.int64), "n_known": add(known), "train_tokens": [n] * k, "base_score": add(base), "score": add(score)}, schema=SCORES)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, fan_bits: int = FAN_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stored(rows.mapInArrow(_batches(batch_bytes), TOKENS_DDL), "lm-tokens")
    total = tokens.agg(F.sum("bytes")).first()[0] or 0
    asked = tokens.select("batch", "cls", "lengths", "words", "tokens").mapInArrow(_ask, ASKED_DDL)
    told, read = resolve(asked, total // batch_bytes, COUNTS, fan_bits)
    counts = stored(told, "lm-counts")
    for t in read:
        discard(t)
    sums = counts.where("batch is null").select(*[F.sum(F.col("stats")[k]) for k in range(4)]).first()
    v_train, n_train, v, n = (x or 0 for x in sums)
    counts = counts.where("batch is not null").select("batch", "bucket", "answers")
    held = tokens.where(F.col("cls") == HELD_OUT)
    told = counts.join(F.broadcast(held.select("batch")), "batch", "left_semi") if small(held, 16) else counts.join(held.select("batch"), "batch", "left_semi")
    cells = held.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_cells(v_train, n_train), "cell long, times long")
    cells = cells.groupBy("cell").agg(F.sum("times").alias("times")).toPandas()  # BUCKETS * STEPS2 * STEPS1 rows at most
    weights = fit(cells["cell"].to_numpy(np.int64), cells["times"].to_numpy(np.float64))
    return tokens.groupBy("batch").cogroup(counts.groupBy("batch")).applyInArrow(_score(v, n, weights), SCORES_DDL)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

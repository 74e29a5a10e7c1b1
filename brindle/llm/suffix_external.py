"""Suffix arrays of shards by external induced sorting, with common-prefix values.

A shard's text, types and run lengths lie in files; suffix tuples pass through priority queues that spill sorted runs to
disk. The substrings between leftmost S-type suffixes are sorted by such a queue and named; the names make a shorter text,
which is solved by recursion. From the order of these suffixes one queue induces the L-type suffixes, ascending, and
another the S-type ones, descending. A tuple carries its common-prefix value with its predecessor in its bucket: one more
than the smallest value between the two suffixes that induced them, read from a stack of range minima. Values are exact
up to `most`. The values of the first order are compared in the text.

What has to fit in memory: the symbols that a shard is made from (8 bytes each), the places and names of its leftmost
suffixes, the order that a recursion returns, range minima, all (suffix, common prefix) tuples of the descending pass, and
the final order. Only the queues and the shard's own text, types and run lengths are on disk.

Files are made in `folder`, which the caller names, and are deleted when they have been read.
"""

from __future__ import annotations

import os
import pickle
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import numpy as np

from .suffix_dedup import LENGTH, union


class DiskQueue:
    """The smallest item first. Beyond `most` items in memory, they are written as one sorted run; runs are merged."""

    def __init__(self, folder: str, most: int = 1 << 16):
        self.folder, self.most = folder, most
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []
        self.runs = 0

    def push(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.most:
            self.heap.sort()
            path = f"{self.folder}/run-{uuid.uuid4().hex}"
            with open(path, "wb") as f:
                for k in range(0, len(self.heap), 1024):
                    pickle.dump(self.heap[k : k + 1024], f, pickle.HIGHEST_PROTOCOL)
            self.heap = []
            self.runs += 1
            items = self._read(path)
            heappush(self.heads, (next(items), self.runs, items))

    @staticmethod
    def _read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while True:
                try:
                    some = pickle.load(f)
                except EOFError:
                    break
                yield from some
        os.remove(path)

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run, items = self.heads[0]
            after = next(items, None)
            if after is None:
                heappop(self.heads)
            else:
                heapreplace(self.heads, (after, run, items))
            return item
        return heappop(self.heap)


class Minima:
    """Smallest value since a place in a growing sequence: a stack whose values ascend."""

    def __init__(self):
        self.at, self.value, self.n = [], [], 0

    def add(self, value: int) -> int:
        while self.value and self.value[-1] >= value:
            self.at.pop()
            self.value.pop()
        self.at.append(self.n)
        self.value.append(value)
        self.n += 1
        return self.n - 1

    def since(self, place: int) -> int:
        """The smallest value after `place`."""
        return self.value[bisect_right(self.at, place)]


class Shard:
    """One text of symbols (integers; the last one is the smallest and alone) and what is known about it, in files."""

    def __init__(self, symbols: np.ndarray, folder: str, queue: int):
        self.n, self.folder, self.queue = len(symbols), folder, queue
        self.files: list[str] = []
        self.text = self._file(np.int64)
        self.text[:] = symbols
        self.s_type, self.run = self._file(np.bool_), self._file(np.int64)
        self.s_type[-1], self.run[-1] = True, 1
        later, rising, length = int(self.text[-1]), True, 1
        for i in range(self.n - 2, -1, -1):
            c = int(self.text[i])
            rising = rising if c == later else c < later
            length = length + 1 if c == later else 1
            self.s_type[i], self.run[i], later = rising, length, c

    def _file(self, dtype) -> np.memmap:
        path = f"{self.folder}/shard-{uuid.uuid4().hex}"
        self.files.append(path)
        return np.memmap(path, dtype, "w+", shape=(self.n,))

    def close(self) -> None:
        for path in self.files:
            os.remove(path)
        self.files = []

    def leftmost(self) -> np.ndarray:
        s = np.asarray(self.s_type)
        return np.flatnonzero(s[1:] & ~s[:-1]) + 1 if self.n > 1 else np.array([0])

    def first_order(self) -> np.ndarray:
        """The leftmost S-type suffixes in order, by names of the substrings between them and by recursion."""
        places = self.leftmost()
        q = DiskQueue(self.folder, self.queue)
        for k, p in enumerate(places.tolist()):
            end = int(places[k + 1]) + 1 if k + 1 < len(places) else self.n
            q.push((tuple((2 * self.text[p:end] + self.s_type[p:end]).tolist()), k))
        names, name, last = np.zeros(len(places), np.int64), -1, None
        while q:
            substring, k = q.pop()
            name += substring != last
            names[k], last = name, substring
        if name + 1 == len(places):
            return places[np.argsort(names)]
        inner = Shard(names, self.folder, self.queue)
        try:
            return places[[i for i, _ in inner.suffixes(0)]]
        finally:
            inner.close()

    def common(self, i: int, j: int, most: int) -> int:
        a, b = self.text[i : i + most], self.text[j : j + most]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    def _induce(self, seeds: Iterator[tuple[int, int]], most: int, rising: bool) -> Iterator[tuple[int, int, bool]]:
        """(suffix, common prefix with the one before it, whether a seed): seeds and the suffixes of one type that they induce.

        Ascending for the L type and descending for the S type (`rising`); a seed comes with its common prefix with the seed before it.
        """
        q, sign = DiskQueue(self.folder, self.queue), -1 if rising else 1
        seen: dict[int, int] = {}  # symbol -> place of the last suffix that induced one there
        minima, count, before, was_seed = Minima(), 0, -1, False
        seed = next(seeds, None)
        while seed is not None or q:
            head = None if seed is None else (sign * int(self.text[seed[0]]), 1)
            induced = q.pop() if q else None
            if induced is not None and (head is None or induced[:2] < head):
                i, common, is_seed = induced[3], induced[4], False
            else:
                if induced is not None:
                    q.push(induced)
                (i, common), is_seed = seed, True
                seed = next(seeds, None)
            if before < 0 or self.text[before] != self.text[i]:
                common = 0
            elif was_seed != is_seed:
                common = min(int(self.run[before]), int(self.run[i]), most)
            place = minima.add(common)
            yield i, common, is_seed
            before, was_seed = i, is_seed
            if i and bool(self.s_type[i - 1]) == rising:
                c = int(self.text[i - 1])
                mine = min(most, 1 + minima.since(seen[c])) if c in seen else 0
                seen[c] = place
                q.push((sign * c, 0, count, i - 1, mine))
                count += 1

    def _seeds(self, most: int) -> Iterator[tuple[int, int]]:
        before = -1
        for i in self.first_order().tolist():
            yield i, self.common(before, i, most) if most and before >= 0 else 0
            before = i

    def suffixes(self, most: int) -> list[tuple[int, int]]:
        """(suffix, common prefix with the next smaller suffix, up to `most`), ascending."""
        kept = f"{self.folder}/larger-{uuid.uuid4().hex}"
        with open(kept, "wb") as f:
            for i, common, is_seed in self._induce(self._seeds(most), most, False):
                if not is_seed:
                    f.write(np.array([i, common], "<i8").tobytes())
        larger = np.memmap(kept, "<i8", "r").reshape(-1, 2) if os.path.getsize(kept) else np.zeros((0, 2), np.int64)

        def down() -> Iterator[tuple[int, int]]:
            later = 0
            for k in range(len(larger) - 1, -1, -1):
                yield int(larger[k, 0]), later
                later = int(larger[k, 1])

        # descending, a suffix's value is the one with the suffix above it: shifted by one when turned round
        falling = [(i, common) for i, common, _ in self._induce(self._last(down()), most, True)]
        os.remove(kept)
        return [(i, falling[k + 1][1] if k + 1 < len(falling) else 0) for k, (i, _) in reversed(list(enumerate(falling)))]

    def _last(self, seeds: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """The seeds, and after them the suffix of the last symbol alone, which nothing induces."""
        yield from seeds
        yield self.n - 1, 0


def repeated_spans(raws: list[bytes], folder: str, length: int = LENGTH, queue: int = 1 << 16) -> list[np.ndarray]:
    """For each text of a shard its maximal spans [lo, hi) covered by `length`-byte strings that start elsewhere too."""
    if not raws:
        return []
    ends = np.cumsum([len(r) + 1 for r in raws])
    symbols = np.zeros(int(ends[-1]), np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for k, (raw, at) in enumerate(zip(raws, starts.tolist(), strict=True)):
        # each text ends with a symbol of its own, so no match crosses an end; the last text's is the smallest
        symbols[at : at + len(raw)] = np.frombuffer(raw, np.uint8) + np.int64(len(raws))
        symbols[at + len(raw)] = (k + 1) % len(raws)
    shard = Shard(symbols, folder, queue)
    try:
        order = shard.suffixes(length)
    finally:
        shard.close()
    places = np.array([i for i, _ in order])
    near = np.array([c for _, c in order]) >= length
    twice = np.sort(places[near | np.append(near[1:], False)])
    out = []
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        mine = twice[np.searchsorted(twice, a) : np.searchsorted(twice, z)] - a
        out.append(np.stack(union(mine, mine + length), axis=1))
    return out

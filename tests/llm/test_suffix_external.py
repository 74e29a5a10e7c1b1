"""External induced sorting against sorted suffixes, with queues so small that they spill."""

import os
import random

import numpy as np

from brindle.llm.suffix_external import DiskQueue, Shard, repeated_spans


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_queue_spills_and_merges(tmp_path):
    q, rng = DiskQueue(str(tmp_path), 7), random.Random(1)
    items = [(rng.randrange(50), k) for k in range(200)]
    for x in items[:150]:
        q.push(x)
    got = [q.pop() for _ in range(40)]
    assert got == sorted(items[:150])[:40]
    for x in items[150:]:
        q.push(x)
    rest = sorted(sorted(items[:150])[40:] + items[150:])
    assert [q.pop() for _ in range(len(rest))] == rest and not q and q.runs > 0
    assert os.listdir(tmp_path) == []


def test_suffixes_and_common_prefixes(tmp_path):
    rng = random.Random(2)
    for trial in range(60):
        text = [rng.randrange(1, rng.choice((2, 3, 5))) + 1 for _ in range(rng.randrange(0, 60))] + [0]
        shard = Shard(np.array(text), str(tmp_path), rng.choice((3, 16, 1000)))
        got = shard.suffixes(1000)
        shard.close()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert [i for i, _ in got] == want, trial
        assert [c for _, c in got] == [0] + [common(text[a:], text[b:]) for a, b in zip(want, want[1:], strict=False)], trial
        assert os.listdir(tmp_path) == []


def test_repeated_spans_equal_brute_force(tmp_path):
    rng = random.Random(3)
    for _ in range(12):
        raws = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(1, 6))]
        got = repeated_spans(raws, str(tmp_path), length=5, queue=8)
        windows = [r[i : i + 5] for r in raws for i in range(len(r) - 4)]
        for raw, spans in zip(raws, got, strict=True):
            gone = np.zeros(len(raw) + 5, bool)
            for i in range(len(raw) - 4):
                if windows.count(raw[i : i + 5]) > 1:
                    gone[i : i + 5] = True
            mine = np.zeros(len(gone), bool)
            for lo, hi in spans.tolist():
                mine[lo:hi] = True
            assert (gone == mine).all()

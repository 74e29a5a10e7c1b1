"""Packing, repeated passages, near-duplicates, language-model scores, quality rules and the pipeline, by brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe_tree, common, fingerprints, ledger, lm_scoring, near_duplicates, packing, quality_rules, suffix_dedup, token_counts
from brindle.llm.tokenizer_files import encoder

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return WORD.findall(bytes((text or "").encode()).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL).repartition(3)


def corpus(seed=1, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = make(90)
    out = [None, "", "   \n ", "one", "One TWO", "a b c", "a b c"]
    for _ in range(n):
        t = make(rng.randrange(5, 250))
        if rng.random() < 0.3:
            cut = rng.randrange(len(t))
            t = t[:cut] + passage[rng.randrange(60) :] + t[cut:]
        out.append(t)
    for _ in range(n // 2):
        base = out[rng.randrange(7, len(out))].split(" ")
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        out.append(" ".join(base))
    out += [passage] * 6 + ["é" * 150 + "日本" * 40, "x" * 500, "x" * 300, "ab" * 400]
    return out


# -- packing -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [None, {"s0": 0.6, "s1": 0.3, "s2": 0.1}, {"s1": 1.0}])
def test_packing_is_whole_and_mixed(spark, weights):
    texts, window = corpus(), 64
    pieces = packing.pack_documents(frame(spark, texts), window=window, weights=weights).collect()
    enc = encoder(packing.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t in enumerate(texts):
        ids = np.append(np.frombuffer(enc.encode(t), "<u4"), packing.END_ID).astype("<u4")
        mine = sorted(by_doc[i], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in mine) == ids.tobytes()
        at = 0
        for p in mine:
            assert (p.start, p.doc_tokens, len(p.ids)) == (at, len(ids), 4 * p.length)
            at += p.length
    last = max(by_seq)
    assert sorted(by_seq) == list(range(last + 1))
    for w, ps in by_seq.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or w == last and at <= window
    if weights is None:
        total = Counter()
        for p in pieces:
            total[p.queue] += p.length
        for w in range(last):
            mine = Counter()
            for p in by_seq[w]:
                mine[p.queue] += p.length
            for q, n in total.items():
                assert abs(mine[q] - window * n / sum(total.values())) <= len(total) + 1


def test_packing_deals_many_sources_to_bounded_queues(spark):
    rows = [(i, f"text {i}", "en", f"source{i}", 6) for i in range(60)]
    df = spark.createDataFrame(rows, DDL)
    pieces = packing.pack_documents(df, window=16, most_queues=8).collect()
    assert len({p.queue for p in pieces}) <= 8 and {p.doc_id for p in pieces} == set(range(60))
    assert packing.pack_documents(df.where("false")).count() == 0


def test_packing_mixes_every_one_of_many_sources(spark):
    """Over 256 sources: each window holds each source at its target, the one with a third of all rows too."""
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(20)), "en", "hot" if i % 3 == 0 else f"source{i % 400}", 1) for i in range(1500)]
    window = 512
    of = {r[0]: r[3] for r in rows}
    for weights in (None, {"hot": 0.5, "source1": 0.25, "source2": 0.25}):
        pieces = packing.pack_documents(spark.createDataFrame(rows, DDL).repartition(3), window=window, weights=weights).collect()
        assert all(p.queue == "s:" + of[p.doc_id] for p in pieces)
        tokens, by_seq = defaultdict(int), defaultdict(Counter)
        filled = defaultdict(int)
        for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
            assert p.offset == filled[p.sequence_id]
            filled[p.sequence_id] += p.length
            tokens[p.queue] += p.length
            by_seq[p.sequence_id][p.queue] += p.length
        last, total = max(by_seq), sum(tokens.values())
        assert len(tokens) > 256 and all(filled[w] == window for w in range(last)) and 0 < filled[last] <= window
        ids = defaultdict(list)
        for p in pieces:
            ids[p.doc_id].append((p.start, p.length, p.doc_tokens))
        assert len(ids) == len(rows)
        assert all(sum(x[1] for x in v) == v[0][2] and [x[0] for x in sorted(v)] == list(np.cumsum([0] + [x[1] for x in sorted(v)])[:-1]) for v in ids.values())
        if weights is None:
            seen = Counter()
            for w in range(last):
                seen.update(by_seq[w])
                for q, n in tokens.items():
                    assert abs(by_seq[w][q] - window * n / total) <= 4
                    assert abs(seen[q] - (w + 1) * window * n / total) <= 4
        else:
            assert abs(by_seq[0]["s:hot"] - window / 2) <= 4
    plan = packing.Schedule({f"s{k}": 1 + 10**6 // (k + 1) for k in range(20000)}, window=4096)
    assert max(len(plan._way(0, j)) for j in range(0, 20000, 97)) < 64


# -- repeated passages -------------------------------------------------------------------------------------------------


def removed(texts, length=200):
    """(n_removed, n_spans, kept) of each text by looking at every window."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((int(gone.sum()), spans, bytes(b for b, g in zip(r, gone[:-1], strict=True) if not g)))
    return out


def test_repeats_equal_brute_force(spark):
    texts = corpus(3, 60) + ["z" * 199, "z" * 200, "q" * 201, "abc" * 67 + "d", "abc" * 67]
    rows = suffix_dedup.with_spans(frame(spark, texts)).collect()
    got = {r.doc_id: suffix_dedup.cut(bytes(r.text), r.spans) for r in rows}
    assert len(rows) == len(texts)
    for i, (n, spans, kept) in enumerate(removed(texts)):
        assert got[i] == (kept, n, spans), i


def test_repeats_of_rows_in_several_batches_meet_all_their_edges(spark, monkeypatch):
    """As on a cluster, the batches reach the buckets in different orders, so the copies of a row stand for different runs."""
    rng = random.Random(14)
    make = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    twice = make(6000)
    texts = [make(150) + twice[k : k + 210] + make(150) for k in range(100, 5700, 400)]
    final = ledger._final

    def in_any_order(asked):
        return lambda table: final(asked)(table.sort_by([("batch", "descending" if table.column("bucket")[0].as_py() % 2 else "ascending")]))

    monkeypatch.setattr(ledger, "_final", in_any_order)
    for key in (99, None):
        rows = [(key, twice, "en", "s", 6000)] + [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(key, twice, "en", "s", 6000)]
        found = suffix_dedup.with_spans(spark.createDataFrame(rows, DDL).coalesce(2)).collect()
        got = {r.doc_id: suffix_dedup.cut(bytes(r.text), r.spans) for r in found}
        want = removed([r[1] for r in rows])
        assert len(found) == len(rows)
        for r, (n, spans, kept) in zip(rows, want, strict=True):
            assert got[r[0]] == (kept, n, spans), r[0]


def test_repeats_keep_columns_and_null_ids(spark):
    passage = "shared passage " * 20
    rows = [(1, "a " + passage, "en", "s", 1), (2, passage + "b", "en", "s", 1), (None, "clean", None, None, None), (4, None, "en", "s", 0), (4, None, "en", "s", 0)]
    out = suffix_dedup.drop_repeats(spark.createDataFrame(rows, DDL)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in out) == [(0, "clean", None), (1, "a ", 2), (2, "b", 1), (4, "", 0), (4, "", 0)] or {r.doc_id for r in out} == {1, 2, 4, None}
    assert next(r.text for r in out if r.doc_id == 1).strip() == "a"
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], DDL)).count() == 0


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def linked(texts, width, percent):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


@pytest.mark.parametrize(("width", "percent", "permutations"), [(3, 85, 32), (5, 80, 48)])
def test_near_duplicates_equal_all_pairs(spark, width, percent, permutations):
    texts = corpus(4, 60)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(frame(spark, texts), width, percent, permutations).collect()}
    sizes, roots = linked(texts, width, percent)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (sizes[i], roots[i], roots[i] == i), i


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """A doc_id with several texts is one node; repeated rows and rows without words or an id change nothing."""
    rng = random.Random(18)
    make = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    a, b, c, d = make(), make(), make(), make()
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (9, None), (12, c), (12, c), (14, c.upper()), (20, ""), (20, " "), (None, a), (None, None), (30, d), (31, None)]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string").repartition(3)
    got = near_duplicates.near_duplicates(df).collect()
    assert len(got) == 2 * len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (12, 12), (14, 12), (20, 20), (None, None), (30, 30), (31, 31)}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    clash = df.withColumns({"__row": F.lit("x"), "__key": F.lit("y"), "component_id": F.lit(7), "kept": F.lit(False)})
    kept = near_duplicates.drop_near_duplicates(clash)
    assert kept.columns == clash.columns
    left = Counter((r.doc_id, (r.text or "").strip()) for r in kept.collect())
    # other texts under an id stay unless they are near one that stays
    assert left == Counter({(1, a): 1, (5, b): 1, (9, ""): 1, (12, c): 1, (20, ""): 2, (None, ""): 1, (30, d): 1, (31, ""): 1})
    again = suffix_dedup.drop_repeats(clash)
    assert again.columns == clash.columns and {r["__key"] for r in again.collect()} == {"y"}


def test_near_duplicates_of_a_chain_and_of_ties(spark):
    words = [f"t{i}" for i in range(120)]
    texts = []
    for k in range(12):
        words[10 * k] = f"changed{k}"
        texts.append(" ".join(words))
    texts += texts[:3] + [None, "", "two words", "Two WORDS"]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(frame(spark, texts)).collect()}
    sizes, roots = linked(texts, 3, 85)
    assert [got[i].component_id for i in range(len(texts))] == roots
    kept = near_duplicates.drop_near_duplicates(frame(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_duplicates.near_duplicates(frame(spark, texts).where("false")).count() == 0


# -- language model ----------------------------------------------------------------------------------------------------


def test_scores_equal_brute_force(spark):
    texts = corpus(6, 80)
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, texts), batch_bytes=4000).collect()}
    tokens = [[*words_of(t), b"\n"] for t in texts]
    part = [zlib.crc32(str(i).encode()) % 7 for i in range(len(texts))]
    counts = Counter(w for i, t in enumerate(tokens) if part[i] != 2 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part[i] == 2, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    # the weights by expectation-maximisation over each held-out token, not over cells of them
    def count(parts):
        c1, c2 = Counter(), Counter()
        for i, t in enumerate(tokens):
            if part[i] in parts:
                c1.update(t)
                c2.update(zip([b"\n", *t], t, strict=False))
        return c1, c2, sum(c1.values()), len(c1)

    def estimates(c1, c2, n, v, h, w):
        return (c2[h, w] / c1[h] if c1[h] else 0.0, c1[w] / n, (c1[w] + 1) / (n + v + 1)), c1[h].bit_length()

    learned = count({0, 1, 4, 5, 6})
    seen = [estimates(*learned, h, w) for i, t in enumerate(tokens) if part[i] == 3 for h, w in zip([b"\n", *t], t, strict=False)]
    start = [(0.0, 0.85, 0.15) if b == 0 else (0.6, 0.35, 0.05) for b in range(lm_scoring.BUCKETS)]
    weights = [list(x) for x in start]
    for _ in range(40):
        new = [[0.5 * x for x in row] for row in start]
        for f, b in seen:
            total = sum(x * y for x, y in zip(weights[b], f, strict=True))
            for k in range(3):
                new[b][k] += weights[b][k] * f[k] / total
        weights = [[x / sum(row) for x in row] for row in new]
    final = count({0, 1, 3, 4, 5, 6})
    for i, t in enumerate(tokens):
        want = 0.0
        for h, w in zip([b"\n", *t], t, strict=False):
            f, b = estimates(*final, h, w)
            want += math.log10(sum(x * y for x, y in zip(weights[b], f, strict=True)))
        assert math.isclose(got[i].score, want, rel_tol=0.01, abs_tol=0.02), i


def test_scores_and_repeats_are_the_same_through_levels_of_buckets(spark, monkeypatch):
    """Small fans make three levels; none has more rows than its batches times the fan."""
    texts = corpus(17, 80)
    df = frame(spark, texts)
    tall = {r.doc_id: r for r in lm_scoring.score_documents(df, batch_bytes=3000, fan_bits=1).collect()}
    flat = {r.doc_id: r for r in lm_scoring.score_documents(df, batch_bytes=3000).collect()}
    assert set(tall) == set(flat)
    for i, r in flat.items():
        assert tall[i][:5] == r[:5] and math.isclose(tall[i].base_score, r.base_score) and math.isclose(tall[i].score, r.score), i
    made, stored = [], ledger.stored
    monkeypatch.setattr(ledger, "stored", lambda df, name: made.append((name, stored(df, name))) or made[-1][1])
    got = {r.doc_id: suffix_dedup.cut(bytes(r.text), r.spans) for r in suffix_dedup.with_spans(df, batch_bytes=4000, fan_bits=1).collect()}
    for i, (n, spans, kept) in enumerate(removed(texts)):
        assert got[i] == (kept, n, spans), i
    assert len([name for name, _ in made if name == "ledger-rows"]) >= 3


def test_a_ledger_sends_no_more_rows_than_batches_times_the_fan(spark, monkeypatch):
    """At twice the batches, each level has about twice the rows."""
    rng = np.random.default_rng(5)
    kept, sizes = ledger.discard, []
    monkeypatch.setattr(ledger, "discard", lambda df: None)
    stored = ledger.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "ledger-rows":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(ledger, "stored", counted)
    rows = {}
    for n in (8, 16):
        sizes.clear()
        asked = [ledger.asking(k, [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)), np.ones(300, np.uint8), np.zeros(300, np.uint8)]) for k in range(n)]
        df = spark.createDataFrame([(r["batch"], r["keys"], r["values"]) for r in asked], ledger.ASKED_DDL)
        told = ledger.resolve(df, n, lm_scoring.COUNTS, fan_bits=2)[0].where("batch is not null")
        assert sum(len(ledger.expand_small(bytes(r.answers[0]), np.uint64)) for r in told.collect()) == 300 * n
        assert all(s <= 4 * n for s in sizes) and sizes
        rows[n] = list(sizes)
    assert kept is not None and sum(rows[16]) <= 3 * sum(rows[8])


def test_a_task_of_the_repeats_takes_one_python_worker(spark, monkeypatch):
    """One mapInArrow after another would take two a task."""
    kept, plans = suffix_dedup.resolve, []

    def seen(*args, **named):
        out = kept(*args, **named)
        plans.append(out[0]._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(suffix_dedup, "resolve", seen)
    suffix_dedup.with_spans(frame(spark, corpus(3, 20))).collect()
    assert len(plans) == 2 and all(p.count("MapInArrow") == 1 for p in plans)


def test_the_repeats_reach_python_in_short_batches(spark, monkeypatch):
    name, seen, kept = "spark.sql.execution.arrow.maxBytesPerBatch", [], suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, to: (seen.append(spark.conf.get(name, None)), kept(df, to))[1])
    suffix_dedup.with_spans(frame(spark, corpus(3, 20)))
    assert set(seen) == {str(2 << 20)} and spark.conf.get(name, None) is None


def test_a_task_gives_back_what_it_freed():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    last = []

    def fn(batches):
        some = [random.randbytes(1000) for _ in range(100_000)]
        last.append(random.randbytes(1000))  # above the others, so they'd stay
        yield from batches
        assert len(some) == 100_000

    before = held()
    assert list(common.released(fn)(iter([1, 2]))) == [1, 2]
    assert held() - before < 50_000_000


def test_weights_are_learned_and_help(spark):
    rng = random.Random(8)
    follows = {f"a{i}": f"b{i}" for i in range(50)}
    texts = []
    for _ in range(300):
        line = []
        for _ in range(30):
            w = f"a{rng.randrange(50)}"
            line += [w, follows[w]]
        texts.append(" ".join(line))
    rows = [r for r in lm_scoring.score_documents(frame(spark, texts)).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.7 * sum(r.base_score for r in rows)


def test_expectation_maximisation_finds_the_mixture():
    cell = lambda bucket, g2, g1: (bucket * lm_scoring.STEPS2 + g2) * lm_scoring.STEPS1 + g1
    cells = np.array([cell(5, lm_scoring.GRID * 3 + lm_scoring.ONE2, lm_scoring.ONE1), cell(5, 0, lm_scoring.ONE1)])
    weights = lm_scoring.fit(cells, np.array([900.0, 100.0]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[5, 0] > 0.7


# -- quality rules -----------------------------------------------------------------------------------------------------


def measures(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_equal_brute_force(spark):
    texts = corpus(7, 30) + ["a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "#*$%&|<>" * 9, "é b  c\x0bd\x0ce", "w " * 120, "a b " * 60 + "🙂"]
    for r in quality_rules.judge(frame(spark, texts)).collect():
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_quality_passes_columns_through_and_stays_native(spark):
    rows = [(1, "the cat " + " ".join(f"word{i}" for i in range(80)), 5), (None, None, 6), (None, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long")
    assert [tuple(r) for r in quality_rules.filter_documents(df).collect()] == [rows[0]]
    plan = quality_rules.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_filters_long_documents_and_clashing_columns(spark):
    """A document of thousands of words ends soon: its arrays are made once and not for each of their elements."""
    rng = random.Random(16)
    long = " ".join(rng.choice(("the", "of", f"word{rng.randrange(4000)}", f"other{rng.randrange(4000)}")) for _ in range(6000))
    rows = [(1, long, 5, "x", True), (None, long, None, None, None), (2, "short", 1, "y", True), (3, None, 1, "z", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Words long, row string, kept boolean")
    kept = quality_rules.filter_documents(df)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.N_Words or 0) for r in kept.collect()) == [(0, 0), (1, 5)]
    assert {r.doc_id for r in quality_rules.judge(df).where("kept and n_repeat_words < 5000").collect()} == {1, None}
    judged = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert judged[1].n_words == 6000 and judged[1].kept and not judged[2].kept and "N_Words" not in judged[1]
    assert quality_rules.filter_documents(df.where("false")).count() == 0 == quality_rules.judge(df.where("false")).count()


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    stop = "the of and to in is that it was for".split()
    texts = []
    for _ in range(40):
        texts.append(" ".join(rng.choice(stop) if rng.random() < 0.3 else f"word{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))))
    shared = " ".join(f"common{i}" for i in range(40))
    long = " ".join(rng.choice(stop) if rng.random() < 0.3 else f"long{rng.randrange(9000)}" for _ in range(5000))
    texts += [t + " " + shared for t in texts[:5]] + [texts[7], texts[8] + " end", None, "", "short", long, long + " " + shared]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = {r.doc_id: r.text for r in quality_rules.judge(frame(spark, texts)).where("kept").collect()}
    ids = sorted(kept)
    roots = linked([kept[i] for i in ids], 5, 80)[1]
    ids = [i for k, i in enumerate(ids) if roots[k] == k]
    left = [x[2] for x in removed([kept[i] for i in ids])]
    enc = encoder(packing.default_path())
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    assert sorted(by_doc) == ids
    for i, raw in zip(ids, left, strict=True):
        want = enc.encode(raw.decode("utf-8", "ignore")) + np.array([packing.END_ID], "<u4").tobytes()
        assert b"".join(bytes(p.ids) for p in sorted(by_doc[i], key=lambda p: p.start)) == want


def test_pipeline_keeps_one_row_of_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    stop = "the of and to in is that it was for".split()
    make = lambda: " ".join(rng.choice(stop) if rng.random() < 0.3 else f"word{rng.randrange(3000)}" for _ in range(120))
    texts = [make() for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    unnamed, other = make(), make()
    rows += [(20, texts[0], "en", "s", 1), (3, other, "en", "s", 2), (None, texts[1], "en", "s", 3)]
    rows += [(None, t, lang, "s", 4) for t in (unnamed, unnamed + " end", unnamed.replace(" ", "  ", 3)) for lang in ("en", "de")]
    df = spark.createDataFrame(rows, DDL)
    df.union(df).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    by_doc = defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        by_doc[p.doc_id].append((p.doc_tokens, p.start, p.sequence_id, p.offset, bytes(p.ids)))
    enc = encoder(packing.default_path())
    assert set(by_doc) == {*range(8), None}
    for i, pieces in by_doc.items():
        want = [other, texts[3]] if i == 3 else [t for t in (unnamed, unnamed + " end", unnamed.replace(" ", "  ", 3))] if i is None else [texts[i]]
        sizes = [len(enc.encode(t)) // 4 + 1 for t in want]
        # one row for each text, all of it; of the three near texts without a doc_id, one
        assert sum(len(p[-1]) // 4 for p in pieces) in sizes if i is None else sum(len(p[-1]) // 4 for p in pieces) == sum(sizes), i
    kept = near_duplicates.drop_near_duplicates(df.union(df).repartition(3)).collect()
    again = near_duplicates.drop_near_duplicates(df.union(df).repartition(5)).collect()
    assert len(kept) == 10 and Counter(map(tuple, kept)) == Counter(map(tuple, again))
    assert [r.lang for r in kept if r.doc_id is None] == ["de"]


# -- registered queries --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole(spark, sf_dir):
    """doc_id -> text of the whole table, and the ids in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text for r in docs}, [r.doc_id for r in docs]


def asked(spark, sf_dir, name):
    from brindle.llm.queries import QUERIES

    return QUERIES[name](spark, sf_dir).collect()


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def test_op1_equals_the_library(spark, sf_dir, whole):
    texts, order = whole
    tok, pieces, filled = library("word_bpe_49k.json"), defaultdict(list), Counter()
    for r in asked(spark, sf_dir, "op1_mixture_packing"):
        pieces[r.doc_id].append(r)
        filled[r.sequence_id] += r.length
    assert sorted(pieces) == order and all(n == 4096 for w, n in filled.items() if w != max(filled)) and filled[max(filled)] <= 4096
    for i in order:
        ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_op2_equals_the_library(spark, sf_dir, whole):
    import public_tokenizers
    import sentencepiece

    texts, order = whole
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in asked(spark, sf_dir, "op2_token_counts")}
    assert sorted(got) == order
    for i in order:
        n = len(sp.encode(texts[i] or ""))
        assert got[i] == (len((texts[i] or "").encode()), n, n > 4096)


def test_op3_equals_the_pages(spark, sf_dir):
    import base64

    first, want = {}, []
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").orderBy("page_id").collect():
        raw = (r.html or "").encode()
        at = first.setdefault(raw, r.page_id)
        want.append((r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if at == r.page_id else "revisit", None if at == r.page_id else at))
    assert sorted(tuple(r) for r in asked(spark, sf_dir, "op3_warc_boundary_chain")) == want


def test_op4_equals_brute_force(spark, sf_dir, whole):
    texts, order = whole
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op4_repeated_passages")}
    for i, (n, spans, kept) in zip(order, removed([texts[i] for i in order]), strict=True):
        assert (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n, spans, hashlib.sha256(kept).hexdigest())


def test_op5_equals_the_library(spark, sf_dir, whole):
    texts, order = whole
    tok = library("word_bpe_49k.json")
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op5_bpe_tree")}
    assert sorted(got) == order
    for i in order:
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids
        read = tok.decode(ids, skip_special_tokens=False).encode()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(read).hexdigest())


def test_op6_equals_its_definition(spark, sf_dir, whole):
    texts, order = whole
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op6_multiset_fingerprints")}
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for text, mark in ((t, r.fingerprint), (edited, r.edited_fingerprint)):
            # the exact part by sums of whole numbers
            lines = [b" ".join(x.split()) for x in text.encode().split(b"\n") if x.split()]
            hashes = [hashlib.shake_256(x).digest(64) for x in lines]
            lanes = [sum(int.from_bytes(h[8 * j : 8 * j + 8], "little") for h in hashes) % 2**64 for j in range(8)]
            assert mark[:144] == b"".join(x.to_bytes(8, "little") for x in [*lanes, len(lines)]).hex()
        for text, near in ((edited, r.near_edited), (nxt, r.near_next)):
            # the likeness from the windows themselves, which the lanes estimate
            u, v = (Counter(w for x in y.encode().split(b"\n") if (ws := [b"", b"", *x.split()]) for w in zip(ws, ws[1:], ws[2:], strict=False) if w[2]) for y in (t, text))
            both = sum(n * n for n in u.values()) + sum(n * n for n in v.values())
            exact = 2 * sum(n * v[w] for w, n in u.items()) / both if both else float(t == text)
            assert abs(near - exact) < 0.45 and 0 <= near <= 1
    assert len({r.fingerprint for r in got.values()}) == len({tuple(sorted(b" ".join(x.split()) for x in (t or "").encode().split(b"\n") if x.split())) for t in texts.values()})


def test_op7_equals_brute_force(spark, sf_dir, whole):
    texts, order = whole
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op7_deleted_interpolation")}
    tokens = {i: [*words_of(texts[i]), b"\n"] for i in order}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in order}
    counts = Counter(w for i in order if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i in order:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[i]), rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_op9_equals_all_pairs(spark, sf_dir, whole):
    texts, order = whole
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op9_minmax_near_dup")}
    sizes, roots = linked([texts[i] for i in order], 3, 85)
    assert [(got[i].n_shingles, got[i].component_id) for i in order] == [(s, order[r]) for s, r in zip(sizes, roots, strict=True)]


def test_op10_equals_brute_force(spark, sf_dir, whole):
    texts, order = whole
    got = {r.doc_id: r for r in asked(spark, sf_dir, "op10_quality_rules")}
    for i in order:
        r, want = got[i], measures(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    """Each operator on a table with null ids and texts, repeated rows and columns named like its own."""
    rows = [(None, "one two three " * 5), (None, None), (1, ""), (1, ""), (2, "one two three " * 5), (2, "another text")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "ids", "queue", "hash", "place", "bytes", "batch", "n_tokens", "seg", "kind", "doc_key", "score")})
    made = {
        "op1": packing.pack_documents(df),
        "op2": token_counts.count_tokens(df, long_chars=20),
        "op5": bpe_tree.encode_documents(df, long_chars=20, segment=8, decoded=True),
        "op6": fingerprints.compare_with_next(df),
        "op7": lm_scoring.score_documents(df),
        "op4": suffix_dedup.with_spans(df),
        "op10": quality_rules.judge(df),
    }
    for name, out in made.items():
        got = Counter(r.doc_id for r in out.collect())
        assert got == Counter({None: 4, 1: 4, 2: 4}), name
    empty = df.where("false")
    for out in (packing.pack_documents(empty), token_counts.count_tokens(empty), bpe_tree.encode_documents(empty), fingerprints.compare_with_next(empty), lm_scoring.score_documents(empty), suffix_dedup.with_spans(empty), near_duplicates.drop_near_duplicates(empty)):
        assert out.count() == 0


def test_tables_too_large_to_broadcast_are_dealt_out(spark, monkeypatch):
    from brindle.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
    texts = corpus(19, 30)
    rows = suffix_dedup.with_spans(frame(spark, texts)).collect()
    got = {r.doc_id: suffix_dedup.cut(bytes(r.text), r.spans) for r in rows}
    assert all(got[i] == (kept, n, spans) for i, (n, spans, kept) in enumerate(removed(texts)))


def test_the_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from brindle.llm.common import shared_dir

    kept = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(kept)

"""Token counts, BPE, fingerprints, WARC and chat formatting against the libraries or brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from brindle.llm import bpe_tree, chat_format, fingerprints, token_counts, warc
from brindle.llm.tokenizer_files import encoder

ODD = [
    None,
    "",
    " ",
    "a",
    "x" * 9000,
    "ab" * 5000 + " tail",
    "é" * 3000 + "ß" * 50,
    "日本語のテキスト " * 40,
    "<|endoftext|> and <|startoftext|>x",
    "  two  spaces\t\ttabs\n\nlines \r\n",
    "it's we'll don't I'M x1y2z3 ½ 3.14!?",
    "́combining é ​zero ﻿bom",
    "▁ mark ▁▁ and \x00 nul",
    "🙂🙃" * 700,
    "</s><s><unk> <0x0A>",
]


def texts():
    rng = random.Random(5)
    out = list(ODD)
    alphabet = "abcdefghij  .,\n'éß日🙂1234"
    for n in (1, 7, 60, 900, 6000):
        out += ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(4)]
    return out


def frame(spark, rows, name="text"):
    return spark.createDataFrame(list(enumerate(rows)), f"doc_id long, {name} string")


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_path())
    rows = texts()
    for long_chars in (1 << 20, 500):
        got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, rows), long_chars=long_chars).collect()}
        assert len(got) == len(rows)
        for i, t in enumerate(rows):
            assert got[i].n_tokens == len(sp.encode(t or "")), (i, (t or "")[:40])
            assert got[i].n_bytes == len((t or "").encode())
            assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_chunks_splice_and_overlaps_widen():
    c = token_counts.PieceCounter(token_counts.default_path(), chunk=64, overlap=1)
    for text in ("x" * 5000, "abc" * 3000, "aaaaabaaaab" * 400, "日本" * 900, "🙂" * 700):
        want = len(c.part.encode(text))
        assert len(c.spliced(text)) == want
    assert c.widened > 0


def test_encoding_and_decoding_equal_the_library(spark):
    path = bpe_tree.default_path()
    rows = texts()
    for long_chars, segment in ((1 << 20, 1 << 16), (400, 128)):
        made = bpe_tree.decode_documents(bpe_tree.encode_documents(frame(spark, rows), long_chars=long_chars, segment=segment))
        got = {r.doc_id: r for r in made.collect()}
        assert len(got) == len(rows)
        for i, t in enumerate(rows):
            n, ids, text = bpe_tree.digests(t, path)
            r = got[i]
            assert (len(r.ids) // 4, hashlib.sha256(bytes(r.ids)).hexdigest(), hashlib.sha256(r.decoded.encode()).hexdigest()) == (n, ids, text), (i, (t or "")[:40])


def test_tree_of_halves_equals_one_pass():
    enc = encoder(bpe_tree.default_path())
    rng = random.Random(3)
    for _ in range(20):
        word = "".join(rng.choice("abeilnorst") for _ in range(rng.randrange(2049, 4000)))
        assert enc.encode_unsplit(word, leaf=rng.choice((7, 64, 1024))) == enc.tok.encode(word, add_special_tokens=False).ids


def test_fingerprints_add_and_remove():
    a, b = "one two three four\nfive six seven", "another line of words"
    whole = fingerprints.written(fingerprints.vector(a + "\n" + b))
    assert fingerprints.add(fingerprints.written(fingerprints.vector(a)), b) == whole
    assert fingerprints.remove(whole, b) == fingerprints.written(fingerprints.vector(a))
    swapped = "five six seven\n" + b + "\none two three four"
    assert fingerprints.written(fingerprints.vector(swapped)) == whole


def test_fingerprints_compare_with_the_next_document(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    rows = [None, "", "same text", "same text", "é🙂" * 30] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 300))) for _ in range(30)]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.written(fingerprints.vector(t))
        assert r.edited_fingerprint == fingerprints.written(fingerprints.vector(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1
    long = [r for r in got.values() if r.n_chars > 600]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def test_fingerprints_of_long_repetitive_texts(spark):
    rows = ["same " * 40000, "other words"]
    r = min(fingerprints.compare_with_next(frame(spark, rows)).collect())
    # u = 39,998 and v = about 20,000 in each lane: 2uv / (uu + vv)
    assert abs(r.near_edited - 0.8) < 0.01
    whole = fingerprints.written(fingerprints.vector(rows[0] + "\n" + rows[1]))
    assert fingerprints.add(r.fingerprint, rows[1]) == whole and fingerprints.remove(whole, rows[1]) == r.fingerprint


def test_one_document_and_no_document(spark):
    (r,) = fingerprints.compare_with_next(frame(spark, ["abcdef"])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprints.compare_with_next(frame(spark, ["a"]).where("false")).count() == 0
    assert token_counts.count_tokens(frame(spark, ["a"]).where("false")).count() == 0
    assert bpe_tree.encode_documents(frame(spark, ["a"]).where("false")).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


EVIL = warc.record(77, "http://evil", "inner", None) + "\n"


HTML = ["<p>a</p>", "<p>a</p>", None, "", "é🙂\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", EVIL, EVIL * 3, "WARC/1.1\r\n" * 50, "x" * 40000, "line\nfeed\r\n", (EVIL + "y" * 700) * 9]


@pytest.mark.parametrize(("compression", "part_bytes"), [("gzip", 1 << 27), ("none", 1 << 27), ("none", 3000), ("none", 400)])
def test_warc_round_trip(spark, tmp_path, compression, part_bytes):
    """Whole files and parts that begin in the middle of records which hold records."""
    rows = [(i, f"http://h/{i} \n", h) for i, h in enumerate(HTML)] + [(3, None, "again"), (3, None, "again"), (20, "u", "<p>a</p>"), (None, "u", "<p>b</p>")]
    path = str(tmp_path / "w")
    warc.write_warc(pages(spark, rows).coalesce(2), path, file_bytes=50_000, compression=compression)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = sorted(warc.read_warc(spark, path).collect(), key=lambda r: (r.page_id or -1, r.payload_digest))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got) == len(rows)
    smallest = {}
    for i, _, h in rows:
        if i is not None:
            smallest[h or ""] = min(i, smallest.get(h or "", i))
    for r, (i, _, h) in zip(got, sorted(rows, key=lambda x: (x[0] or -1, warc.digest((x[2] or "").encode()))), strict=True):
        raw = (h or "").encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = smallest.get(h or "", i)
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
        assert r.payload is None if r.refers_to is not None else bytes(r.payload) == raw


def test_warc_of_no_pages_and_broken_files(spark, tmp_path):
    empty = str(tmp_path / "none")
    warc.write_warc(pages(spark, [(1, "u", "a")]).where("false"), empty)
    assert warc.read_warc(spark, empty).count() == 0
    whole = (warc.record(1, None, EVIL, None) + "\n" + warc.record(2, None, "b", None) + "\n").encode()
    for name, data in (("short", whole[:-1]), ("long", whole + b"x"), ("late", b"x" + whole)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(data)
        with pytest.raises(Exception, match=r"chain of records is broken|no record at the start"):
            warc.read_warc(spark, str(tmp_path / name)).collect()


def test_warc_chain_rejects_what_payloads_hold():
    # candidates at 10, 40, 60 and 90; what begins at 40 is inside the first record, as is what leads on from it
    starts, to = np.array([10, 40, 60, 90]), np.array([60, 55, 90, 120])
    assert warc.reached(starts, to, 10, 120).tolist() == [True, False, True, True]
    assert warc.exits(starts, to).tolist() == [120, -1, 120, 120]
    assert warc.exits(starts[:2], to[:2]).tolist() == [60, 55]
    with pytest.raises(ValueError):
        warc.reached(starts, to, 10, 119)


def test_chat_round_trip_and_loss(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a<|b", "<||", "<<||>|", None, "", "x\n<|im_sep|>", "<|||n"]
    rows = []
    rng = random.Random(2)
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", "system", "a\n<|n", "", None]), rng.choice(said)))
    rows += rows[:10]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.with_loss(chat_format.parse_conversations(chat_format.format_conversations(df))).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, _, r, x in want]
        assert list(got[conv].loss) == [x for _, _, r, x in want if r == "assistant"]
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_chat_stays_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.with_loss(chat_format.parse_conversations(chat_format.format_conversations(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

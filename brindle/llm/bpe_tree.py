"""BPE encoding and decoding. Long unsplit text is encoded by tree concatenation: parts apart, then windows around each join.

Documents longer than `long_chars` are dealt out: their words are cut into segments which any task can encode, a word
longer than a segment into several that are marked as joined; one group a document then joins them pairwise.

Defined results. Null or empty text: no ids, decoded as the empty text. Repeated rows and doc_ids: one row each. Null
doc_id: kept. Special strings in a text are special tokens, as the library's default is. An empty table gives an empty
table. Very long texts: one document's ids, and eight bytes a token of its longest word, are joined in one task. Other
columns are not read and not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows
from .tokenizer_files import LONG_WORD, PLAIN, WORD, encoder, word_letters

LONG_CHARS = 1 << 20
SEGMENT_CHARS = 1 << 16


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _segments(path: str, segment: int):
    """(doc_key, doc_id, seg, letters or text, kind): plain runs of whole words, or pieces of one long word."""

    def run(cols: dict):
        enc = encoder(path)
        for key, doc_id, text in zip(cols["doc_key"], cols["doc_id"], cols["text"], strict=True):
            rows: list[tuple[str, str]] = []
            parts = enc.special_re.split(text) if enc.special_re else [text]
            for part in parts:
                if part in enc.specials:
                    rows.append(("special", part))
                    continue
                if PLAIN.fullmatch(part):
                    words = WORD.finditer(part.lower())
                else:
                    import regex

                    words = regex.finditer(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", enc.tok.normalizer.normalize_str(part))
                run_words, size = [], 0
                for m in words:
                    w = m[0]
                    if len(w) > LONG_WORD:
                        if run_words:
                            rows.append(("words", "\n".join(run_words)))
                            run_words, size = [], 0
                        letters = word_letters(w, enc.letters)
                        for a in range(0, len(letters), segment):
                            last = a + segment >= len(letters)
                            rows.append(("last" if last else "first" if a == 0 else "inner", letters[a : a + segment]))
                        continue
                    run_words.append(w)
                    size += len(w) + 1
                    if size >= segment:
                        rows.append(("words", "\n".join(run_words)))
                        run_words, size = [], 0
                if run_words:
                    rows.append(("words", "\n".join(run_words)))
            rows = rows or [("words", "")]
            for a in range(0, len(rows), 64):
                some = rows[a : a + 64]
                yield {"doc_key": [key] * len(some), "doc_id": [doc_id] * len(some), "seg": list(range(a, a + len(some))), "kind": [k for k, _ in some], "body": [b for _, b in some]}

    return run


def _encode_segments(path: str):
    def run(cols: dict):
        enc = encoder(path)
        ids, sizes, bodies = [], [], []
        for kind, body in zip(cols["kind"], cols["body"], strict=True):
            joins = kind in ("first", "inner", "last")
            if joins:
                found = enc.tree(body, kind == "last", 1024)
                ids.append(found[0].astype("<u4").tobytes())
                sizes.append(found[1].astype("<u4").tobytes())
            elif kind == "special":
                ids.append(np.array([enc.specials[body]], "<u4").tobytes())
            else:
                # words were found in the normalised text; each one is a word by itself, so line feeds may stand between
                ids.append(b"".join([enc.encode_word(w) for w in body.split("\n")]) if body else b"")
            bodies.append(body if joins else None)
            sizes += [] if joins else [None]
        yield cols | {"body": bodies, "ids": ids, "sizes": sizes}

    return run


def _join_document(path: str, decoded: bool):
    def run(table: pa.Table) -> pa.Table:
        enc = encoder(path)
        out, word = [], []

        def flush():
            parts = [tuple(np.frombuffer(r[c], "<u4") for c in ("ids", "sizes")) for r in word]
            cuts = list(accumulate((len(r["body"]) for r in word), initial=0))
            out.append(enc.joined("".join(r["body"] for r in word), cuts, parts, True)[0].astype("<u4").tobytes())
            word.clear()

        for batch in table.sort_by("seg").to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                if r["kind"] in ("first", "inner", "last"):
                    word.append(r)
                    if r["kind"] == "last":
                        flush()
                else:
                    out.append(r["ids"])
        ids = b"".join(out)
        found = {"doc_id": pa.array([table.column("doc_id")[0].as_py()], pa.int64()), "ids": pa.array([ids], pa.binary())}
        return pa.table(found | ({"decoded": pa.array([enc.decode(ids)], pa.string())} if decoded else {}))

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS, segment: int = SEGMENT_CHARS, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), in no order; with decoded also the text read back from the ids.

    Reading back in the same pass saves a second Python worker a task, with an encoder and a cache of its own.
    """
    path = path or default_path()
    rows = _columns(docs, id_col, text_col)
    short = rows.where(F.coalesce(F.length("text") <= long_chars, F.lit(True)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.string())] if decoded else [])])
    made = "doc_id long, ids binary" + (", decoded string" if decoded else "")

    def plain(cols: dict):
        enc = encoder(path)
        ids = [enc.encode(t) for t in cols["text"]]
        yield {"doc_id": cols["doc_id"], "ids": ids} | ({"decoded": [enc.decode(x) for x in ids]} if decoded else {})

    whole = short.mapInArrow(by_rows(plain, schema, rows=256), made)
    long_rows = rows.where(F.length("text") > long_chars).withColumn("doc_key", F.monotonically_increasing_id())
    parts_schema = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("seg", pa.int64()), ("kind", pa.string()), ("body", pa.string())])
    ddl = "doc_key long, doc_id long, seg long, kind string, body string"
    parts = long_rows.mapInArrow(by_rows(_segments(path, segment), parts_schema, rows=1), ddl).repartition("doc_key", "seg")
    full = pa.schema([*parts_schema, ("ids", pa.binary()), ("sizes", pa.binary())])
    encoded = parts.mapInArrow(by_rows(_encode_segments(path), full, rows=256), ddl + ", ids binary, sizes binary")
    joined = encoded.groupBy("doc_key").applyInArrow(_join_document(path, decoded), made)
    return whole.unionByName(joined)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded, the text the library gives for the ids with special tokens kept."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(cols: dict):
        enc = encoder(path)
        yield {"doc_id": cols["doc_id"], "ids": cols["ids"], "decoded": [enc.decode(x) for x in cols["ids"]]}

    return encoded.mapInArrow(by_rows(run, schema, rows=256), "doc_id long, ids binary, decoded string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    return read.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def digests(text: str | None, path: str) -> tuple[int, str, str]:
    """The same figures for one text by the library alone, for tests."""
    tok = encoder(path).tok
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()

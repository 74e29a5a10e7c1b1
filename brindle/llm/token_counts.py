"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced after a token that both
have at the same place: each two neighbours of the splice are then neighbours in one of the encodings, and greedy
merging of two tokens runs inside a longer text as it does alone until a merge crosses out of them, so the splice is
what encoding at once gives. Where the overlap has no such token, it is widened and encoded again.

This vocabulary has no piece with a word mark after another character, so no merge crosses from a character into a
following space. Such places are stable without an overlap: texts are cut there, the parts are looked up, and only
parts longer than `chunk` characters need splicing. Documents over `long_chars` are dealt out to tasks at such places.

Defined results. Null text: empty, 0 bytes, 0 tokens. Repeated rows and doc_ids, null doc_ids: one row each. Very long
texts: one document's text in the task that cuts it up, a quarter of `long_chars` in those that count. Other columns are
not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows

LONG_CHARS = 1 << 20
LIMIT = 4096
MARK = "▁"
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts pieces exactly as the library does for a whole text."""

    def __init__(self, path: str, most_cached: int = 1_000_000, chunk: int = 16384, overlap: int = 64):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        # later fields win: the same model without the mark that stands for a space before the text
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.part = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a\x02\x18\x00")
        pieces = (self.whole.id_to_piece(i) for i in range(self.whole.get_piece_size()))
        self.cuttable = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.most, self.chunk, self.overlap = most_cached, chunk, overlap
        self.cache: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.widened = 0

    def parts(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece can lie across."""
        seen = MARK + text.replace(" ", MARK)
        return _PART.findall(seen) if self.cuttable else [seen]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cuttable and "  " not in text and MARK not in text and text[0] != " ":
            words = text.split(" ")  # each is a part, after its mark
            try:
                return sum([self.words[w] for w in words])
            except KeyError:
                pass
            if len(self.words) > self.most:
                self.words.clear()
            fresh = [w for w in set(words) if w not in self.words]
            found = dict(zip(fresh, self._counts([MARK + w for w in fresh]), strict=True))
            self.words.update((w, n) for w, n in found.items() if len(w) <= 64)
            return sum([found[w] if w in found else self.words[w] for w in words])
        return self.count_parts(self.parts(text))

    def _counts(self, parts: list[str]) -> list[int]:
        ids = iter(self.part.encode([p for p in parts if len(p) <= self.chunk], num_threads=1))
        return [len(next(ids)) if len(p) <= self.chunk else len(self.spliced(p)) for p in parts]

    def count_parts(self, parts: list[str]) -> int:
        cache = self.cache
        try:
            return sum([cache[p] for p in parts])
        except KeyError:
            pass
        if len(cache) > self.most:
            cache.clear()
        fresh = list({p for p in parts if p not in cache})
        other = dict(zip(fresh, self._counts(fresh), strict=True))
        cache.update((p, n) for p, n in other.items() if len(p) <= 64)
        return sum([other[p] if p in other else cache[p] for p in parts])

    def ends(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of each piece, in bytes of the whole; byte pieces of one character count as that character's parts."""
        out, where = [], at
        for piece in self.part.encode(text, out_type=str):
            n = 1 if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">") else len(piece.encode())
            out.append((where, where + n))
            where += n
        return out

    def spliced(self, text: str, chunk: int | None = None, overlap: int | None = None) -> list[tuple[int, int]]:
        """Piece spans of a text of any length that no stable place cuts."""
        chunk, overlap = chunk or self.chunk, overlap or self.overlap
        n = len(text)
        done = self.ends(text[:chunk], 0)
        pos = min(chunk, n)
        byte_pos = len(text[:pos].encode())
        while pos < n:
            width = overlap
            while True:
                lo = max(0, pos - width)
                byte_at = byte_pos - len(text[lo:pos].encode())
                new = self.ends(text[lo : pos + chunk], byte_at)
                known = _tail(done, byte_at)
                hit = next(((known[s], j) for j, s in enumerate(new) if s in known), None)
                if hit or lo == 0:
                    break
                width *= 4
                self.widened += 1
            if hit:
                del done[hit[0] :]
                done += new[hit[1] :]
            else:
                done = new
            step = text[pos : pos + chunk]
            pos += len(step)
            byte_pos += len(step.encode())
        return done


def _tail(spans: list[tuple[int, int]], at: int) -> dict[tuple[int, int], int]:
    out, i = {}, len(spans) - 1
    while i >= 0 and spans[i][0] >= at:
        out[spans[i]] = i
        i -= 1
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_path()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def plain(cols: dict):
        c = counter(path)
        yield {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": [c.count(t) for t in cols["text"]]}

    short = rows.where(F.length("text") <= long_chars).mapInArrow(by_rows(plain, schema), "doc_id long, n_bytes long, n_tokens long")

    # huge documents: runs of parts go to different tasks, their counts are added
    cut = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("seg", pa.int64()), ("body", pa.string())])

    def deal(cols: dict):
        c = counter(path)
        for key, doc_id, n_bytes, text in zip(cols["doc_key"], cols["doc_id"], cols["n_bytes"], cols["text"], strict=True):
            bodies, some, size = [], [], 0
            for p in c.parts(text):
                some.append(p)
                size += len(p)
                if size >= long_chars // 4:
                    bodies.append("".join(some))
                    some, size = [], 0
            bodies += ["".join(some)] if some else []
            for seg, body in enumerate(bodies):
                yield {"doc_key": [key], "doc_id": [doc_id], "n_bytes": [n_bytes], "seg": [seg], "body": [body]}

    counted = pa.schema([("doc_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def add(cols: dict):
        c = counter(path)
        n = [c.count_parts(_PART.findall(b) if c.cuttable else [b]) for b in cols["body"]]
        yield {"doc_key": cols["doc_key"], "doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": n}

    dealt = rows.where(F.length("text") > long_chars).withColumn("doc_key", F.monotonically_increasing_id())
    dealt = dealt.mapInArrow(by_rows(deal, cut), "doc_key long, doc_id long, n_bytes long, seg long, body string").repartition("doc_key", "seg")
    long = dealt.mapInArrow(by_rows(add, counted), "doc_key long, doc_id long, n_bytes long, n_tokens long")
    long = long.groupBy("doc_key", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens")).drop("doc_key")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

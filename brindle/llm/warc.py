"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing. Spark's own text writer makes the files, so any file system that Spark reaches will do: a row is one record,
and the record's last line feed is the writer's line separator. Files are gzip streams of about `file_bytes` before
compression. Of records with equal payloads the one with the smallest page_id is a response and the others are
revisits, without the payload, that name it in WARC-Refers-To.

Reading. Spark's text reader cuts files at the version line, which may also stand in payloads, and plain files into parts
that different tasks read (compressed ones are one part each). A line's place follows from the lengths before it.

1. A task takes each line as a candidate record; its header gives the candidate's successor. Pointer jumping inside the
   part replaces the successor by the first one outside of it: a part emits (candidate, exit) offsets, without payloads.
2. The links of a file's parts meet, and pointer jumping from the start of the file retains the reachable ones. The chain
   has to end where the file ends, else reading fails with the file's name. Each part learns where the chain enters it.
3. Tasks read their parts again and follow the chain from there, so version lines and whole records inside payloads are
   never looked at. Records that lie across parts are put together from the pieces of each.

A file's links are 16 bytes a candidate in one task; a record's pieces meet in one task.

Defined results. Null or empty html: a payload of 0 bytes, and such pages are revisits of the first of them. Repeated
page_ids: a row each; those with the smallest id and equal payloads are all responses. Null page_id: written as such,
never the smallest while others have one. Control characters in a url are percent-encoded; null url: none. Other columns are
not read, whatever their names. An empty table: no records. Very long pages: a row's payload in one task.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import accumulate, groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, discard, shared_path, small, stored

MAGIC = b"WARC/1.1\r\n"
FILE_BYTES = 24 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> str:
    """The record without its last line feed."""
    raw = payload.encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    block = len(http.encode()) + (0 if refers_to is not None else len(raw))
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append(f"WARC-Payload-Digest: sha1:{digest(raw)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {block}"]
    return "\r\n".join(head) + "\r\n\r\n" + http + ("" if refers_to is not None else payload) + "\r\n\r"


def plan_revisits(pages: DataFrame) -> DataFrame:
    """page_id, payload (sha1 hex), refers_to: the pages that are revisits. Only ids and digests are dealt out."""
    keys = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("payload"))
    groups = keys.groupBy("payload").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return keys.join(groups, "payload").where("page_id is null or page_id > refers_to").select("page_id", "payload", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, compression: str = "gzip") -> None:
    """pages: page_id, url, html. Writes a folder of WARC files; compression: gzip or none."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    revisits = stored(plan_revisits(rows), "warc-revisits")
    n, total = rows.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    a_file = max(1, int(file_bytes / max(1.0, (total or 0) / max(1, n) + 500)))
    keyed = rows.withColumn("payload", F.sha1(F.col("html").cast("binary")))
    few = small(revisits, 96)
    side = F.broadcast(revisits) if few else revisits
    on = keyed["page_id"].eqNullSafe(side["page_id"]) & (keyed["payload"] == side["payload"])
    decided = keyed.join(side, on, "left").select(keyed["page_id"], "url", "html", "refers_to")
    schema = pa.schema([("value", pa.string())])

    def run(batches):
        for b in batches:
            c = b.to_pydict()
            yield pa.RecordBatch.from_pydict({"value": [record(*x) for x in zip(c["page_id"], c["url"], c["html"], c["refers_to"], strict=True)]}, schema=schema)

    decided.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", compression).option("maxRecordsPerFile", a_file).text(path)


def successor(head: bytes | None, at: int) -> int:
    """Where the text after the next record's version line begins, for a record whose own begins at `at`; -1: the header isn't whole."""
    if head is None:
        return -1
    size = -1
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            size = int(value)
    return at + len(head) + 4 + size + 4 + len(MAGIC) if size >= 0 else -1


def doubled(jump: np.ndarray) -> np.ndarray:
    """Where each place ends up when its pointer is followed until it points to itself."""
    for _ in range(max(1, len(jump).bit_length())):
        jump = jump[jump]
    return jump


def exits(starts: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For candidates at ascending starts with successors `to`: the first place on each one's chain past the last start; -1: none."""
    n = len(starts)
    if not n:
        return to
    at = np.minimum(np.searchsorted(starts, to), n - 1)
    inside = to <= starts[-1]
    known = inside & (starts[at] == to)
    return np.where(inside, -1, to)[doubled(np.where(known, at, np.arange(n)))]


def reached(starts: np.ndarray, to: np.ndarray, first: int, end: int) -> np.ndarray:
    """Which candidates are on the chain from `first` to `end`, by pointer jumping. Raises where the chain doesn't end there."""
    n = len(starts)
    at = np.searchsorted(starts, to)
    known = starts[np.minimum(at, n - 1)] == to
    # n: the end of the file; n + 1: nowhere
    jump = np.append(np.where(to == end, n, np.where(known, at, n + 1)), [n, n + 1])
    on = np.zeros(n + 2, bool)
    on[:n] = starts == first
    if not on.any():
        raise ValueError("no record at the start")
    for _ in range((n + 1).bit_length()):
        on[jump[np.flatnonzero(on)]] = True
        jump = jump[jump]
    if not on[n] or on[n + 1]:
        raise ValueError("the chain of records is broken")
    return on[:n]


def parse(data: bytes) -> dict:
    """A record from the text after its version line. A response's payload is checked against its length and digest."""
    head_text, _, block = data.partition(b"\r\n\r\n")
    head = {}
    for line in head_text.split(b"\r\n"):
        name, _, value = line.partition(b":")
        head[name.strip().lower().decode()] = value.strip().decode()
    http_head, _, payload = block[:-4].partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http_head.split(b"\r\n")[1:])}
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > len("<urn:page:>") else None
    r = {"page_id": number(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to")), "payload": payload if head["warc-type"] == "response" else None, "payload_bytes": int(http[b"content-length"]), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
    if r["payload"] is not None and (len(payload) != r["payload_bytes"] or digest(payload) != r["payload_digest"]):
        raise ValueError(f"the payload of record {r['page_id']} isn't whole")
    return r


FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
DDL = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


LINKS = pa.schema([("file", pa.string()), ("part", pa.int64()), ("bytes", pa.int64()), ("starts", pa.binary()), ("exits", pa.binary())])
LINKS_DDL = "file string, part long, bytes long, starts binary, exits binary"
ENTRIES = pa.schema([("file", pa.string()), ("part", pa.int64()), ("base", pa.int64()), ("entry", pa.int64()), ("before", pa.int64())])
ENTRIES_DDL = "file string, part long, base long, entry long, before long"


def parts_of(batches):
    """((file, part), rows) of each part in turn; rows: dicts of its lines in order."""
    lines = ((r for b in batches for part in bounded(b, rows=256) for r in part.to_pylist()))
    return groupby(lines, key=lambda r: (r["file"], r["part"]))


def _links(batches):
    """Step 1. Offsets are those of the texts after version lines, from the part's first line on."""
    for (file, part), lines in parts_of(batches):
        starts, to, at = [], [], 0
        for k, r in enumerate(lines):
            # what stands before a file's first version line is no record
            if part or k:
                starts.append(at)
                to.append(successor(r["head"], at))
            elif r["size"]:
                raise ValueError(f"{file}: no record at the start")
            at += r["size"] + len(MAGIC)
        starts, to = np.array(starts, "<i8"), np.array(to, "<i8")
        row = {"file": file, "part": part, "bytes": at, "starts": starts.tobytes(), "exits": exits(starts, to).astype("<i8").tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=LINKS)


def _entries(table: pa.Table) -> pa.Table:
    """Step 2, for one file: where the chain enters each part, or -1, and where it is next on from the part's beginning."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    base = list(accumulate((r["bytes"] for r in rows), initial=0))
    read = lambda name: [np.frombuffer(r[name], "<i8") for r in rows]
    starts = [b + x for b, x in zip(base[:-1], read("starts"), strict=True)]
    out = [np.where(x >= 0, b + x, -1) for b, x in zip(base[:-1], read("exits"), strict=True)]
    every = np.concatenate(starts)
    try:
        on = every[reached(every, np.concatenate(out), len(MAGIC), base[-1])]
    except ValueError as e:
        raise ValueError(f"{rows[0]['file']}: {e}") from None
    # exits lead from part to part, so there is one place a part at most
    at = np.searchsorted(on, base[:-1])
    after = [int(on[k]) if k < len(on) else base[-1] for k in at]
    entry = [a - b if a < e else -1 for a, b, e in zip(after, base[:-1], base[1:], strict=True)]
    return pa.table({"file": [r["file"] for r in rows], "part": [r["part"] for r in rows], "base": base[:-1], "entry": entry, "before": after}, schema=ENTRIES)


PIECES = pa.schema([*FIELDS, ("file", pa.string()), ("part", pa.int64()), ("next", pa.int64()), ("piece", pa.binary())])
PIECES_DDL = DDL + ", file string, part long, next long, piece binary"


def _records(batches):
    """Step 3. Whole records, and the pieces of those that lie across parts, known by where the record after them begins."""
    for (file, part), lines in parts_of(batches):
        rows, size = [], 0
        held, at, base, due, told = [], 0, 0, -1, False  # the record being read, and where the next one begins

        def done(held, due, whole):
            return parse(MAGIC.join(held)) if whole else {"file": file, "part": part, "next": due, "piece": MAGIC.join(held)}

        for k, r in enumerate(lines):
            if not k:
                base, due = r["base"], r["before"]
            if base + at == due:
                if held:
                    rows.append(done(held, due, told))
                    size += sum(map(len, held))
                due, told, held = successor(r["value"].partition(b"\r\n\r\n")[0], base + at), True, []
            if part or k:
                held.append(r["value"])
            at += len(r["value"]) + len(MAGIC)
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=PIECES)
                rows, size = [], 0
        if held:
            rows.append(done(held, due, told and base + at == due))
        yield pa.RecordBatch.from_pylist(rows, schema=PIECES)


def _put_together(table: pa.Table) -> pa.Table:
    pieces = sorted(table.select(["part", "piece"]).to_pylist(), key=lambda r: r["part"])
    return pa.Table.from_pylist([parse(MAGIC.join(r["piece"] for r in pieces))], schema=pa.schema(FIELDS))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records on the verified chain of every file of a folder."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"))
    head = F.substring_index("value", "\r\n\r\n", 1)
    heads = lines.select("file", "part", F.octet_length("value").cast("long").alias("size"), F.when(F.octet_length(head) < F.octet_length("value"), head.cast("binary")).alias("head"))
    links = stored(heads.mapInArrow(_links, LINKS_DDL), "warc-links")
    entries = stored(links.groupBy("file").applyInArrow(_entries, ENTRIES_DDL), "warc-entries")
    split = entries.groupBy("file").count().where("count > 1").limit(1).count() > 0
    discard(links)
    texts = lines.select(F.col("value").cast("binary").alias("value"), "file", "part")
    if small(entries, 400):
        placed = texts.join(F.broadcast(entries), ["file", "part"])
    else:
        # dealt out and put back in order
        numbered = texts.withColumn("line", F.monotonically_increasing_id())
        placed = numbered.join(entries.hint("shuffle_hash"), ["file", "part"]).sortWithinPartitions("file", "part", "line")
    found = placed.select("file", "part", "base", "before", "value").mapInArrow(_records, PIECES_DDL)
    names = [f for f, _ in FIELDS]
    if not split:
        return found.select(*names)
    found = stored(found, "warc-records")
    across = found.where("piece is not null").groupBy("file", "next").applyInArrow(_put_together, DDL)
    return found.where("piece is null").select(*names).unionByName(across)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Keeping a collection up to date: latest row by key, deletes, expiry, from batches or a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: str, version: str) -> DataFrame:
    """The newest change of each key: max_by combines before the shuffle, so a hot key doesn't gather in one task."""
    row = F.struct(*[F.col(f"`{c}`") for c in changes.columns])
    tie = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in changes.columns])
    return changes.groupBy(key).agg(F.max_by(row, F.struct(F.col(version), tie)).alias("r")).select("r.*")


def upsert(base: DataFrame, changes: DataFrame, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """base with each key's newest change in its place; a change with `deleted` true takes the key away."""
    new = latest(changes, key, version)
    kept = base.join(new.select(key), key, "left_anti")
    fresh = new.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else new
    return kept.unionByName(fresh.select(*base.columns))


def live(df: DataFrame, expire: str, now: float | None = None) -> DataFrame:
    """Rows that haven't expired; a null expiry never does."""
    at = F.lit(now) if now is not None else F.unix_timestamp().cast("double")
    return df.where(F.col(expire).isNull() | (F.col(expire) > at))


class LiveTable:
    """A versioned Parquet table that a stream upserts into; readers see whole versions only.

    Rows lie in buckets by a hash of their key. A batch writes anew the buckets that it touches and then moves the pointer,
    which names each bucket's folder; so a batch costs what it touches, and one that runs again after a failure writes the
    same version again: results don't depend on how often it ran. clean() removes folders that no version kept names.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, deleted: str | None = None, on_change: Callable[[DataFrame], None] | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.version, self.deleted, self.on_change, self.buckets = spark, path.rstrip("/"), key, version, deleted, on_change, buckets

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("batch long, folders map<string, string>").json(f"{self.path}/versions")

    def _current(self) -> tuple[int, dict[int, str]] | None:
        try:
            row = self._pointers().orderBy(F.col("batch").desc()).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return (row["batch"], {int(b): f for b, f in (row["folders"] or {}).items()}) if row else None

    def _folder(self, name: str, bucket: int) -> str:
        return f"{self.path}/{name}/__bucket={bucket}"

    def _load(self, folders: dict[int, str]) -> DataFrame | None:
        """The rows of some buckets."""
        return self.spark.read.parquet(*[self._folder(f, b) for b, f in folders.items()]) if folders else None

    def read(self) -> DataFrame:
        now = self._current()
        if now is None or not now[1]:
            raise ValueError("nothing has been written yet")
        return self._load(now[1])

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        now = self._current()
        if now and now[0] >= batch_id:
            return
        folders = now[1] if now else {}
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` rows
        old = self._load({b: folders[b] for b in touched if b in folders})
        columns = [c for c in batch.columns if c != self.deleted]
        if old is not None:
            out = upsert(old, batch, self.key, self.version, self.deleted)
        else:
            new = latest(batch, self.key, self.version)
            out = (new.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else new).select(*columns)
        folder = f"v{batch_id}-{uuid.uuid4().hex[:8]}"
        out.withColumn("__bucket", bucket).write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        # a bucket whose last row went has no folder
        written = {r["__bucket"] for r in self.spark.read.parquet(f"{self.path}/{folder}").select("__bucket").distinct().collect()} if touched and out.limit(1).count() else set()
        folders = {b: f for b, f in folders.items() if b not in touched} | dict.fromkeys(sorted(written), folder)
        row = self.spark.createDataFrame([(batch_id, {str(b): f for b, f in folders.items()})], "batch long, folders map<string, string>")
        row.coalesce(1).write.mode("append").json(f"{self.path}/versions")
        if self.on_change and folders:
            self.on_change(self.read())

    def clean(self, keep: int = 2) -> int:
        """Removes what only versions before the last `keep` name; readers of those must have ended. Gives the number of folders."""
        known = [set((r["folders"] or {}).values()) for r in self._pointers().orderBy(F.col("batch").desc()).limit(keep).collect()]
        named = set().union(*known)
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name != "versions" and name not in named:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Upserts a stream. trigger: as DataStreamWriter.trigger takes it."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.apply(df, i)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def time_buckets(df: DataFrame, ts: str, seconds: int, watermark: str | None = None) -> DataFrame:
    """Counts by tumbling windows of a timestamp column, for batches and streams."""
    df = df.withWatermark(ts, watermark) if watermark else df
    return df.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

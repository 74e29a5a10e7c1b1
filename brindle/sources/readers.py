"""Collections in and out: flat columns (hash documents), JSON documents, keys, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_hashes(spark: SparkSession, path: str, key: str, fmt: str = "parquet", prefix: str = "", **options) -> DataFrame:
    """Flat documents; the key column, with a prefix, becomes __key."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df.withColumn("__key", F.concat(F.lit(prefix), F.col(key).cast("string")))


def read_json(spark: SparkSession, path: str, key: str | None = None, prefix: str = "") -> DataFrame:
    """One JSON document a line: `json` with its text and `doc` as a variant; `__key` from a JSON path, or the line's hash."""
    lines = spark.read.text(path).withColumnRenamed("value", "json")
    made = F.get_json_object("json", key) if key else F.xxhash64("json").cast("string")
    return lines.withColumn("doc", F.try_parse_json("json")).withColumn("__key", F.concat(F.lit(prefix), made))


def with_json(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields from a column of JSON texts: name -> (path, type); a path that ends in [*] gives an array."""
    out = {}
    for name, (path, kind) in paths.items():
        if path.endswith("[*]"):
            out[name] = F.from_json(F.get_json_object(column, path[:-3]), f"array<{kind}>")
        else:
            got = F.get_json_object(column, path)
            out[name] = got if kind == "string" else got.try_cast(kind)
    return df.withColumns(out)


def mget(df: DataFrame, keys: list, key: str = "__key") -> DataFrame:
    """The documents of some keys; more than a thousand are joined instead of listed."""
    if len(keys) <= 1000:
        return df.where(F.col(key).isin(list(keys)))
    wanted = df.sparkSession.createDataFrame([(k,) for k in keys], df.select(key).schema)
    return df.join(wanted, key, "left_semi")


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def pages(df: DataFrame, count: int):
    """Rows in pages of `count`, as a cursor reads them; one partition at a time comes to the driver."""
    page = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == count:
            yield page
            page = []
    if page:
        yield page

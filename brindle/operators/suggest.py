"""Completion dictionaries and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = float(2**31 - 1)


def add(table: DataFrame, string: str, score: float, incr: bool = False, payload: str | None = None) -> DataFrame:
    """table (string, score, payload) with a suggestion set or raised."""
    new = table.sparkSession.createDataFrame([(string, float(score), payload)], "string string, score double, payload string")
    if not incr:
        return table.where(F.col("string") != string).unionByName(new)
    return table.unionByName(new).groupBy("string").agg(F.sum("score").alias("score"), F.max("payload").alias("payload"))


def complete(table: DataFrame, prefix: str, fuzzy: bool = False, most: int = 5, trim: bool = False) -> DataFrame:
    """string, score, payload of the best completions: an exact match first, longer ones and misspelt ones lowered."""
    own, low = F.lower("string"), prefix.lower()
    n = len(low)
    exact = own == low
    if fuzzy:
        away = F.least(*[F.levenshtein(F.substring(own, 1, max(1, k)), F.lit(low)) for k in (n - 1, n, n + 1)])
        found = table.withColumn("__away", away).where("__away <= 1")
        lowered = F.col("score") * F.exp(-2.0 * F.col("__away"))
    else:
        found = table.withColumn("__away", F.lit(0)).where(own.startswith(low))
        lowered = F.col("score")
    value = F.when(exact, F.lit(EXACT)).otherwise(lowered / F.sqrt(1.0 + F.abs(F.length("string") - F.lit(len(prefix.encode())))))
    out = found.select("string", value.alias("score"), "payload").orderBy(F.col("score").desc(), F.col("string").asc()).limit(most)
    if trim:
        best = out.agg(F.max("score").alias("__best"))  # one row
        out = out.crossJoin(F.broadcast(best)).where(F.col("score") >= F.col("__best") / 10).drop("__best")
    return out


def spellcheck(vocabulary: DataFrame, n_docs: int, terms: list[str], distance: int = 1, include: set[str] = frozenset(), exclude: set[str] = frozenset(), full_scores: bool = False) -> DataFrame:
    """term, suggestion, score. vocabulary: term, documents. Terms in the index get no suggestions; included words score 0."""
    spark = vocabulary.sparkSession
    asked = spark.createDataFrame([(t.lower(),) for t in terms], "asked string")  # the query's terms
    known = vocabulary.join(F.broadcast(asked), vocabulary["term"] == asked["asked"], "left_semi").select("term")
    unknown = asked.join(known, asked["asked"] == known["term"], "left_anti").where(~F.col("asked").isin(list(include)) if include else F.lit(True))
    words = vocabulary.select("term", "documents")
    if include:
        words = words.unionByName(spark.createDataFrame([(w.lower(), 0) for w in include], "term string, documents long"))
    if exclude:
        words = words.where(~F.col("term").isin([w.lower() for w in exclude]))
    pairs = words.join(F.broadcast(unknown), F.levenshtein(F.col("term"), F.col("asked"), distance) >= 0)
    score = F.max("documents").cast("double") / (1.0 if full_scores else float(max(1, n_docs)))
    return pairs.groupBy("asked", "term").agg(score.alias("score")).select(F.col("asked").alias("term"), F.col("term").alias("suggestion"), "score").orderBy("term", F.col("score").desc(), "suggestion")

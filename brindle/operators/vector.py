"""Vector distances (smaller is nearer) as Column expressions, nearest neighbours and ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("L2", "IP", "COSINE")


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda a, x: a + x)


def distance(col: Column, vector: tuple[float, ...], metric: str) -> Column:
    """L2: squared; IP: 1 - dot; COSINE: 1 - cosine. Null for a vector of another size."""
    own = F.transform(col, lambda x: x.cast("double"))
    other = F.array(*[F.lit(float(v)) for v in vector])
    dot = _sum(F.zip_with(own, other, lambda a, b: a * b))
    if metric == "L2":
        made = _sum(F.zip_with(own, other, lambda a, b: (a - b) * (a - b)))
    elif metric == "IP":
        made = 1 - dot
    elif metric == "COSINE":
        norm = math.sqrt(sum(v * v for v in vector))
        made = 1 - dot / F.nullif(F.sqrt(_sum(F.transform(own, lambda a: a * a))) * norm, F.lit(0.0))
    else:
        raise ValueError(f"no metric {metric}")
    return F.when(F.size(col) == len(vector), made)


def nearest(df: DataFrame, col: str, vector: tuple[float, ...], k: int, metric: str = "L2", alias: str = "distance", key: str = "__key") -> DataFrame:
    """The k nearest rows: an exact scan and a bounded top-k in each task; ties go to the smaller key."""
    found = df.withColumn(alias, distance(F.col(f"`{col}`"), vector, metric)).where(F.col(alias).isNotNull())
    return found.orderBy(F.col(alias).asc(), F.col(key).asc()).limit(k)


def within(df: DataFrame, col: str, vector: tuple[float, ...], radius: float, metric: str = "L2", alias: str = "distance") -> DataFrame:
    return df.withColumn(alias, distance(F.col(f"`{col}`"), vector, metric)).where(F.col(alias) <= radius)


def normalized(dist: Column, metric: str) -> Column:
    """A distance as a score from 0 to 1 (for IP the distance itself takes the place of the product)."""
    return {"L2": 1 / (1 + dist), "IP": (1 + dist) / 2, "COSINE": (1 + (1 - dist)) / 2}[metric]

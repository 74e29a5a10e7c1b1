"""Connected components of an edge table by smallest labels with pointer jumping; every table stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns id, label for every id in an edge; label is the smallest id of its component.

    A round takes the smallest label among an id's neighbours, then its label's own label, so a path of n edges takes
    about log n rounds. Each round's table is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        taken = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "near").alias("taken"))
        owner = labels.select(F.col("id").alias("taken"), F.col("label").alias("jump"))
        new = taken.join(owner, "taken", "left").select("id", F.least("taken", F.coalesce("jump", "taken")).alias("label"), F.col("label").alias("old"))
        new = stored(new, "cc-labels")
        changed = new.where("label != old").limit(1).count()
        discard(labels)
        labels = new.select("id", "label")
        labels._stored_at = new._stored_at
        if not changed:
            discard(both)
            return labels

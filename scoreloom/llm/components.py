"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import drop_written, materialise


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star: every edge is replaced by edges to the least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.*").where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``a, label`` for every node of the edges ``a, b`` (64-bit integers): the label is the component's least node. Each
    round is written, so lineage stays short, and the one before it given back; stars halve long paths, so rounds grow with the
    logarithm of a component."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while True:
        last, now = now, materialise(_stars(now), name)
        drop_written(last)
        after = mark(now)
        if after == before:
            break
        before = after
    labels = now.select("a", F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("a"), F.col("b").alias("label")).distinct())
    labels._written_to = now._written_to  # type: ignore[attr-defined]
    return labels

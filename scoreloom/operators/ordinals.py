"""Positions in a global order, without putting the table through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def running_total(df: DataFrame, key: str, amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows with a smaller ``key``; ``key`` is unique."""
    return running_totals(df, key, {out: amount})


def running_totals(df: DataFrame, key: str, amounts: dict[str, str]) -> DataFrame:
    """The same for several amounts, ``{out: amount}``, in one pass.

    The table is range-sorted and written once, so sampled range limits cannot differ between two readings.
    Each range then sums for itself, and only one row of subtotals per range goes through a single task.
    """
    ranged = df.orderBy(key).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_id", _ROW_BITS)), "ranged")
    subtotals = ranged.groupBy("_range").agg(*(F.sum(amount).alias(f"_sum_{out}") for out, amount in amounts.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = subtotals.select("_range", *(F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_start_{out}") for out in amounts))
    inside = Window.partitionBy("_range").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = [c for c in ranged.columns if c not in ("_range", "_id")]
    summed = ranged.select("*", *(F.coalesce(F.sum(amount).over(inside), F.lit(0)).alias(f"_inside_{out}") for out, amount in amounts.items()))
    return summed.join(F.broadcast(starts), "_range").select(  # one row per range
        *kept, *((F.col(f"_start_{out}") + F.col(f"_inside_{out}")).cast("bigint").alias(out) for out in amounts)
    )


def with_ordinal(df: DataFrame, key: str, out: str = "ordinal") -> DataFrame:
    """Add the zero-based position in the order of ``key``, which must be unique (a path is)."""
    ranged = df.orderBy(key).withColumn("_id", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_range", F.shiftright("_id", _ROW_BITS)), "ordinal")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.join(F.broadcast(starts), "_range")  # one row per range
        .withColumn(out, (F.col("_start") + row).cast("bigint"))
        .drop("_range", "_id", "_start")
    )


def with_rank(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """SQL ``rank() over (order by key)``: equal keys share a rank, the next rank counts them all; nulls come first.

    Rows are range-sorted by key and a hash beside it, so a key that holds a third of the table is spread over as many ranges as
    it fills. Each range ranks for itself. Only its first key can begin in an earlier range; where such keys begin is
    settled over two rows per range, so nothing is joined on the key.
    """
    mixed = df.withColumn("_mix", F.xxhash64(F.monotonically_increasing_id()))
    ranged = mixed.orderBy(key, "_mix").withColumn("_range", F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)).drop("_mix")
    ranged = materialise(ranged, "ranked")
    inside = Window.partitionBy("_range").orderBy(key)
    local = ranged.withColumn("_local", F.rank().over(inside) - 1)
    whole = F.struct(F.col(key).alias("k"))  # compares nulls too
    heads = local.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_n"), F.min(whole).alias("_first"), F.max(whole).alias("_last"), F.max("_local").alias("_last_local"),
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ends = F.explode(F.array(F.struct(F.col("_first").alias("k"), F.col("_start").alias("at")), F.struct(F.col("_last").alias("k"), (F.col("_start") + F.col("_last_local")).alias("at"))))
    begins = heads.select(ends.alias("e")).groupBy("e.k").agg(F.min("e.at").alias("_begin"))
    ranges = heads.join(begins, F.col("_first").eqNullSafe(F.col("k"))).select("_range", "_first", "_start", "_begin")
    place = F.when(whole.eqNullSafe(F.col("_first")), F.col("_begin")).otherwise(F.col("_start") + F.col("_local"))
    joined = local.join(F.broadcast(ranges), "_range")  # one row per range
    return joined.withColumn(out, (place + 1).cast("bigint")).drop("_range", "_first", "_start", "_begin", "_local")

"""Reports over runs. A run is a row group of ``run, phase, seconds``; amounts are exact decimals.

Everything is an aggregate that combines before its shuffle, or a window over rows already aggregated, so a
run that holds a third of all rows costs no more than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded
from scoreloom.operators.ordinals import with_rank
from scoreloom.session import materialise

SECONDS = "decimal(28,9)"  # nanoseconds: what a clock gives is added up whole and rounded only in the result


def exact(column: str) -> Column:
    """Seconds or money as an exact amount, so that sums do not depend on their order."""
    return F.col(column).cast(SECONDS)


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def per_second(rows: Column, seconds: Column) -> Column:
    return rounded(rows.cast("double") / F.greatest(_double(seconds), F.lit(1e-9)), 2)


def size_profile(files: DataFrame, by: str, length: str = "length") -> DataFrame:
    """Count, mean KB, smallest and largest size per set."""
    size = F.col(length).cast("bigint")
    return files.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_files"),
        rounded(F.sum(size).cast("double") / F.count(size) / 1024, 3).alias("avg_kb"),
        F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes"),
    )


def phase_breakdown(phases: DataFrame, run: str, phase: str, seconds: str) -> DataFrame:
    """Seconds per run and phase, and the phase's share of the run's wall time."""
    spent = phases.groupBy(run, phase).agg(F.sum(exact(seconds)).alias("_s"))
    wall = F.sum("_s").over(Window.partitionBy(run))
    share = F.when(wall != 0, _double("_s") / _double(wall))
    return spent.select(run, phase, _double("_s").alias("seconds"), rounded(share).alias("share"))


def phase_columns(phases: DataFrame, run: str, phase: str, seconds: str, names: Sequence[str]) -> DataFrame:
    """The wide form: one row per run, one column per named phase, ``other_s`` for all other phases, and ``total_s``."""
    known = F.coalesce(F.col(phase).isin(*names), F.lit(False))
    spent = [F.sum(F.when(F.col(phase) == n, exact(seconds))).alias(f"{n}_s") for n in names]
    spent += [F.sum(F.when(~known, exact(seconds))).alias("other_s"), F.sum(exact(seconds)).alias("total_s")]
    columns = [*(f"{n}_s" for n in names), "other_s", "total_s"]
    return phases.groupBy(run).agg(*spent).select(run, *[_double(F.coalesce(c, F.lit(0))).alias(c) for c in columns])


def throughput(rows: DataFrame, run: str, seconds: str) -> DataFrame:
    """Rows, wall seconds and rows per second of every run."""
    n, wall = F.count(F.lit(1)), F.sum(exact(seconds))
    return rows.groupBy(run).agg(
        n.alias("n_rows"), _double(wall).alias("wall_s"), per_second(n, wall).alias("rows_per_sec")
    )


def run_ranking(rows: DataFrame, run: str, seconds: str) -> DataFrame:
    """Runs ranked by wall time, with the ratio to the fastest; equal times share a rank."""
    walls = materialise(rows.groupBy(run).agg(F.sum(exact(seconds)).alias("wall")), "walls")
    best = walls.agg(F.min("wall").cast("double")).scalar()
    ratio = F.when(best != 0, _double("wall") / best)
    return with_rank(walls, "wall").select(
        run, _double("wall").alias("wall_s"), "rank", rounded(ratio).alias("ratio_to_best")
    )


def dataset_delta(rows: DataFrame, pattern: str, is_second: Column, seconds: str) -> DataFrame:
    """Mean seconds per pattern on two datasets, and the change from the first to the second in percent."""
    first, second = F.when(~is_second, exact(seconds)), F.when(is_second, exact(seconds))
    sums = rows.groupBy(pattern).agg(
        F.sum(first).alias("_s1"), F.count(first).alias("_n1"), F.sum(second).alias("_s2"), F.count(second).alias("_n2")
    )
    a, b = (_double(f"_s{i}") / F.nullif(F.col(f"_n{i}"), F.lit(0)) for i in (1, 2))
    change = (b / F.nullif(a, F.lit(0.0)) - 1) * 100
    return sums.select(
        pattern, rounded(a).alias("mean_first_s"), rounded(b).alias("mean_second_s"),
        rounded(change, 3).alias("change_pct"),
    )


def scaling_report(rows: DataFrame, pattern: str, is_second: Column, seconds: str) -> DataFrame:
    """Rows per second of each pattern at two input sizes, and the factor between them."""
    first, second = F.when(~is_second, exact(seconds)), F.when(is_second, exact(seconds))
    sums = rows.groupBy(pattern).agg(
        F.count(first).alias("n_first"), F.coalesce(F.sum(first), F.lit(0)).alias("_s1"),
        F.count(second).alias("n_second"), F.coalesce(F.sum(second), F.lit(0)).alias("_s2"),
    )
    a, b = (
        _double(n) / F.greatest(_double(s), F.lit(1e-9)) for n, s in (("n_first", "_s1"), ("n_second", "_s2"))
    )
    return sums.select(
        pattern, "n_first", "n_second", rounded(a).alias("rate_first"), rounded(b).alias("rate_second"),
        rounded(b / F.nullif(a, F.lit(0.0))).alias("scaling"),
    )


def time_order(ts: str, tie: str) -> Column:
    """Time, then ``tie``, as one number: a struct would make Spark sort all rows to aggregate by it."""
    t = F.col(ts)
    whole = F.unix_date(t.cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    seconds = whole.cast("decimal(13,0)") + F.extract(F.lit("SECOND"), t)
    return (seconds * 1_000_000).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(tie)


def cold_warm(rows: DataFrame, pattern: str, order: Column, seconds: str) -> DataFrame:
    """The first (cold) run of each pattern against the mean of its later (warm) ones, and the extreme swing.

    ``order`` is a number telling which run came first. It is a minimum, so runs are never sorted.
    """
    s = exact(seconds)
    parts = rows.groupBy(pattern).agg(
        F.count(F.lit(1)).alias("n_runs"), F.min_by(s, order).alias("_cold"), F.sum(s).alias("_all"),
        F.min(s).alias("_min"), F.max(s).alias("_max"),
    )
    warm = _double(F.col("_all") - F.col("_cold")) / F.nullif(F.col("n_runs") - 1, F.lit(0))
    return parts.select(
        pattern, "n_runs", _double("_cold").alias("cold_s"), rounded(warm).alias("warm_s"),
        rounded(_double("_cold") / F.nullif(warm, F.lit(0.0))).alias("cold_to_warm"),
        rounded(_double("_max") / F.nullif(_double("_min"), F.lit(0.0))).alias("swing"),
    )


def best_by_scale(rows: DataFrame, size: str, pattern: str, seconds: str) -> DataFrame:
    """The pattern with the lowest mean seconds for each input size; the name decides a tie."""
    means = rows.groupBy(size, pattern).agg(
        (F.sum(exact(seconds)).cast("double") / F.count(F.lit(1))).alias("_mean")
    )
    best = means.groupBy(size).agg(F.min(F.struct("_mean", pattern)).alias("_b"))
    return best.select(size, F.col(f"_b.{pattern}").alias("best"), rounded("_b._mean").alias("mean_s"))


def billed_time(rows: DataFrame, run: str, phase: str, seconds: str, startup: str, queue: str) -> DataFrame:
    """Script wall, start-up, queue, elapsed and billed seconds per run. Queueing is elapsed but not billed."""
    def total(keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, exact(seconds))), F.lit(0))

    p = F.col(phase)
    sums = rows.groupBy(run).agg(
        total(~p.isin(startup, queue)).alias("_work"), total(p == startup).alias("_startup"),
        total(p == queue).alias("_queue"),
    )
    work, start, wait = F.col("_work"), F.col("_startup"), F.col("_queue")
    return sums.select(
        run, _double(work).alias("script_wall_s"), _double(start).alias("startup_s"), _double(wait).alias("queue_s"),
        _double(work + start + wait).alias("elapsed_s"), _double(work + start).alias("billed_s"),
    )


def cost_report(
    usage: DataFrame, prices: DataFrame, sku: str, key: str, price_key: str, units: str, price: str, by: str
) -> DataFrame:
    """Units and cost per SKU and ``by``: usage times list price.

    Usage is added up per SKU and price key before the join, so a key that holds a third of all usage reaches
    the join as one row per SKU.
    """
    used = usage.groupBy(sku, key).agg(F.sum(F.col(units).cast("decimal(18,6)")).alias("_units"))
    priced = used.join(
        prices.select(F.col(price_key).alias(key), by, F.col(price).cast("decimal(14,6)").alias("_price")), key
    )
    cost = F.sum(F.col("_units").cast("decimal(20,6)") * F.col("_price"))
    return priced.groupBy(sku, by).agg(
        _double(F.sum("_units")).alias("units"), rounded(_double(cost), 2).alias("cost")
    )

"""Predictions against payloads, inputs and other predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.numbers import rounded


def join_payload(predictions: DataFrame, payload: DataFrame, key: str = "path") -> DataFrame:
    """Inner join of narrow predictions with wide payloads.

    No side is marked for broadcast: Spark broadcasts the predictions while their measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and beyond that moves each payload once.
    """
    return predictions.join(payload, key)


def join_bucketed(predictions: DataFrame, payload: DataFrame, key: str = "path") -> DataFrame:
    """The same where the payload is a table that ``save_bucketed`` dealt by ``key``: only the predictions move.

    They are dealt as the payload lies and held by each task as a hash table, through which the payload passes unsorted.
    """
    return predictions.hint("shuffle_hash").join(payload, key)


def scored(predictions: DataFrame, key: str) -> DataFrame:
    """Keys that have a prediction: a row whose label is null (the call failed) is none."""
    done = predictions.where(F.col("label").isNotNull()) if "label" in predictions.columns else predictions
    return done.select(key)


def missing(inputs: DataFrame, predictions: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that have no prediction. Only key and label of the predictions are read."""
    return inputs.join(scored(predictions, key), key, "left_anti")


def completeness(inputs: DataFrame, predictions: DataFrame, by: str, key: str = "path") -> DataFrame:
    """Per group of inputs: how many there are, how many were scored, how many are missing.

    The groups are counted before and after one join on the key, so a large group is never one task's work.
    """
    done = scored(predictions, key).distinct().withColumn("_scored", F.lit(1))
    return (
        inputs.select(key, by).join(done, key, "left").groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n_inputs"),
            F.count("_scored").alias("n_scored"),
            F.count_if(F.col("_scored").isNull()).alias("n_missing"),
        )
    )


def agreement(left: DataFrame, right: DataFrame, key: str = "path", column: str = "label") -> DataFrame:
    """One row: rows compared, equal labels, flips, rate, and the rows that only one side has.

    Two null labels count as equal.
    """
    a = left.select(key, F.col(column).alias("_a"), F.lit(True).alias("_left"))
    b = right.select(key, F.col(column).alias("_b"), F.lit(True).alias("_right"))
    same = F.when(F.col("_left") & F.col("_right"), F.col("_a").eqNullSafe(F.col("_b"))).alias("same")
    rows = a.join(b, key, "full").select(same, "_left", "_right")
    return rows.agg(
        *agreement_columns("same"), F.count_if(F.col("_right").isNull()).alias("n_left_only"), F.count_if(F.col("_left").isNull()).alias("n_right_only")
    )


def agreement_columns(same: str) -> list:
    n, equal = F.count(same), F.count_if(F.col(same))
    return [
        n.alias("n"), equal.alias("n_agree"), (n - equal).alias("n_flips"),
        rounded(equal.cast("double") / F.when(n > 0, n)).alias("agreement"),
    ]

"""Support, confidence, penalty, purity and the ranks built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATING = "__is_violating"
#: Weight of informedness in the rank for merging and redundancy, and in the final rank.
MERGE_WEIGHT, FINAL_WEIGHT = 0.3, 0.4


def purity(confidence: Column, penalty: Column, support: Column, min_support: int) -> Column:
    """confidence / (confidence + penalty); 0 below min_support or where both are 0."""
    both = confidence + penalty
    return F.when((support < min_support) | (both == 0), F.lit(0.0)).otherwise(confidence / both)


def purity_value(confidence: float, penalty: float, support: float, min_support: int) -> float:
    return 0.0 if support < min_support or confidence + penalty == 0 else confidence / (confidence + penalty)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame, min_support: int) -> DataFrame:
    """Adds confidence, penalty and score to sat_matches, vio_matches, n_sat, n_vio."""
    return (
        counts.withColumn("confidence", ratio(F.col("sat_matches"), F.col("n_sat")))
        .withColumn("penalty", ratio(F.col("vio_matches"), F.col("n_vio")))
        .withColumn("score", purity(F.col("confidence"), F.col("penalty"), F.col("sat_matches"), min_support))
    )


def counted(condition: Column, violating: bool) -> Column:
    """Rows of one side that match."""
    side = F.col(VIOLATING) if violating else ~F.col(VIOLATING)
    return F.count(F.when(side & condition, F.lit(1)))


def totals(rows: DataFrame) -> DataFrame:
    """One row: n_sat, n_vio."""
    return rows.agg(F.count(F.when(~F.col(VIOLATING), 1)).alias("n_sat"), F.count(F.when(F.col(VIOLATING), 1)).alias("n_vio"))


def informedness() -> Column:
    return F.col("confidence") - F.col("penalty")


def rank_value(r: dict, weight: float) -> float:
    return r["score"] + weight * (r["confidence"] - r["penalty"])

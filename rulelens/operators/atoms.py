"""Single-column conditions, all of a stage from one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import VIOLATING, totals, with_metrics
from .domains import side_counts


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, sat, vio) of every value, null included: one map-side combined aggregation for all columns."""
    return side_counts(rows, columns)


def equality(rows: DataFrame, columns: list[str], min_support: int = 5) -> DataFrame:
    """Metrics of `column = value` for every value (null: IS NULL)."""
    counts = value_counts(rows, columns).withColumnsRenamed({"sat": "sat_matches", "vio": "vio_matches"})
    return with_metrics(counts.join(F.broadcast(totals(rows))), min_support)


def inequality(rows: DataFrame, columns: list[str], min_support: int = 5, least_domain: int = 3) -> DataFrame:
    """Metrics of `column != value` for domains of at least least_domain values; nulls match."""
    counts = value_counts(rows, columns).where("value IS NOT NULL")
    # one row a column
    large = counts.groupBy("column").agg(F.count(F.lit(1)).alias("domain")).where(F.col("domain") >= least_domain)
    both = counts.join(F.broadcast(large), "column").join(F.broadcast(totals(rows)))
    return with_metrics(both.select("column", "value", (F.col("n_sat") - F.col("sat")).alias("sat_matches"), (F.col("n_vio") - F.col("vio")).alias("vio_matches"), "n_sat", "n_vio"), min_support)


def evaluate(rows: DataFrame, conditions: list, min_support: int = 5) -> DataFrame:
    """Metrics of any row-level conditions, by number, in one pass over rows.

    Each row is mapped to the numbers of the conditions it meets; a short array per row
    instead of a wide aggregate keeps generated code small whatever the number of conditions.
    """
    hits = F.filter(F.array(*[F.when(c.to_column(rows.schema), F.lit(i)) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())
    counts = rows.select(F.explode(hits).alias("cond"), VIOLATING).groupBy("cond").agg(F.count(F.when(~F.col(VIOLATING), 1)).alias("sat_matches"), F.count(F.when(F.col(VIOLATING), 1)).alias("vio_matches"))
    every = rows.sparkSession.range(len(conditions)).select(F.col("id").cast("int").alias("cond"))
    full = every.join(counts, "cond", "left").fillna(0, ["sat_matches", "vio_matches"])
    return with_metrics(full.join(F.broadcast(totals(rows))), min_support)

"""Cheap pre-screen: does any value or range hold the rule clearly better than the whole?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binning import QUARTILES, quartile_bin
from ..functions.scoring import VIOLATING
from . import quantiles
from .baselines import cells

MIN_GAIN, MIN_GROUP, HIGH = 0.20, 10, 0.95


def counted_features(rows: DataFrame, categorical_columns: list[str], numerical_columns: list[str]) -> DataFrame:
    """(column, text, number, n, v): all and violating rows of every value, NaN as missing; no column: of the whole. One pass; all stages read what it leaves."""
    features = rows.select(F.explode(cells(categorical_columns, numerical_columns, fill=None)).alias("x"), VIOLATING)
    return features.groupBy("x.column", "x.text", "x.number").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(VIOLATING), 1)).alias("v"))


def _valid(groups: DataFrame, min_group: int) -> DataFrame:
    """(column, value, valid, n) of (column, value, n, v), summed."""
    summed = groups.groupBy("column", "value").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where(F.col("n") >= min_group)
    return summed.select("column", "value", ((F.col("n") - F.col("v")) / F.col("n")).alias("valid"), "n")


def _values(counted: DataFrame, min_group: int) -> DataFrame:
    return _valid(counted.where("text IS NOT NULL").select("column", F.col("text").alias("value"), "n", "v"), min_group)


def _bins(counted: DataFrame, min_group: int) -> DataFrame:
    numbers = counted.where("number IS NOT NULL").select("column", F.col("number").alias("value"), "n", "v")
    # one row a column
    filled = numbers.groupBy("column").agg(F.sum("n").alias("filled")).where(F.col("filled") >= 2 * min_group)
    edges = quantiles.quantiles_of(numbers, QUARTILES).join(filled, "column").select("column", "values")
    binned = numbers.join(F.broadcast(edges), "column").withColumn("bin", quartile_bin(F.col("value"), F.col("values")).cast("string")).where("bin IS NOT NULL")
    return _valid(binned.select("column", F.col("bin").alias("value"), "n", "v"), min_group)


def categorical(rows: DataFrame, columns: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """(column, value, valid, n): mean validity of values with enough rows."""
    return _values(counted_features(rows, columns, []), min_group)


def numerical(rows: DataFrame, columns: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """(column, value, valid, n) of quartile bins; columns with fewer than two groups' worth of values have none."""
    return _bins(counted_features(rows, [], columns), min_group)


def decision(rows: DataFrame, categorical_columns: list[str], numerical_columns: list[str], min_gain: float = MIN_GAIN, min_group: int = MIN_GROUP) -> DataFrame:
    """One row: refine, n, global_valid, best_gain, best_column, best_value, reason."""
    counted = counted_features(rows, categorical_columns, numerical_columns)
    found = [f(counted, min_group) for f, c in ((_values, categorical_columns), (_bins, numerical_columns)) if c]
    all_, bad = F.coalesce(F.sum("n"), F.lit(0)), F.sum("v")
    whole = counted.where("column = ''").agg(all_.alias("n"), F.when(all_ > 0, (all_ - bad) / all_).alias("global_valid"))
    best = None
    for i, x in enumerate(found):
        x = x.withColumn("kind", F.lit(i))
        best = x if best is None else best.unionByName(x)
    if best is None:
        best = rows.sparkSession.createDataFrame([], "column string, value string, valid double, n bigint, kind int")
    top = best.agg(F.max(F.struct(F.round("valid", 10).alias("valid"), (-F.col("kind")).alias("kind"), "column", "value")).alias("b"))
    x = whole.join(F.broadcast(top))
    gain = F.greatest(F.coalesce(F.col("b.valid") - F.col("global_valid"), F.lit(0.0)), F.lit(0.0))
    x = x.select("n", "global_valid", gain.alias("best_gain"), F.col("b.column").alias("best_column"), F.col("b.value").alias("best_value"))
    reason = (
        F.when(F.col("n") == 0, F.lit("No data samples"))
        .when(F.col("global_valid") > HIGH, F.concat(F.lit("Rule is already high confidence ("), F.format_number("global_valid", 2), F.lit(")")))
        .when(F.col("best_gain") >= min_gain, F.concat(F.lit("Found subset '"), "best_column", F.lit(" = "), "best_value", F.lit("' with confidence "), F.format_number(F.col("global_valid") + F.col("best_gain"), 2), F.lit(" (Global: "), F.format_number("global_valid", 2), F.lit(")")))
        .otherwise(F.concat(F.lit("Failures appear random (Max Gain: "), F.format_number("best_gain", 2), F.lit(")")))
    )
    refine = (F.col("n") > 0) & (F.col("global_valid") <= HIGH) & (F.col("best_gain") >= min_gain)
    return x.select(F.coalesce(refine, F.lit(False)).alias("refine"), "n", "global_valid", "best_gain", "best_column", "best_value", reason.alias("reason"))

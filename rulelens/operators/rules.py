"""Rule executors: tables that say where a rule is violated.

Single-row rules add the violation flag to rows. Rules over several rows give units with a flag, or
samples (sample_id, role, row_id, flag) for the miner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import VIOLATING

#: Rows of samples in one partition, on average.
PART_ROWS = 250_000
OPERATORS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def check_rows(rows: DataFrame, holds: Column) -> DataFrame:
    """Rows for which the rule says anything (holds is not null), flagged."""
    return rows.withColumn(VIOLATING, ~holds).where(F.col(VIOLATING).isNotNull())


def temporal_order(rows: DataFrame, first: str, op: str, second: str) -> DataFrame:
    return check_rows(rows, OPERATORS[op](F.col(first), F.col(second)))


def reference_equality(rows: DataFrame, reference: str, other: DataFrame, identifier: str, left: str, right: str) -> DataFrame:
    """Rows whose `left` must equal `right` of the row that `reference` points to."""
    target = other.select(F.col(identifier).alias("__target"), F.col(right).alias("__right"))
    joined = rows.join(target, F.col(reference) == F.col("__target"))
    return check_rows(joined, F.col(left) == F.col("__right")).drop("__target", "__right")


def functional_dependency(rows: DataFrame, left: list[str], right: str) -> DataFrame:
    """(left..., n_rows, flag): a group violates if it has several values on the right."""
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*left, right]))
    # the smallest and the largest value tell as much as all of them, and combine before the shuffle
    return known.groupBy(*left).agg(F.count(F.lit(1)).alias("n_rows"), (F.min(right) != F.max(right)).alias(VIOLATING))


def unique_key(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key..., n_rows, flag): a key violates if several rows have it."""
    known = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(VIOLATING, F.col("n_rows") > 1)


def sum_comparison(rows: DataFrame, group: list[str], amount: str, op: str, bound: str) -> DataFrame:
    """(group..., total, flag): the sum of amount against a value of the group."""
    sums = rows.groupBy(*group).agg(F.sum(amount).alias("total"), F.max(bound).alias("bound"))
    return check_rows(sums, OPERATORS[op](F.col("total"), F.col("bound")))


def sum_to_threshold(rows: DataFrame, group: list[str], amount: str, op: str, threshold: float) -> DataFrame:
    sums = rows.groupBy(*group).agg(F.sum(amount).alias("total"))
    return check_rows(sums, OPERATORS[op](F.col("total"), F.lit(threshold)))


def monotonic(rows: DataFrame, entity: list[str], order: list[str], value: str) -> DataFrame:
    """Rows with a predecessor in their entity, flagged where value falls."""
    before = F.lag(value).over(Window.partitionBy(*entity).orderBy(*order))
    return rows.withColumn("previous", before).where("previous IS NOT NULL").withColumn(VIOLATING, F.col(value) < F.col("previous"))


def together(rows: DataFrame, group: list[str], n_rows: int) -> DataFrame:
    """rows with those of a group in one partition, PART_ROWS of n_rows each on average. What is grouped or joined by the group later needs no further shuffle."""
    return rows.repartition(max(1, -(-n_rows // PART_ROWS)), *group)


def samples(rows: DataFrame, units: DataFrame, group: list[str], role: Column, order: list[str]) -> DataFrame:
    """rows as samples of their units: sample_id, role, row_id (from 0 within the role) and the unit's flag.

    A group of one column is the sample_id itself, so that Spark knows how the samples are partitioned; of several it is their text.
    """
    flagged = rows.join(units.select(*group, VIOLATING), group)
    name = F.col(group[0]) if len(group) == 1 else F.concat_ws("|", *[F.col(c).cast("string") for c in group])
    place = F.row_number().over(Window.partitionBy("sample_id", "role").orderBy(*order)) - 1
    return flagged.withColumn("sample_id", name).withColumn("role", role).withColumn("row_id", place)

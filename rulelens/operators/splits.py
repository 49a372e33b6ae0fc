"""Entropy splits of numeric columns.

Values are counted first; the running sums over value order are computed in SLICES per column
(cut at approximate quantiles) plus the sums of the slices before, so a column with billions
of distinct values is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import VIOLATING, purity, ratio
from .quantiles import in_slices

SLICES = 64


def entropy(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))


def _counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns])
    long = rows.select(F.explode(pairs).alias("p"), VIOLATING).select("p.column", "p.value", VIOLATING).where("value IS NOT NULL")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(VIOLATING), 1)).alias("v"))


def split_gains(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, split_value, gain, n_left, v_left, n_all, v_all) at every midpoint of neighbouring values."""
    return gains_of(_counted(rows, columns))


def gains_of(counted: DataFrame) -> DataFrame:
    """The same from (column, value, n, v): all and violating rows of each value, of whatever `column` stands for."""
    sliced = in_slices(counted, SLICES)
    per_slice = sliced.groupBy("column", "slice").agg(F.sum("n").alias("sn"), F.sum("v").alias("sv"), F.min("value").alias("low"))
    order = Window.partitionBy("column").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("column")
    offsets = per_slice.select(
        "column", "slice", F.coalesce(F.sum("sn").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sv").over(before), F.lit(0)).alias("v_before"),
        F.sum("sn").over(whole).alias("n_all"), F.sum("sv").over(whole).alias("v_all"), F.lead("low").over(order).alias("next_low"),
    )
    inner = Window.partitionBy("column", "slice").orderBy("value")
    to_here = inner.rowsBetween(Window.unboundedPreceding, 0)
    x = sliced.select("column", "slice", "value", F.sum("n").over(to_here).alias("n_in"), F.sum("v").over(to_here).alias("v_in"), F.lead("value").over(inner).alias("next_in")).join(F.broadcast(offsets), ["column", "slice"])
    x = x.select("column", "value", F.coalesce("next_in", "next_low").alias("next"), (F.col("n_before") + F.col("n_in")).alias("n_left"), (F.col("v_before") + F.col("v_in")).alias("v_left"), "n_all", "v_all")
    x = x.where("next IS NOT NULL AND v_all > 0 AND v_all < n_all AND n_all >= 2")
    n, right = F.col("n_all"), F.col("n_all") - F.col("n_left")
    gain = entropy(F.col("v_all") / n) - F.col("n_left") / n * entropy(F.col("v_left") / F.col("n_left")) - right / n * entropy((F.col("v_all") - F.col("v_left")) / right)
    # between neighbours that no number lies between (or whose sum is no number), the upper one splits them
    middle = (F.col("value") + F.col("next")) / 2
    cut = F.when((middle > F.col("value")) & (middle <= F.col("next")), middle).otherwise(F.col("next"))
    return x.select("column", cut.alias("split_value"), gain.alias("gain"), "n_left", "v_left", "n_all", "v_all").where(F.col("gain") > 1e-12)


def best_of(gains: DataFrame, max_splits: int = 20) -> DataFrame:
    """The max_splits largest gains of each column, rank from 1 (ties: the lower split first)."""
    order = Window.partitionBy("column").orderBy(F.desc(F.round("gain", 10)), "split_value")
    return gains.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_splits)


def best_splits(rows: DataFrame, columns: list[str], max_splits: int = 20) -> DataFrame:
    """best_of the split gains of rows."""
    return best_of(split_gains(rows, columns), max_splits)


def split_stats(splits: DataFrame, min_support: int = 10) -> DataFrame:
    """Confidence, penalty and score of both sides over the non-null rows of the column."""
    sat, vio = F.col("n_all") - F.col("v_all"), F.col("v_all")
    sat_left = F.col("n_left") - F.col("v_left")
    low_c, low_p = ratio(sat_left, sat), ratio(F.col("v_left"), vio)
    out = splits
    for name, c, p, support in (("lt", low_c, low_p, sat_left), ("gte", 1 - low_c, 1 - low_p, sat - sat_left)):
        out = out.withColumns({f"{name}_confidence": c, f"{name}_penalty": p, f"{name}_score": purity(c, p, support, min_support)})
    return out

"""Exact quantiles with linear interpolation, without all values in one task.

Values are counted first; ranks are cumulated in SLICES per column (cut at approximate quantiles) plus the
counts of the slices before, and only the values at the wanted ranks are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 64


def quantiles(rows: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(column, values: an array in the order of probabilities) of the non-null numbers of each column."""
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns])
    return quantiles_of(rows.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), probabilities)


def in_slices(counted: DataFrame, slices: int) -> DataFrame:
    """Adds the number of its slice to each (column, value, ...). Slices are cut at approximate quantiles of each column's values.

    An approximate quantile depends on the order in which its parts arrive, so edges that two readers computed may differ, and sums of slices then
    don't belong to the slices. They are computed once and come to the driver, fewer than `slices` per column.
    """
    cuts = counted.groupBy("column").agg(F.percentile_approx("value", F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(1000)).alias("cuts"))
    edges = counted.sparkSession.createDataFrame(cuts.collect(), cuts.schema)
    return counted.join(F.broadcast(edges), "column").withColumn("slice", F.size(F.filter("cuts", lambda e: e < F.col("value")))).drop("cuts")


def quantiles_of(counted: DataFrame, probabilities: list[float]) -> DataFrame:
    """The same from (column, value, n)."""
    sliced = in_slices(counted, SLICES)
    order = Window.partitionBy("column").orderBy("slice")
    before = F.coalesce(F.sum("sn").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_slice = sliced.groupBy("column", "slice").agg(F.sum("n").alias("sn"))
    offsets = per_slice.select("column", "slice", before.alias("before"), F.sum("sn").over(Window.partitionBy("column")).alias("n_all"))
    inside = Window.partitionBy("column", "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    x = sliced.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(offsets), ["column", "slice"])
    end = F.col("before") + F.col("upto")
    x = x.select("column", "value", (end - F.col("n")).alias("first"), end.alias("end"), "n_all")
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("n_all") - 1)).alias("at")) for i, p in enumerate(probabilities)])
    holds = lambda rank: (rank >= F.col("first")) & (rank < F.col("end"))
    some = F.filter(spots, lambda s: holds(F.floor(s["at"])) | holds(F.ceil(s["at"])))
    hits = x.select("column", "value", "first", "end", F.explode(some).alias("s"))
    low, high = (F.max(F.when(holds(f(F.col("s.at"))), F.col("value"))) for f in (F.floor, F.ceil))
    found = hits.groupBy("column", F.col("s.i").alias("i")).agg(low.alias("low"), high.alias("high"), F.max(F.col("s.at") - F.floor("s.at")).alias("share"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("share")
    listed = F.sort_array(F.collect_list(F.struct("i", value.alias("v"))))
    return found.groupBy("column").agg(F.transform(listed, lambda s: s["v"]).alias("values"))


def wide(rows: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row with an array of quantiles per column (null for a column without numbers)."""
    return quantiles(rows, columns, probabilities).agg(*[F.max(F.when(F.col("column") == c, F.col("values"))).alias(c) for c in columns])

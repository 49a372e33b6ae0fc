"""Equal-frequency and equal-width bins, right-closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


def quartile_bin(value: Column, edges: Column) -> Column:
    """Number of the bin (1..) of equal frequency; equal edges are one, a constant column has no bin."""
    distinct = F.array_distinct(edges)
    above = F.size(F.filter(distinct, lambda e: e < value.cast("double")))
    return F.when(value.isNotNull() & (F.size(distinct) > 1), F.greatest(above, F.lit(1)))


def width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Number of the bin (1..bins) of equal width; the minimum falls into the first, a constant column has one bin."""
    spread = high - low
    number = F.ceil((value.cast("double") - low) / spread * bins)
    return F.when(value.isNull(), None).when(spread == 0, F.lit(1)).otherwise(F.least(F.greatest(number, F.lit(1)), F.lit(bins))).cast("int")

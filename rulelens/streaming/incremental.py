"""Condition counts over a stream: equality atoms kept up to date by Structured Streaming.

Counts are sums, so a stream of flagged rows only adds to them; `metrics` turns any state of the
counts into confidence, penalty and score. With a watermark and a window the counts are those of
recent events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import VIOLATING, with_metrics


def atom_counts(stream: DataFrame, columns: list[str], time: str | None = None, window: str | None = None, late: str = "1 hour") -> DataFrame:
    """(column, value, sat, vio), and the window if one is asked for. Works on streams and on tables."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    keys = []
    if time and window:
        stream = stream.withWatermark(time, late) if stream.isStreaming else stream
        keys = [F.window(time, window).alias("window")]
    long = stream.select(*([time] if keys else []), F.explode(pairs).alias("p"), VIOLATING)
    return long.groupBy(*keys, F.col("p.column").alias("column"), F.col("p.value").alias("value")).agg(F.count(F.when(~F.col(VIOLATING), 1)).alias("sat"), F.count(F.when(F.col(VIOLATING), 1)).alias("vio"))


def metrics(counts: DataFrame, min_support: int = 5) -> DataFrame:
    """Metrics of every value from its counts; totals are those of any one column, as each row counts once per column."""
    whole = counts.groupBy("column").agg(F.sum("sat").alias("n_sat"), F.sum("vio").alias("n_vio"))
    return with_metrics(counts.join(F.broadcast(whole), "column").withColumnsRenamed({"sat": "sat_matches", "vio": "vio_matches"}), min_support)

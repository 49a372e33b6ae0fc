"""Whether a found condition is the sought one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, Conjunction, Numerical

ALIKE = 0.99


def overlap(rows: DataFrame, a: Condition, b: Condition) -> DataFrame:
    """One row: both, either, iou (1 if neither selects a row)."""
    x, y = a.to_column(rows.schema), b.to_column(rows.schema)
    counts = rows.agg(F.count(F.when(x & y, 1)).alias("both"), F.count(F.when(x | y, 1)).alias("either"))
    return counts.withColumn("iou", F.when(F.col("either") == 0, 1.0).otherwise(F.col("both") / F.col("either")))


def numerically_equal(rows: DataFrame, a: Numerical, b: Numerical, threshold: float = ALIKE) -> bool:
    """Same column and operator, and nearly the same threshold or nearly the same rows."""
    if a.column != b.column or a.op != b.op:
        return False
    return abs(a.value - b.value) < 1e-9 or overlap(rows, a, b).first()["iou"] >= threshold


def matches(rows: DataFrame, found: Condition, sought: Condition) -> bool:
    """Numbers by their rows, conjunctions part by part, all else by equality."""
    if type(found) is not type(sought):
        return False
    if isinstance(found, Numerical):
        return numerically_equal(rows, found, sought)
    if not isinstance(found, Conjunction):
        return found == sought
    left = sorted(sought.conditions, key=str)
    if len(found.conditions) != len(left):
        return False
    for part in sorted(found.conditions, key=str):
        hit = next((x for x in left if part == x or isinstance(part, Numerical) and isinstance(x, Numerical) and numerically_equal(rows, part, x)), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


def rank_of(rows: DataFrame, ranking: list[dict], sought: Condition) -> int | None:
    """Place from 1 of the first match, None if there is none. Numeric parts are compared in one aggregation."""
    parts = lambda c: sorted(c.conditions, key=str) if isinstance(c, Conjunction) else [c]
    targets = [x for x in parts(sought) if isinstance(x, Numerical)]
    close: dict[tuple[Numerical, Numerical], bool] = {}
    for r in ranking:
        for x in parts(r["condition"]):
            if isinstance(x, Numerical):
                for y in targets:
                    if x.column == y.column and x.op == y.op:
                        close[x, y] = abs(x.value - y.value) < 1e-9
    open_ = [k for k, same in close.items() if not same]
    if open_:
        masks = [(x.to_column(rows.schema), y.to_column(rows.schema)) for x, y in open_]
        counts = rows.agg(*[F.count(F.when(c, 1)).alias(f"{n}{i}") for i, (x, y) in enumerate(masks) for n, c in (("both", x & y), ("either", x | y))]).first()
        close |= {k: counts[f"either{i}"] == 0 or counts[f"both{i}"] / counts[f"either{i}"] >= ALIKE for i, k in enumerate(open_)}

    def same(x: Condition, y: Condition) -> bool:
        return x == y or isinstance(x, Numerical) and close.get((x, y), False)

    def fits(found: Condition) -> bool:
        if type(found) is not type(sought):
            return False
        left = parts(sought)
        for x in parts(found):
            hit = next((y for y in left if same(x, y)), None)
            if hit is None:
                return False
            left.remove(hit)
        return not left

    return next((i for i, r in enumerate(ranking, 1) if fits(r["condition"])), None)

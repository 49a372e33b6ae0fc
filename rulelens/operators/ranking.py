"""Redundancy filter, final order, and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import ColumnValue, Condition, Conjunction, MergedValues, Numerical, PairWise
from .quantiles import wide
from ..functions.scoring import FINAL_WEIGHT, MERGE_WEIGHT, informedness, rank_value


def signature(condition: Condition) -> str:
    """Conditions with one signature say nearly the same."""
    if isinstance(condition, PairWise):
        return str(condition)
    if isinstance(condition, Conjunction):
        return "and:" + ",".join(sorted(condition.columns()))
    if isinstance(condition, (ColumnValue, MergedValues, Numerical)):
        return f"{type(condition).__name__}:{condition.column}:{condition.op}"
    return str(condition)


def without_redundancy(results: DataFrame, keep: int = 2) -> DataFrame:
    """The best `keep` of each signature by score + 0.3 informedness; results has signature, expr and metrics."""
    rank = F.col("score") + F.lit(MERGE_WEIGHT) * informedness()
    order = Window.partitionBy("signature").orderBy(F.desc(F.round(rank, 10)), F.desc(F.round("confidence", 10)), "expr")
    return results.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= keep).drop("__place")


def final_order(results: DataFrame) -> DataFrame:
    """Adds final_rank (score + 0.4 informedness) and place from 1, one row per condition."""
    once = results.dropDuplicates(["expr"]).withColumn("final_rank", F.col("score") + F.lit(FINAL_WEIGHT) * informedness())
    # ranked conditions are a bounded list, so one ordered task is enough
    order = Window.orderBy(F.desc(F.round("final_rank", 10)), F.desc(F.round("confidence", 10)), "expr")
    return once.withColumn("place", F.row_number().over(order))


def ranked(results: list[dict], keep: int = 2) -> list[dict]:
    """The same on a driver-side list of candidates: one per condition, best of each signature, final order."""
    once = list({r["condition"]: r for r in results}.values())
    taken: dict[str, int] = {}
    out = []
    for r in sorted(once, key=lambda r: (-round(rank_value(r, MERGE_WEIGHT), 10), -round(r["confidence"], 10), str(r["condition"]))):
        s = signature(r["condition"])
        taken[s] = taken.get(s, 0) + 1
        if taken[s] <= keep:
            out.append(r)
    return sorted(out, key=lambda r: (-round(rank_value(r, FINAL_WEIGHT), 10), -round(r["confidence"], 10), str(r["condition"])))


def retrieval(ranks: DataFrame, rank: str = "rank") -> DataFrame:
    """Hits at 1, 3, 5, 10 and mean reciprocal rank; a missing rank counts as no hit."""
    hit = lambda k: F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"hits_at_{k}")
    return ranks.agg(F.count(F.lit(1)).alias("rules"), *[hit(k) for k in (1, 3, 5, 10)], F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, minimum, maximum and population deviation."""
    v = F.col(column).cast("double")
    middle = wide(values, [column], [0.5]).select(F.get(F.col(column), F.lit(0)).alias("median"))
    whole = values.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("deviation"))
    return whole.join(F.broadcast(middle)).select("n", "total", "mean", "median", "least", "most", "deviation")


def hybrid(results: list[dict], relevance: dict[str, str], semantic: float = 0.2, statistical: float = 0.8) -> list[dict]:
    """Results with a mix of semantic relevance and statistical score, best first."""
    levels = {"highly_relevant": 1.0, "moderately_relevant": 0.6, "unrelated": 0.1}
    out = []
    for r in results:
        s = max(levels[relevance.get(c, "unrelated")] for c in r["condition"].columns())
        t = (r.get("score", 0.0) + 1) / 2
        out.append(r | {"semantic_score": s, "stat_score_normalized": t, "hybrid_score": semantic * s + statistical * t})
    return sorted(out, key=lambda r: (-r["hybrid_score"], str(r["condition"])))

"""Deterministic sampling: random order is a hash of the row id, so plans and engines agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binning import QUARTILES, quartile_bin, width_bin
from . import quantiles

MULTIPLIER, MODULUS = 2654435761, 4294967296


def hash_order(row_id: Column, seed: int = 0) -> Column:
    return F.pmod(row_id * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def uniform(rows: DataFrame, k: int, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """k rows in hash order (a distributed top-k); all rows if there are fewer."""
    return rows.orderBy(hash_order(F.col(row_id), seed), row_id).limit(max(0, k))


def sample(rows: DataFrame, k: int, informed: bool = True, categorical: list[str] | None = None, min_per_group: int = 1, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """k rows, covering values, quartiles and nulls or in hash order; none if k < 1, all rows unchanged if there are no more than k."""
    if k < 1:
        return rows.limit(0)
    if rows.limit(k + 1).count() <= k:
        return rows
    return informative(rows, k, categorical or [], min_per_group, row_id, seed) if informed else uniform(rows, k, row_id, seed)


def informative(rows: DataFrame, k: int, categorical: list[str], min_per_group: int = 1, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """k rows that cover values, quartiles, nulls and texts; the rest in hash order.

    Each coverage group keeps its first min_per_group rows. Spark limits groups before the shuffle.
    """
    names = [c for c in rows.columns if c != row_id]
    numbers = [c for c in names if c not in categorical and isinstance(rows.schema[c].dataType, T.NumericType)]
    strings = [c for c in names if c not in categorical and isinstance(rows.schema[c].dataType, T.StringType)]
    nullable = [n for n, v in rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names]).first().asDict().items() if v] if names else []
    base = rows
    if numbers:
        edges = quantiles.wide(rows, numbers, QUARTILES).select(*[F.col(c).alias(f"__e{i}") for i, c in enumerate(numbers)])
        base = rows.join(F.broadcast(edges))
    keys = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"v:{c}:"), F.col(c).cast("string"))) for c in categorical if c in names]
    keys += [F.concat(F.lit(f"q:{c}:"), quartile_bin(F.col(c), F.col(f"__e{i}")).cast("string")) for i, c in enumerate(numbers)]
    keys += [F.concat(F.lit(f"n:{c}:"), F.col(c).isNull().cast("string")) for c in nullable]
    keys += [F.when(F.col(c).isNotNull(), F.lit(f"s:{c}")) for c in strings]
    if not keys:
        return uniform(rows, k, row_id, seed)
    spot = hash_order(F.col(row_id), seed)
    long = base.select(F.col(row_id), F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("group")).withColumn("spot", spot)
    order = Window.partitionBy("group").orderBy("spot", row_id)
    must = long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min_per_group).select(F.col(row_id).alias("__must")).distinct()
    marked = rows.join(must, F.col(row_id) == F.col("__must"), "left")
    return marked.orderBy(F.col("__must").isNull(), spot, row_id).limit(max(0, k)).drop("__must")


def rarity(rows: DataFrame, categorical: list[str], numerical: list[str], row_id: str = "row_id", bins: int = 10) -> DataFrame:
    """(row_id, score): sum of 1 / frequency of the row's values and equal-width bins; nulls add 0.

    Frequencies are aggregated and joined back (small sides by their real size), so a value of a
    third of the rows is counted before it is shuffled.
    """
    base = rows
    if numerical:
        ends = rows.agg(*[f(F.col(c).cast("double")).alias(f"__{n}{i}") for i, c in enumerate(numerical) for n, f in (("low", F.min), ("high", F.max))])
        base = rows.join(F.broadcast(ends))
    pairs = [F.struct(F.lit(f"c:{c}").alias("column"), F.col(c).cast("string").alias("value")) for c in categorical]
    pairs += [F.struct(F.lit(f"n:{c}").alias("column"), width_bin(F.col(c), F.col(f"__low{i}"), F.col(f"__high{i}"), bins).cast("string").alias("value")) for i, c in enumerate(numerical)]
    long = base.select(row_id, F.explode(F.array(*pairs)).alias("p")).select(row_id, "p.column", "p.value")
    weights = long.where("value IS NOT NULL").groupBy("column", "value").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return long.join(weights, ["column", "value"], "left").groupBy(row_id).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("score"))


def hierarchical(candidates: DataFrame, scores: DataFrame, k: int, min_per_role: int = 1, force_full_if_small: bool = False) -> DataFrame:
    """Rows of candidates (group_key, rep, role, row_id) kept within k, with their score.

    A unit is a group's representation; its budget is its share of k, at least min_per_role
    for each role; roles get their best rows first, then the unit's next best; then the best k of all.
    Units are counted by aggregation, and both rankings have a constant bound (min_per_role, k), which Spark applies
    before it shuffles: a unit of a third of all rows sends no more than k rows from each task.
    """
    k = max(0, k)
    scored = candidates.join(scores, "row_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 8))
    keys, best = ["group_key", "rep"], [F.desc("score"), "row_id"]
    roles = candidates.groupBy(*keys, "role").agg(F.count(F.lit(1)).alias("n"))
    of_role = F.least(F.col("n"), F.lit(min_per_role))
    units = roles.groupBy(*keys).agg(F.sum("n").alias("unit_rows"), F.count("role").alias("roles"), F.sum(of_role).alias("firsts"))
    all_rows = candidates.agg(F.count(F.lit(1)).alias("all_rows"))
    share = F.floor(F.col("unit_rows") * F.lit(k) / F.col("all_rows"))
    units = units.join(F.broadcast(all_rows)).withColumn("budget", F.least("unit_rows", F.greatest(F.col("roles") * min_per_role, share)))
    first = scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "role").orderBy(*best))).where(F.col("place") <= min_per_role).drop("place")
    # a budget is at most k or the first rows of the roles; more than k rows of a unit never stay
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("place") <= k)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, "role", "row_id")])
    rest = ranked.alias("r").join(first.alias("f"), same, "left_anti")
    next_place = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
    within = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"u.{c}")) for c in keys])
    more = rest.withColumn("next", next_place).alias("n").join(units.alias("u"), within).where(F.col("next") <= F.col("budget") - F.col("firsts"))
    names = ["group_key", "rep", "role", "row_id", "score"]
    kept = first.select(*names).unionByName(more.select(*[f"n.{c}" for c in names]))
    if force_full_if_small:
        small = scored.join(F.broadcast(all_rows)).where(F.col("all_rows") <= k).select(*names)
        kept = kept.join(F.broadcast(all_rows)).where(F.col("all_rows") > k).select(*names).unionByName(small)
    return kept.orderBy(F.desc("score"), "group_key", "rep", "role", "row_id").limit(k)


def reconstruct(selected: DataFrame, rows: DataFrame) -> DataFrame:
    """(group_key, rep, roles: map role -> array of rows) of selected (group_key, rep, role, row_id)."""
    full = selected.select("group_key", "rep", "role", "row_id").join(rows, "row_id")
    item = F.struct("row_id", *[c for c in rows.columns if c != "row_id"])
    per_role = full.groupBy("group_key", "rep", "role").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return per_role.groupBy("group_key", "rep").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "rows")))).alias("roles"))

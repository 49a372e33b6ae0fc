"""Samples of several rows: pair counts without pairs.

A sample table has sample_id, role and row_id (unique within sample and role). Pairs of a
sample that meet a row-level condition on both sides follow from counts: with n matching rows,
n_r per role and m_i per row_id,

    between  = n^2 - sum n_r^2        (both orientations)
    within   = sum n_r (n_r - 1) / 2
    all      = (n^2 - sum m_i^2) / 2

Pairwise equality uses the same formulas per value. `explicit` builds the pairs themselves,
for looking at them and for tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import Condition, PairWise
from .domains import long_values

#: Conditions that are counted side by side in one aggregation, whose code grows with them.
WIDE = 32
PATTERNS = ("between_groups", "within_groups", "all_combinations")


def explicit(samples: DataFrame, pattern: str) -> DataFrame:
    """Pairs of rows (a, b as structs) of one sample; quadratic in a sample's size by nature."""
    rows = F.struct(*samples.columns)
    left = samples.select("sample_id", rows.alias("a"))
    right = samples.select("sample_id", rows.alias("b"))
    residual = {
        "between_groups": F.col("a.role") != F.col("b.role"),
        "within_groups": (F.col("a.role") == F.col("b.role")) & (F.col("a.row_id") < F.col("b.row_id")),
        "all_combinations": F.col("a.row_id") < F.col("b.row_id"),
    }[pattern]
    return left.join(right, "sample_id").where(residual)


def _unit(pattern: str) -> str:
    return "row_id" if pattern == "all_combinations" else "role"


def _pairs(pattern: str, n: Column, squares: Column) -> Column:
    # whole numbers throughout: what is halved is even
    half = lambda x: F.shiftright(x.cast("long"), 1)
    return {"between_groups": n * n - squares, "within_groups": half(squares - n), "all_combinations": half(n * n - squares)}[pattern].cast("long")


def _pair_sum(long: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """pairs by keys of rows (sample_id, role or row_id, keys...)."""
    unit = _unit(pattern)
    per_unit = long.groupBy("sample_id", unit, *keys).agg(F.count(F.lit(1)).alias("k"))
    per_sample = per_unit.groupBy("sample_id", *keys).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    counted = per_sample.select(*keys, _pairs(pattern, F.col("n"), F.col("squares")).alias("p"))
    return counted.groupBy(*keys).agg(F.sum("p").alias("pairs")) if keys else counted.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"))


def all_patterns(long: DataFrame, keys: list[str]) -> DataFrame:
    """(pattern, keys..., pairs) for every pattern at once, from rows (sample_id, role, row_id, keys...): one pass over them."""
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("role").cast("string").alias("unit")), F.struct(F.lit(1).alias("kind"), F.col("row_id").cast("string").alias("unit")))
    per_unit = long.select("sample_id", *keys, F.explode(kinds).alias("u")).groupBy("sample_id", *keys, "u.kind", "u.unit").agg(F.count(F.lit(1)).alias("k"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    square = F.col("k") * F.col("k")
    per_sample = per_unit.groupBy("sample_id", *keys).agg(of(0, F.col("k")).alias("n"), of(0, square).alias("roles"), of(1, square).alias("rows"))
    counts = F.array(*[F.struct(F.lit(p).alias("pattern"), _pairs(p, F.col("n"), F.col("rows" if _unit(p) == "row_id" else "roles")).alias("p")) for p in PATTERNS])
    return per_sample.select(*keys, F.explode(counts).alias("x")).groupBy("x.pattern", *keys).agg(F.sum("x.p").alias("pairs"))


def matching_all(samples: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(pattern, cond, pairs) as `matching` gives them, for every pattern."""
    hits = F.filter(F.array(*[F.when(c.to_column(samples.schema), F.lit(i)) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())
    return all_patterns(samples.select("sample_id", "role", "row_id", F.explode(hits).alias("cond")), ["cond"])


def pairwise_all(samples: DataFrame, columns: list[str]) -> DataFrame:
    """(pattern, column, op, pairs) as `pairwise` gives them, for every pattern."""
    # a null value stands for all values of the column
    text = lambda c: F.col(f"`{c}`").cast("string")
    each = [F.when(text(c).isNotNull(), F.struct(F.lit(c).alias("column"), v.alias("value"))) for c in columns for v in (text(c), F.lit(None).cast("string"))]
    long = samples.select("sample_id", "role", "row_id", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select("sample_id", "role", "row_id", "x.column", "x.value")
    both = all_patterns(long, ["column", "value"])
    same = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("pairs"))), F.lit(0)).alias("same")
    whole = both.groupBy("pattern", "column").agg(F.sum(F.when(F.col("value").isNull(), F.col("pairs"))).alias("filled"), same)
    ops = F.array(F.struct(F.lit("=").alias("op"), F.col("same").alias("pairs")), F.struct(F.lit("!=").alias("op"), (F.col("filled") - F.col("same")).alias("pairs")))
    return whole.select("pattern", "column", F.explode(ops).alias("x")).select("pattern", "column", "x.op", "x.pairs")


def total(samples: DataFrame, pattern: str) -> DataFrame:
    """One row: pairs of all samples."""
    return _pair_sum(samples, [], pattern)


def matching(samples: DataFrame, conditions: list[Condition], pattern: str) -> DataFrame:
    """(cond, pairs) of row-level conditions that hold on both rows, by number."""
    columns, unit, out = [c.to_column(samples.schema) for c in conditions], _unit(pattern), None
    for start in range(0, len(columns), WIDE):
        some = range(start, min(start + WIDE, len(columns)))
        per_unit = samples.groupBy("sample_id", unit).agg(*[F.count(F.when(columns[i], 1)).alias(f"k{i}") for i in some])
        per_sample = per_unit.groupBy("sample_id").agg(*[F.sum(f"k{i}").alias(f"n{i}") for i in some], *[F.sum(F.col(f"k{i}") * F.col(f"k{i}")).alias(f"s{i}") for i in some])
        whole = per_sample.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in some], *[F.sum(_pairs(pattern, F.col(f"n{i}"), F.col(f"s{i}"))).alias(f"p{i}") for i in some])
        part = _listed(whole, some, "n", "p").select("cond", F.col("p").alias("pairs"))
        out = part if out is None else out.unionByName(part)
    return out


def _listed(whole: DataFrame, some: range, hits: str, value: str) -> DataFrame:
    """(cond, value) of conditions that rows meet, from one row of counts."""
    each = F.array(*[F.struct(F.lit(i).alias("cond"), F.col(f"{hits}{i}").alias("hits"), F.col(f"{value}{i}").alias(value)) for i in some])
    return whole.select(F.explode(each).alias("x")).where("x.hits > 0").select("x.cond", f"x.{value}")


def meeting(rows: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(cond, n) rows that meet row-level conditions, by number."""
    columns, out = [c.to_column(rows.schema) for c in conditions], None
    for start in range(0, len(columns), WIDE):
        some = range(start, min(start + WIDE, len(columns)))
        part = _listed(rows.agg(*[F.count(F.when(columns[i], 1)).alias(f"n{i}") for i in some]), some, "n", "n")
        out = part if out is None else out.unionByName(part)
    return out


def value_pairs(samples: DataFrame, columns: list[str], pattern: str | None, total: int) -> DataFrame:
    """(column, value, eq_vio, ne_vio): pairs whose rows both have a value, and both have another one (null is a value), of all values at once; whole samples for no pattern.

    total: all pairs (or samples). The second count is the total less what the value takes away, so samples without it aren't touched.
    """
    unit = _unit(pattern) if pattern else "role"
    # a row has one value of each column, so the sizes of units and samples are sums over the values of a column; rows without a unit count in the sample's only
    own = long_values(samples.where("sample_id IS NOT NULL"), columns, "sample_id", unit).groupBy("sample_id", unit, "column", "value").agg(F.count(F.lit(1)).alias("k"))
    own = own.withColumn("u", F.sum("k").over(Window.partitionBy("sample_id", unit, "column")))
    k, u, of = F.col("k"), F.col("u"), lambda x: F.sum(F.when(F.col(unit).isNotNull(), x))
    per = own.groupBy("sample_id", "column", "value").agg(F.sum(k).alias("rows"), of(k).alias("nv"), of(k * k).alias("squares"), of(u * k).alias("cross"))
    x = per.withColumn("n", F.sum("rows").over(Window.partitionBy("sample_id", "column"))).where("nv > 0")
    n, nv, squares, cross = F.col("n"), F.col("nv"), F.col("squares"), F.col("cross")
    if pattern is None:
        same, less, half = (n == nv).cast("long"), -F.lit(1).cast("long"), 1
    elif pattern == "within_groups":
        same, less, half = squares - nv, squares + nv - 2 * cross, 2
    else:
        same, less, half = nv * nv - squares, nv * nv - squares - 2 * n * nv + 2 * cross, 1 if pattern == "between_groups" else 2
    summed = x.groupBy("column", "value").agg(F.sum(same).alias("same"), F.sum(less).alias("less"))
    return summed.select("column", "value", F.expr(f"same div {half}").alias("eq_vio"), (F.lit(total) + F.expr(f"less div {half}")).cast("long").alias("ne_vio"))


def pairwise(samples: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """(column, op, pairs) for = and != of each column."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])
    long = samples.select("sample_id", _unit(pattern), F.explode(values).alias("x")).select("sample_id", _unit(pattern), "x.column", "x.value").where("value IS NOT NULL")
    whole = _pair_sum(long, ["column"], pattern).withColumnRenamed("pairs", "filled")
    same = _pair_sum(long, ["column", "value"], pattern).groupBy("column").agg(F.sum("pairs").alias("same"))
    both = whole.join(same, "column")
    return both.select("column", F.explode(F.array(F.struct(F.lit("=").alias("op"), F.col("same").alias("pairs")), F.struct(F.lit("!=").alias("op"), (F.col("filled") - F.col("same")).alias("pairs")))).alias("x")).select("column", "x.op", "x.pairs")


def whole_groups(samples: DataFrame, conditions: list[Condition]) -> DataFrame:
    """(cond, matched) samples all of whose rows match, by number."""
    hits = F.array(*[F.struct(F.lit(i).alias("cond"), c.to_column(samples.schema).alias("hit")) for i, c in enumerate(conditions)])
    per_sample = samples.select("sample_id", F.explode(hits).alias("x")).groupBy("sample_id", "x.cond").agg(F.bool_and("x.hit").alias("all"))
    return per_sample.where("all").groupBy("cond").agg(F.count(F.lit(1)).alias("matched"))


def is_pairwise(condition: Condition) -> bool:
    return isinstance(condition, PairWise)


def flatten(nested: DataFrame, key: str = "group_key", samples: str = "samples") -> DataFrame:
    """(sample_id, role, row_id, row) of nested samples: array<map<role, array<row>>> per group key."""
    one = nested.select(key, F.posexplode(samples).alias("rep", "roles"))
    roles = one.select(F.concat_ws("#", F.col(key).cast("string"), F.col("rep").cast("string")).alias("sample_id"), F.explode("roles").alias("role", "rows"))
    return roles.select("sample_id", "role", F.posexplode("rows").alias("row_id", "row"))


def with_violations(satisfying: DataFrame, violating: DataFrame, include: bool) -> DataFrame:
    """Rows for confidence: satisfying rows, and on request the violating ones, each role a sample of its own."""
    if not include:
        return satisfying
    apart = violating.withColumn("sample_id", F.concat_ws("_", F.col("sample_id").cast("string"), F.col("role").cast("string")))
    return satisfying.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(apart, allowMissingColumns=True)

"""What keeps the larger tables within their limits: how often rows are taken apart, shuffled and read."""

import random

import pytest
from pyspark.sql import functions as F

from rulelens.functions.conditions import ColumnValue, Numerical
from rulelens.functions.scoring import VIOLATING
from rulelens.operators import baselines, pairs, quantiles, rules, sides, splits
from rulelens.plans import catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_node_counts_take_only_numbers_apart(spark):
    rows = [("a", "x", 1.0, False), ("a", None, 2.0, True), ("b", "x", None, True), (None, "y", 2.0, False), ("b", "y", float("nan"), False)]
    df = spark.createDataFrame(rows, f"c string, d string, n double, {VIOLATING} boolean")
    nodes = [frozenset([ColumnValue("c", "=", "a")]), frozenset([ColumnValue("c", "!=", "a"), Numerical("n", ">=", 2.0)])]
    found = baselines.node_counts(df, nodes, ["c", "d"], ["n"])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        (0, "", None, None, 2, 1), (0, "c", "a", None, 2, 1), (0, "d", "x", None, 1, 0), (0, "d", None, None, 1, 1), (0, "n", None, 1.0, 1, 0), (0, "n", None, 2.0, 1, 1),
        (1, "", None, None, 1, 0), (1, "c", None, None, 1, 0), (1, "d", "y", None, 1, 0), (1, "n", None, 2.0, 1, 0),
    ]))
    apart = baselines.node_counts(df, nodes, ["c"], ["n"])
    rows_apart = [line for line in plan_of(apart).splitlines() if "Generate explode" in line]
    assert len(rows_apart) == 2 and not any("CASE" in line for line in rows_apart)


def test_samples_are_shuffled_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rules, "PART_ROWS", 1000)
    plan = plan_of(pairs.pairwise_all(catalog.keyed_samples(spark, sf_dir), ["l_returnflag"]))
    by = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    # the rows and their keys by order, and what little is left by pattern and column
    assert by.count("l_orderkey") == 2 and len(by) <= 4 and not {"sample_id", "l_linenumber"} & set(by)


def test_samples_of_several_columns_are_named_by_all(spark):
    rows = spark.createDataFrame([(1, "a", "x", 5), (1, "a", "x", 4), (1, None, "y", 3), (2, "b", "y", 2)], "g long, h string, r string, v long")
    units = rows.groupBy("g", "h").agg((F.count("*") > 1).alias(VIOLATING))
    found = rules.samples(rules.together(rows, ["g"], 4), units, ["g", "h"], F.col("r"), ["v"]).select("sample_id", "role", "row_id", "v", VIOLATING)
    assert sorted(map(tuple, found.collect())) == [("1|a", "x", 0, 4, True), ("1|a", "x", 1, 5, True), ("2|b", "y", 0, 2, False)]
    one = rules.samples(rows, units.groupBy("g").agg(F.bool_or(VIOLATING).alias(VIOLATING)), ["g"], F.col("r"), ["v"])
    assert {r["sample_id"] for r in one.collect()} == {1, 2}


def test_names_of_samples_have_partitions_by_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(rules, "PART_ROWS", 1000)
    named = [line for line in plan_of(catalog.confidence_with_violations(spark, sf_dir)).splitlines() if "hashpartitioning(sample_id" in line]
    assert len(named) == 1 and "REPARTITION_BY_NUM" in named[0]


def small_samples(spark):
    rows = [(s, "xy"[i % 2], i // 2, "ab"[(s + i) % 2] if i else None, float(i), s % 2 == 0) for s in range(6) for i in range(5)]
    return spark.createDataFrame(rows, f"sample_id long, role string, row_id int, v string, x double, {VIOLATING} boolean")


def test_value_pairs_join_nothing(spark):
    samples = small_samples(spark)
    assert "Join" not in plan_of(pairs.value_pairs(samples, ["v"], "between_groups", 10))
    every = pairs.explicit(samples, "between_groups").cache()
    for r in pairs.value_pairs(samples, ["v"], "between_groups", every.count()).collect():
        a, b = (F.col(f"{x}.v").eqNullSafe(F.lit(r["value"])) for x in "ab")
        assert (r["eq_vio"], r["ne_vio"]) == (every.where(a & b).count(), every.where(~a & ~b).count())


def test_conditions_are_counted_in_parts(spark, monkeypatch):
    samples, conditions = small_samples(spark), [ColumnValue("v", "=", "a"), Numerical("x", ">=", 99.0), ColumnValue("v", "!=", "a")]
    monkeypatch.setattr(pairs, "WIDE", 2)
    every = pairs.explicit(samples, "within_groups").cache()
    expected = {i: every.where(c.to_column(samples.schema, "a") & c.to_column(samples.schema, "b")).count() for i, c in enumerate(conditions) if i != 1}
    assert {r["cond"]: r["pairs"] for r in pairs.matching(samples, conditions, "within_groups").collect()} == expected
    assert {r["cond"]: r["n"] for r in pairs.meeting(samples, conditions).collect()} == {i: samples.where(conditions[i].to_column(samples.schema)).count() for i in (0, 2)}


def test_partners_between_groups_join_nothing(spark):
    samples = small_samples(spark)
    node = [frozenset([ColumnValue("v_1", "=", "a"), Numerical("x_2", ">=", 2.0)])]
    found = sides.partners(samples, node, "between_groups")
    assert "Join" not in plan_of(found)
    every = pairs.explicit(samples, "between_groups").where("a.v = 'a' AND b.x >= 2")
    rows = found.select(F.explode("weights").alias("w")).groupBy("w.side").agg(F.sum("w.n").alias("n")).collect()
    assert {r["side"]: r["n"] for r in rows} == {1: every.count(), 2: every.count()}


@pytest.fixture
def unsteady(monkeypatch):
    """Approximate quantiles that are others whenever they are computed, as they may be on several executors."""
    some = F.udf(lambda xs: sorted(random.SystemRandom().sample(xs, 9)), "array<double>")
    monkeypatch.setattr(F, "percentile_approx", lambda value, *_: some(F.collect_list(value)))


def test_unsteady_edges_of_slices_leave_quantiles_exact(spark, unsteady):
    counted = spark.createDataFrame([("x", float(i), 1 + i % 3) for i in range(300)], "column string, value double, n long").cache()
    every = sorted(float(i) for i in range(300) for _ in range(1 + i % 3))
    found = quantiles.quantiles_of(counted, [0.25, 0.5, 0.75]).first()["values"]
    assert found == [every[int(p * 599)] + (every[int(p * 599) + 1] - every[int(p * 599)]) * (p * 599 % 1) for p in (0.25, 0.5, 0.75)]
    rows = spark.createDataFrame([(i * 37 % 400 / 7, i % 3 == 0) for i in range(400)], f"x double, {VIOLATING} boolean")
    found = {c.value for s in baselines.search_space(rows) for c in getattr(s, "conditions", [s])}
    assert sorted(found) == pytest.approx([p * 399 / 7 for p in (0.2, 0.4, 0.6, 0.8)])


def test_unsteady_edges_of_slices_leave_splits_exact(spark, unsteady):
    rows = [("x", float(i), 3, i * i % 4) for i in range(300)]
    counted = spark.createDataFrame(rows, "column string, value double, n long, v long").cache()
    found = {r["split_value"]: (r["n_left"], r["v_left"]) for r in splits.gains_of(counted).collect()}
    expected = {i + 0.5: (3 * (i + 1), sum(r[3] for r in rows[: i + 1])) for i in range(299)}
    assert len(found) > 100 and found == {cut: expected[cut] for cut in found}
    rows = spark.createDataFrame([(float(i * 37 % 400), i * 37 % 400 >= 250) for i in range(400)], f"x double, {VIOLATING} boolean")
    found = baselines.tree_rules(rows, [], ["x"], depth=1)
    assert [(r["condition"], r["sat_matches"], r["vio_matches"]) for r in found] == [(Numerical("x", "<", 249.5), 250, 0)]

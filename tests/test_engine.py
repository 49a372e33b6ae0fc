import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rulelens.functions.conditions import ColumnValue, Conjunction, Numerical, PairWise
from rulelens.functions.scoring import VIOLATING
from rulelens.operators import baselines, evaluation, pairs, sampling, screening
from rulelens.operators.splits import best_splits
from rulelens.plans import catalog, discovery, multi_row, single_row

#: Queries that are cheap enough to compare in every run; the rest of them share their code.
QUICK = "suggest_multi_whole suggest_single_row hybrid_rank search_space subgroup_beam reconstruct_samples tree_rules atomic_eq atomic_neq merged_in conjunction_3 numeric_splits potential_numeric pair_both_sides pairwise_neq redundancy_filter sample_informative hier_sample tree_stump rule_monotonic".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf_dir, db, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    sql = db.sql(catalog.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(sql.columns)
    rows = sorted(tuple(repr(r[c]) for c in names) for r in got.collect())
    assert rows == sorted(tuple(repr(r[sql.columns.index(c)]) for c in names) for r in sql.fetchall())


def test_all_oracles_belong_to_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(3)
    rows = []
    for s in range(60):
        for role in "xy"[: r.randrange(1, 3)]:
            rows += [(str(s), role, i, r.choice(["a", "b", None]), r.random(), s % 3 == 0) for i in range(r.randrange(1, 5))]
    return spark.createDataFrame(rows, f"sample_id string, role string, row_id int, v string, x double, {VIOLATING} boolean")


@pytest.mark.parametrize("pattern", pairs.PATTERNS)
def test_counts_equal_explicit_pairs(samples, pattern):
    every = pairs.explicit(samples, pattern).cache()
    assert pairs.total(samples, pattern).first()[0] == every.count()
    conditions = [ColumnValue("v", "=", "a"), ColumnValue("v", "!=", "a"), Numerical("x", ">=", 0.5)]
    got = {r[0]: r[1] for r in pairs.matching(samples, conditions, pattern).collect()}
    for i, c in enumerate(conditions):
        assert got.get(i, 0) == every.where(c.to_column(samples.schema, "a") & c.to_column(samples.schema, "b")).count()
    two = {(r[0], r[1]): r[2] for r in pairs.pairwise(samples, ["v"], pattern).collect()}
    for op in ("=", "!="):
        assert two["v", op] == every.where(PairWise("v", op).pair_column()).count()


def test_planted_condition_comes_first(spark):
    r = random.Random(1)
    rows = [(r.choice("abcd"), r.choice(["u", "v"]), r.random()) for _ in range(1500)]
    rows = [(c, d, x, not (c == "a" and d == "u") if r.random() < 0.97 else r.random() < 0.5) for c, d, x in rows]
    df = spark.createDataFrame(rows, f"c string, d string, x double, {VIOLATING} boolean")
    sought = Conjunction({ColumnValue("c", "=", "a"), ColumnValue("d", "=", "u")})
    found = single_row.suggest(df, ["c", "d"], [])
    assert found[0]["condition"] == sought
    assert found == single_row.suggest(df.repartition(7), ["c", "d"], [])
    engine = discovery.Engine(["c", "d"], ["x"])
    ranking = engine.discover("r", discovery.SINGLE, df)
    assert evaluation.rank_of(df, ranking, sought) == 1 and engine.timing.total > 0
    assert single_row.suggest(df.where(VIOLATING), ["c"], []) == []
    assert any("c" in x["condition"].columns() for x in baselines.tree_rules(df, ["c", "d"], []))
    assert sought in [x["condition"] for x in baselines.subgroup_beam(df.drop("x"), depth=2)]


def test_multi_row_miner_and_single_evaluation(samples):
    for pattern in ("between_groups", "whole_group"):
        for r in multi_row.suggest(samples, ["v"], ["x"], pattern)[:3]:
            again = multi_row.evaluate(samples, r["condition"], pattern, multi_row.MIN_SUPPORT)
            assert again["confidence"] == pytest.approx(r["confidence"]) and again["penalty"] == pytest.approx(r["penalty"])
    assert multi_row.pattern_of("Unique Key Constraint Rules") == "within_groups"


def test_failing_advisor_keeps_all_columns(spark):
    class Broken(discovery.EveryColumn):
        def relevance(self, rule, columns):
            raise RuntimeError("offline")

    df = spark.createDataFrame([("a", True), ("b", False)] * 20, f"c string, {VIOLATING} boolean")
    assert discovery.Engine(["c"], [], advisor=Broken()).discover("r", discovery.SINGLE, df)


def test_edges_of_splits_screening_and_sampling(spark):
    flat = spark.createDataFrame([(1.0, True), (1.0, False)], f"x double, {VIOLATING} boolean")
    assert best_splits(flat, ["x"]).count() == 0
    assert screening.numerical(flat, ["x"]).count() == 0
    empty = flat.limit(0)
    assert screening.decision(empty, [], ["x"]).first()["reason"] == "No data samples"
    rows = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("c"))
    assert sampling.uniform(rows, 0).count() == 0 and sampling.uniform(rows, 99).count() == 50
    assert {r[0] for r in sampling.informative(rows, 3, ["c"]).select("c").collect()} == {"0", "1", "2"}

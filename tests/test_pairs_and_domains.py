"""Trees, subgroups and conjunctions over pairs against explicit pairs; domains by typed value; ranking of many values."""

import datetime
import decimal
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rulelens.functions.conditions import ColumnValue, MergedValues, Numerical
from rulelens.functions.scoring import VIOLATING
from rulelens.operators import baselines, conjunctions, domains, pairs, sides
from rulelens.plans import multi_row, single_row


def random_samples(spark, seed, roles="xy", both=True):
    r = random.Random(seed)
    rows = []
    for s in range(70):
        bad = s % 3 == 0
        own = roles if bad or both else "x"
        for role in own[: r.randrange(1, len(own) + 1)]:
            rows += [(str(s), role, i, r.choice(["a", "b", "c", None] if bad else ["a", "a", "b", None]), r.choice([1.0, 2.0, 5.0, None, float("nan")]), bad) for i in range(r.randrange(1, 5))]
    rows += [(None, "x", 0, "a", 1.0, False), ("0", None, 0, "a", 1.0, True)]
    return spark.createDataFrame(rows, f"sample_id string, role string, row_id int, v string, x double, {VIOLATING} boolean").repartition(3).cache()


@pytest.mark.parametrize("both", [True, False])
def test_pair_tree_and_subgroups_equal_those_of_explicit_pairs(spark, both):
    """both: satisfying samples have pairs between groups; else all their pairs are taken, in the order of row ids."""
    samples = random_samples(spark, 5 if both else 6, both=both)
    every = baselines.pair_rows(samples, ["v", "x"]).cache()
    names = {"categorical": ["v_1", "v_2"], "numerical": ["x_1", "x_2"]}
    plain = [(r | {"condition": baselines.row_condition(r["condition"])}) for r in baselines.tree_rules(every, **names, depth=2, min_support=1)]
    assert plain and sides.pair_tree_rules(samples, ["v"], ["x"], depth=2, min_support=1) == plain
    plain = [(r | {"condition": baselines.row_condition(r["condition"])}) for r in baselines.subgroup_beam(every.select(VIOLATING, "v_1", "v_2", "x_1", "x_2"), depth=2 if both else 3)]
    got = sides.pair_subgroups(samples, ["v", "x"], depth=2 if both else 3)
    assert len(plain) == 20 and got == plain


def test_ordered_partners_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sides, "BLOCK", 4)
    rows = [("s", "x" if i % 3 else "y", i // 2, i % 5, False) for i in range(60)]
    samples = spark.createDataFrame(rows, f"sample_id string, role string, row_id int, v int, {VIOLATING} boolean")
    node = frozenset([Numerical("v_1", "<", 3.0), Numerical("v_2", ">=", 1.0)])
    got = sides.partners(samples, [node], "all_combinations").select("row_id", "v", F.explode("weights").alias("w")).select("w.side", "w.n").groupBy("side").agg(F.sum("n")).collect()
    want = sum(a[2] < b[2] and a[3] < 3 and b[3] >= 1 for a in rows for b in rows)
    assert dict(map(tuple, got)) == {1: want, 2: want}


def test_value_meetings_equal_explicit_pairs(spark):
    samples = random_samples(spark, 8).withColumn("k", F.col("row_id") + 1)
    got = sides.value_meetings(samples, ["v"], ["k"])
    want = pairs.explicit(samples, "between_groups").groupBy(F.col(f"a.{VIOLATING}").alias(VIOLATING), F.col("a.v").alias("v_1"), F.col("b.v").alias("v_2"))
    want = want.agg(F.count(F.lit(1)).alias("n"), F.sum("a.k").cast("double").alias("k_1"), F.sum("b.k").cast("double").alias("k_2"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("pattern", [*pairs.PATTERNS, None])
@pytest.mark.parametrize("dense", [0, 1000])
def test_sets_of_conditions_equal_explicit_pairs(spark, pattern, dense):
    """dense 0: every sample is counted by set; 1000: by common signatures."""
    samples = random_samples(spark, 3).where("sample_id IS NOT NULL AND role IS NOT NULL")
    sat, vio = samples.where(~F.col(VIOLATING)), samples.where(VIOLATING)
    pool = [ColumnValue("v", "=", "a"), ColumnValue("v", "!=", "b"), Numerical("x", "<", 3.0), Numerical("x", ">=", 2.0), MergedValues("role", {"x", "y"}, "="), ColumnValue("role", "=", "x")]
    got = {tuple(r[0]): (r[1], r[2]) for r in conjunctions.sample_sets(sat, vio, pool, pattern, "row_id" if pattern == "all_combinations" else "role", dense).counts(1).collect()}
    hits = F.array(*[c.to_column(samples.schema) for c in pool])
    rows = samples.select("sample_id", "role", "row_id", hits.alias("hits"), VIOLATING).collect()
    meets = {
        "between_groups": lambda a, b: a.role != b.role, "within_groups": lambda a, b: a.role == b.role and a.row_id < b.row_id, "all_combinations": lambda a, b: a.row_id < b.row_id,
    }.get(pattern)
    bad = [r for r in rows if r[VIOLATING]]
    units = [(a, b) for a in bad for b in bad if a.sample_id == b.sample_id and meets(a, b)] if pattern else [[r for r in bad if r.sample_id == s] for s in {r.sample_id for r in bad}]
    for k in (2, 3):
        for ids in combinations(range(len(pool)), k):
            if len({next(iter(pool[i].columns())) for i in ids}) < k:
                assert ids not in got
                continue
            whole = lambda r: all(r.hits[i] for i in ids)  # noqa: B023, E731
            n_sat, n_vio = sum(whole(r) for r in rows if not r[VIOLATING]), sum(all(map(whole, u)) for u in units)
            assert got.get(ids, (0, n_vio)) == (n_sat, n_vio)


@pytest.mark.parametrize("pattern", [*pairs.PATTERNS, None])
def test_pairs_of_all_values_equal_those_of_conditions(spark, pattern):
    vio = random_samples(spark, 4).where(f"{VIOLATING} AND role IS NOT NULL")
    total = pairs.total(vio, pattern).first()[0] if pattern else vio.select("sample_id").distinct().count()
    got = {(r[0], r[1]): (r[2], r[3]) for r in pairs.value_pairs(vio, ["v", "x"], pattern, total).collect()}
    for value in ("a", "b", None):
        conditions = [ColumnValue("v", op, value) for op in ("=", "!=")]
        want = {r[0]: r[1] for r in (pairs.matching(vio, conditions, pattern) if pattern else pairs.whole_groups(vio, conditions)).collect()}
        assert got["v", value] == (want.get(0, 0), want.get(1, 0))
    assert got["x", "2.0"][0] <= total and ("x", "NaN") not in got


DAY = datetime.date(2024, 5, 17)


@pytest.mark.parametrize(
    ("kind", "one", "two", "given"),
    [
        ("int", 5, 7, [5.0, 7.0]), ("double", 1e7, 2.5, [10000000, 2.5]), ("double", 0.0, 1.0, [-0.0, 1]), ("decimal(10,2)", decimal.Decimal("5.00"), decimal.Decimal("6.10"), [5.0, 6.1]), ("string", "NA", "x", ["NA", "x"]),
        ("date", DAY, DAY.replace(day=3), ["2024-05-17", "2024-05-03"]), ("boolean", True, False, [1, 0]), ("bigint", 1 << 40, 3, [float(1 << 40), 3, "3", 2.5, 1e300]), ("float", 0.5, 2.0, [0.5, 2]),
        ("timestamp", datetime.datetime(2024, 5, 17, 12), datetime.datetime(2024, 5, 1), ["2024-05-17 12:00:00", "2024-05-01"]),
    ],
)
def test_given_domains_match_by_typed_value(spark, kind, one, two, given):
    """One value decides: it must be found with its domain given as it may be stored, as without a domain."""
    df = spark.createDataFrame([(i, one if i % 8 >= 4 else two, i % 8 < 4) for i in range(200)], f"id long, c {kind}, {VIOLATING} boolean").coalesce(2)
    found, free = (single_row.suggest(df, ["c"], [], domains=d) for d in ({"c": given}, None))
    assert found and found[0]["confidence"] == 1.0 and found[0]["penalty"] == 0.0
    assert [(r["confidence"], r["penalty"]) for r in found] == [(r["confidence"], r["penalty"]) for r in free] or len(given) > 2
    for r in found:  # the condition itself says so of the rows
        assert df.where(r["condition"].to_column(df.schema)).where(~F.col(VIOLATING)).count() == r["sat_matches"]
    if kind == "decimal(10,2)":  # the multi-row miner takes its values the same way
        samples = df.withColumns({"sample_id": F.expr("id div 4"), "role": F.lit("r"), "row_id": F.col("id")})
        assert ColumnValue("c", "=", 5) in {r["condition"] for r in multi_row.suggest(samples, ["c"], [], "whole_group", domains={"c": given})}


def test_null_words_are_text_where_rows_have_them_and_null_elsewhere(spark):
    rows = [("NA" if i % 2 else "x", None if i % 2 else "x", i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, f"t string, n string, {VIOLATING} boolean")
    first = lambda **k: {r["condition"] for r in single_row.suggest(df, [*k["domains"]], [], **k)}
    assert ColumnValue("t", "=", "NA") in first(domains={"t": ["NA", "x"]})
    assert ColumnValue("n", "=", None) in first(domains={"n": ["None", "x"]})
    assert ColumnValue("n", "=", None) in first(domains={"n": ["x"]}, special={"n": ["nan"]})


def test_one_value_of_very_many_is_found_without_a_domain(spark):
    rows = [(i % 3000, i % 3000 != 2999 and i % 3 != 0) for i in range(9000)] + [(5000, False)] * 400
    df = spark.createDataFrame(rows, f"c int, {VIOLATING} boolean")
    best = single_row.suggest(df, ["c"], [])[0]
    assert best["condition"] == ColumnValue("c", "=", 5000) and best["sat_matches"] == 400


def test_best_values_are_those_of_a_full_ranking(spark):
    r = random.Random(2)
    counts = spark.createDataFrame([("c", str(i), r.randrange(60), r.randrange(60)) for i in range(900)], "column string, value string, eq_sat long, eq_vio long")
    full = counts.withColumns({"ne_sat": 5000 - F.col("eq_sat"), "ne_vio": 4000 - F.col("eq_vio")})
    all_ = domains.scored(full, {"c": 900}, 5000, 4000, 5)
    kept = {(x["op"], x["value"]) for x in domains.best(all_, 0.4, 5000, 7).collect()}
    rows = [x for x in all_.collect() if x["score"] >= 0.4]
    inf = lambda x: x["confidence"] - x["penalty"]
    for op in ("=", "!="):
        own = [x for x in rows if x["op"] == op]
        for key in (lambda x: (-x["score"], -x["confidence"]), lambda x: -inf(x), lambda x: -x["confidence"], lambda x: (-(x["score"] + 0.3 * inf(x)), -x["confidence"])):
            best = sorted(own, key=key)[6]
            assert {(op, x["value"]) for x in own if key(x) < key(best)} <= kept


def test_domain_sizes(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 2, False), (None, None, False)], f"s string, n int, {VIOLATING} boolean")
    counts = domains.side_counts(df, ["s", "n"])
    d = domains.Domains(counts, df.schema, ["s", "n"], {"n": [1, 1.0, 9, "x"]}, {"s": ["a", "z", None]})
    assert d.sizes == {"s": 4, "n": 3} and d.value("n", "9") == 9 and d.value("s", None) is None
    got = {(r["column"], r["value"]): r["sat"] for r in d.candidates(counts).collect()}
    assert got == {("s", "a"): 0, ("s", "b"): 1, ("s", "z"): None, ("s", None): 1, ("n", "1"): 0, ("n", "9"): None}
    none = domains.Domains(counts.limit(0), df.schema, ["s"], {}, {})
    assert none.sizes == {"s": 0} and none.candidates(counts.limit(0)).count() == 0

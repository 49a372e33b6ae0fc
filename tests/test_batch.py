"""Batches of rules, advisors, quantiles, and the frames that comparison methods get."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.functions.conditions import ColumnValue, Conjunction, Numerical
from rulelens.functions.scoring import VIOLATING
from rulelens.operators import baselines, lookup, pairs, quantiles, sampling, sides
from rulelens.plans import batch, discovery, single_row
from rulelens.plans.advisors import ModelAdvisor, Retrying
from rulelens.sources.model import DataUnderstanding, ReferencingPair


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles(spark, n):
    r = random.Random(n)
    data = [(r.choice([r.randrange(5), r.random() * 9, None]), float(i)) for i in range(n)]
    got = quantiles.wide(spark.createDataFrame([(None if a is None else float(a), b) for a, b in data], "a double, b double"), ["a", "b"], [0, 0.1, 0.5, 0.9, 1]).first()
    for k, c in enumerate("ab"):
        values = [float(x[k]) for x in data if x[k] is not None]
        assert got[c] is None if not values else np.allclose(got[c], np.quantile(values, [0, 0.1, 0.5, 0.9, 1]))


def test_rules_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" if i % 3 else "y", i % 7) for i in range(60)], "row_id long, kind string, size long")
    sat, vio = [i for i in range(60) if i % 3], [i for i in range(60) if i % 3 == 0]
    condition = {"type": "ColumnValueCondition", "column": "kind", "operator": "=", "value": "x"}
    pairs_ = {f"('g', {i})": [{"1": [i], "2": [i + 30]}] for i in range(30)}
    entries = [
        {"rule_id": 1, "rule_type": "fd", "rule": {"rule": "r"}, "execution_result": {"satisfactions": sat, "violations": vio}, "condition": condition},
        {"rule_id": 2, "rule_type": "fd", "rule": {"rule": "r"}, "execution_result": {"satisfactions": pairs_, "violations": pairs_}},
        {"rule_id": 3, "rule_type": "fd", "rule": {"rule": "r"}},
    ]
    (tmp_path / "data" / "fd").mkdir(parents=True)
    (tmp_path / "data" / "fd" / "candidate_rules_cache.json").write_text(json.dumps(entries))
    known = DataUnderstanding(categorical_columns={"kind": {"x", "y"}})
    report = batch.run(batch.tasks({"data": (rows, known), "none": (rows, known)}, str(tmp_path), ["fd", "other"]), batch.engine_strategy())
    assert [r["rule_id"] for r in report.records] == [1, 2]
    assert report.records[1]["rank"] is None and all(r["mining"] > 0 and r["sampling"] > 0 for r in report.records)
    assert report.metrics(spark).first()["rules"] == 2 and report.times(spark).first()["n"] == 2


def test_sample_of_small_and_no_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    assert sampling.sample(rows, 0).count() == sampling.sample(rows, -1).count() == 0
    assert sampling.sample(rows, 10).count() == sampling.sample(rows, 99, False).count() == 10
    assert sampling.sample(rows, 4, False).count() == sampling.sample(rows, 4).count() == 4


def test_rows_of_groups(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "id long")
    groups = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "entity string, id long")
    assert sorted(map(tuple, lookup.entity_group_rows(rows, groups, "id").select("entity", "id").collect())) == [("a", 0), ("a", 1), ("b", 1)]
    with pytest.raises(ValueError, match="c"):
        lookup.entity_group_rows(rows, groups.union(spark.createDataFrame([("c", 9)], groups.schema)), "id")
    with pytest.raises(ValueError, match="column"):
        lookup.entity_group_rows(rows, groups, "nothing")


def test_pairs_for_trees(spark):
    data = [("s", r, i, v, False) for r, i, v in (("0", 0, 1), ("0", 1, 2), ("0", 2, 3))] + [("t", r, 0, v, True) for r, v in (("0", 1), ("1", 9))]
    samples = spark.createDataFrame(data, f"sample_id string, role string, row_id long, v long, {VIOLATING} boolean")
    got = sorted(map(tuple, baselines.pair_rows(samples, ["v"]).collect()))
    assert got == [(1, 2, False), (1, 3, False), (1, 9, True), (2, 3, False), (9, 1, True)]
    both = Conjunction(frozenset([ColumnValue("v_1", "=", 1), ColumnValue("v_2", "=", 1)]))
    assert baselines.row_condition(both) == ColumnValue("v", "=", 1)
    assert baselines.row_condition(Conjunction(frozenset([ColumnValue("v_1", "=", 1), Numerical("w_2", "<", 3.0)]))) == Conjunction(frozenset([ColumnValue("v", "=", 1), Numerical("w", "<", 3.0)]))
    assert all(not str(r["condition"]).count("_1") for r in sides.pair_tree_rules(samples, [], ["v"], min_leaf=1, min_support=1))


def test_patterns_at_once(spark):
    r = random.Random(4)
    data = [(str(i // 9), str(r.randrange(3)), i, r.choice(["a", "b", None])) for i in range(90)]
    samples = spark.createDataFrame(data, "sample_id string, role string, row_id long, c string")
    condition = ColumnValue("c", "=", "a")
    all_ = {(x["pattern"], x["cond"]): x["pairs"] for x in pairs.matching_all(samples, [condition]).collect()}
    two = {(x["pattern"], x["op"]): x["pairs"] for x in pairs.pairwise_all(samples, ["c"]).collect()}
    for p in pairs.PATTERNS:
        assert all_[p, 0] == pairs.matching(samples, [condition], p).first()["pairs"]
        assert {op: n for (q, op), n in two.items() if q == p} == {x["op"]: x["pairs"] for x in pairs.pairwise(samples, ["c"], p).collect()}


def test_advisors():
    asked, waits = [], []

    def ask(prompt):
        asked.append(prompt)
        if len(asked) < 3:
            raise OSError("busy")
        return json.dumps({"a": "unrelated", "b": "nonsense"})

    model = ModelAdvisor(ask)
    model.inform({"a": [1, 2, 3, 4, 5, 6]}, {"a": 60})
    advisor = Retrying(model, sleep=waits.append)
    assert advisor.relevance("r", {"a": "meaning", "b": ""}) == {"a": "unrelated"}
    assert len(asked) == 3 and waits == [10.0, 10.0] and "high cardinality" in asked[0] and "1, 2, 3, 4, 5;" in asked[0]
    slow = Retrying(ModelAdvisor(lambda p: __import__("time").sleep(0.5) or "{}"), attempts=2, limits={"utility": 0.01}, sleep=waits.append)
    with pytest.raises(TimeoutError):
        slow.utility({"a": ""})
    engine = discovery.Engine(["a"], [], advisor=ModelAdvisor(lambda p: "false" if str(results[0]["condition"]) in p else "true"))
    results = [{"condition": ColumnValue("a", "=", v)} for v in (1, 2)]
    assert engine.verified("r", results) == results[1:]


def test_stored_column_pairs(tmp_path):
    known = DataUnderstanding(referencing_column_pairs=[ReferencingPair("id", "manager", "points up")])
    known.save(str(tmp_path))
    (tmp_path / "samples.csv").write_text("a\n1\n")
    assert DataUnderstanding.load(str(tmp_path)).referencing_column_pairs == known.referencing_column_pairs
    path = tmp_path / "data_understanding.json"
    data = json.loads(path.read_text())
    data["referencing_column_pairs"] = {"column_pairs": [{"identifier_column": "id", "reference_column": "manager", "details": "d", "more": 1}]}
    path.write_text(json.dumps(data))
    assert DataUnderstanding.load(str(tmp_path)).referencing_column_pairs == [ReferencingPair("id", "manager", "d")]


def test_verification_and_failed_answers_in_discovery(spark):
    class Strict(discovery.EveryColumn):
        asked, told = 0, None

        def utility(self, columns):
            Strict.asked += 1
            return {} if Strict.asked == 1 else {"c": "categorical"}

        def verify(self, rule, condition, columns):
            Strict.told = columns
            return "value of: a" not in condition

    df = spark.createDataFrame([("a", "u", True), ("b", "u", False), ("c", "w", False)] * 20, f"c string, d string, {VIOLATING} boolean")
    engine = discovery.Engine(["c", "d"], [], {"c": "a letter"}, advisor=Strict())
    plain = engine.discover("r", discovery.SINGLE, df)
    checked = engine.discover("r", discovery.SINGLE, df, ["d"], verify_top=len(plain))
    assert 0 < len(checked) < len(plain) and all("value of: a" not in str(r["condition"]) for r in checked)
    assert [r for r in plain if "value of: a" not in str(r["condition"])] == checked
    assert set(Strict.told) <= {"c", "d"} and "d" in Strict.told
    engine.discover("r", discovery.SINGLE, df)
    assert Strict.asked == 2  # a failed answer is asked for again, a good one is kept


def test_rules_mined_together_equal_rules_mined_apart(spark):
    """A rule that has no rows of one kind, and one that leaves rows out, among them."""
    r = random.Random(6)
    rows = [(r.choice("abcd"), r.choice(["u", "v", None]), r.random(), r.random() < 0.4) for _ in range(600)]
    df = spark.createDataFrame([(c, d, x, y, c == "a" or r.random() < 0.2, True, r.choice([True, False, None])) for c, d, x, y in rows], "c string, d string, x double, f0 boolean, f1 boolean, f2 boolean, f3 boolean")
    flags = {str(i): f"f{i}" for i in range(4)}
    together = single_row.suggest_many(df, flags, ["c", "d"], ["x"], groups=[["c", "d"]])
    for name, flag in [("0", "f0"), ("3", "f3")]:
        apart = df.where(f"{flag} IS NOT NULL").withColumn(VIOLATING, F.col(flag))
        assert together[name] == single_row.suggest(apart, ["c", "d"], ["x"], groups=[["c", "d"]])
    assert together["1"] and together["2"] == []
    stored = [batch.Flagged(i, "r", f"f{i}", ColumnValue("c", "=", "a")) for i in range(4)]
    report = batch.run_together("t", df, stored, discovery.Engine(["c", "d"], ["x"], groups=[["c", "d"]]))
    assert [r["conditions"] for r in report.records] == [len(together[k]) for k in flags]
    assert report.frame(spark).count() == 4 and report.metrics(spark).first()["rules"] == 4

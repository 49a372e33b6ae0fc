import pytest
from pyspark.sql import functions as F

from rulelens.functions.conditions import ColumnValue, Conjunction, MergedValues, Numerical, PairWise, from_dict, normalized
from rulelens.functions.scoring import purity_value
from rulelens.operators.candidates import merge_allowed
from rulelens.operators.domains import Domains, scored
from rulelens.operators.ranking import hybrid, ranked, signature


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, "a", 1.0), (1, "b", 5.0), (2, None, None), (3, "1", float("nan"))], "id int, s string, x double")


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (ColumnValue("s", "=", "a"), {0}),
        (ColumnValue("s", "!=", "a"), {1, 2, 3}),
        (ColumnValue("s", "=", None), {2}),
        (ColumnValue("s", "!=", None), {0, 1, 3}),
        (ColumnValue("s", "=", 1), set()),
        (ColumnValue("s", "!=", 1), {0, 1, 2, 3}),
        (ColumnValue("nowhere", "!=", 1), set()),
        (Numerical("x", "<", 5.0), {0}),
        (Numerical("x", ">=", 5.0), {1}),
        (Numerical("s", ">=", 5.0), set()),
        (MergedValues("s", {"a", "b"}, "="), {0, 1}),
        (MergedValues("s", {"a", "b"}, "!="), {2, 3}),
        (MergedValues("s", {"a", None}, "="), {0, 2}),
        (MergedValues("s", {"a", None}, "!="), {1, 3}),
        (MergedValues("s", {1}, "="), set()),
        (Conjunction({ColumnValue("s", "!=", "b"), Numerical("x", "<", 9.0)}), {0}),
        (Conjunction(set()), {0, 1, 2, 3}),
    ],
)
def test_null_and_type_rules(rows, condition, ids):
    assert {r[0] for r in rows.where(condition.to_column(rows.schema)).select("id").collect()} == ids


def test_pairwise_needs_two_known_values(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a"), (None, None)], "l string, r string")
    pair = df.select(F.struct(F.col("l").alias("c")).alias("a"), F.struct(F.col("r").alias("c")).alias("b"))
    assert [r[0] for r in pair.select(PairWise("c", "=").pair_column()).collect()] == [True, False, False, False]
    assert [r[0] for r in pair.select(PairWise("c", "!=").pair_column()).collect()] == [False, True, False, False]
    with pytest.raises(ValueError):
        Conjunction({PairWise("c", "=")})
    with pytest.raises(ValueError):
        ColumnValue("c", "<", 1)


def test_sentences_and_stored_forms():
    c = Conjunction({ColumnValue("a", "=", 1), MergedValues("b", {"x", None, "a"}, "!="), Numerical("n", "<", 2.5)})
    assert str(c) == "the \"a\" column has the value of: 1 AND the \"b\" column value is not in the set: ['a', 'x', None] AND the \"n\" column is less than: 2.5"
    assert from_dict(c.to_dict()) == c
    assert from_dict({"type": "Nothing"}) is None and from_dict({}) is None and from_dict({"type": "NumericalCondition", "kwargs": {}}) is None
    assert c.columns() == {"a", "b", "n"}


def test_normalized_values_and_domains(spark):
    assert normalized(" None ") is None and normalized("<NA>") is None and normalized(2.0) == 2 and normalized("x") == "x"
    counts = spark.createDataFrame([("c", "a", 6, 1), ("c", "b", 2, 3), ("c", None, 1, 0)], "column string, value string, eq_sat long, eq_vio long")
    counts = counts.withColumns({"ne_sat": 9 - F.col("eq_sat"), "ne_vio": 4 - F.col("eq_vio")})
    schema = spark.createDataFrame([], "c string").schema
    for special, values, ops in (({"c": ["None", "a"]}, {"a", "b", None}, {"=", "!="}), ({}, {"a", "b"}, {"="})):
        d = Domains(counts, schema, ["c"], {"c": ["a", "b"]}, special)
        assert d.sizes == {"c": len(values)}
        got = scored(d.candidates(counts), d.sizes, 9, 4, 1).collect()
        assert {(d.value("c", r["value"]), r["op"]) for r in got} == {(v, op) for v in values for op in ops}


def test_merge_pruning():
    assert [merge_allowed(k, 5, "=") for k in (2, 3, 4, 5)] == [True, False, False, False]
    assert [merge_allowed(k, 4, op) for k, op in ((2, "="), (2, "!="), (3, "="))] == [True, False, False]


def test_scores_and_ranks():
    assert purity_value(0.5, 0.25, 4, 5) == 0 and purity_value(0, 0, 9, 5) == 0 and purity_value(0.6, 0.2, 5, 5) == pytest.approx(0.75)
    r = lambda v, s, c: {"condition": ColumnValue("a", "=", v), "score": s, "confidence": c, "penalty": 0.1}
    got = ranked([r(1, 0.6, 0.2), r(2, 0.9, 0.5), r(3, 0.7, 0.3), r(2, 0.9, 0.5)])
    assert [x["condition"].value for x in got] == [2, 3]
    assert signature(PairWise("a", "=")) != signature(PairWise("a", "!="))
    assert hybrid([r(1, 0.5, 0.1)], {"a": "unrelated"})[0]["hybrid_score"] == pytest.approx(0.2 * 0.1 + 0.8 * 0.75)

import json

import pytest

from rulelens.functions.conditions import ColumnValue
from rulelens.functions.scoring import VIOLATING
from rulelens.sources import model, tables
from rulelens.streaming import incremental


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a;b,c;d\n1; ;x\n2;NaN;é\n", encoding="iso-8859-1")
    df = tables.read_csv(spark, str(p))
    assert df.columns == ["a", "b,c", "d"]
    got = [tuple(r) for r in df.orderBy("a").collect()]
    assert [g[2] for g in got] == ["x", "é"] and got[0][1] is None
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "e.csv"))
    assert tables.sniff_delimiter("a,b\n1,2") == "," and tables.sniff_delimiter("a;b;c\n1,5;2;3") == ";" and tables.sniff_delimiter("abc") == ","
    assert tables.to_dicts(df)[0]["a"] == 1


def test_rules_and_understanding(tmp_path):
    entry = {"rule_id": 7, "rule_type": "T", "rule_model": "FDRuleDetail", "rule": {"rule": "a -> b", "explanation": "", "columns": ["a"], "left_side": "a", "right_side": "b", "odd": 1}, "condition": ColumnValue("a", "=", None).to_dict(), "execution_result": {"violations": {"('x', 1)": [{"r": 3}], "(no": []}}}
    folder = tmp_path / "T_x"
    folder.mkdir()
    (folder / "candidate_rules_cache.json").write_text(json.dumps([entry]))
    got = model.load_rules(str(tmp_path), "T x")[7]
    assert isinstance(got.rule, model.FunctionalDependencyRule) and got.condition == ColumnValue("a", "=", None)
    assert got.execution_result["violations"] == {("x", 1): [{"r": 3}], "(no": []}
    assert model.load_rules(str(tmp_path), "other") is None
    (tmp_path / "candidate_rules_cache.json").write_text("no json")
    assert model.load_rules(str(tmp_path), "other") is None
    with pytest.raises(ValueError):
        model.TemporalRule("r", operator="!=")
    u = model.DataUnderstanding({"overview": "x"}, {"a": "A"}, {"a": {1, "b"}}, ["a"], {"a": set()}, [["a"]])
    with pytest.raises(FileNotFoundError):
        model.DataUnderstanding.load(str(tmp_path / "none"))
    u.save(str(tmp_path / "u"))
    (tmp_path / "u" / "samples.csv").write_text("a\n1\n")
    again = model.DataUnderstanding.load(str(tmp_path / "u"))
    assert again.categorical_columns == u.categorical_columns and again.special_values == {"a": set()}


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", True), ("b", False), ("a", False), (None, True)], f"c string, {VIOLATING} boolean")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = incremental.atom_counts(stream, ["c"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, incremental.atom_counts(rows, ["c"]).collect()))


ALL_ENCODINGS = ["utf-8-sig", "utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "iso-8859-1", "cp1252", "cp1250", "macroman", "latin1", "utf-32-be"]


@pytest.mark.parametrize("name", ALL_ENCODINGS)
def test_files_of_every_encoding(spark, tmp_path, name):
    """Those with a mark, zero bytes or valid UTF-8 are told by themselves, encodings of single bytes by name; the file is read as it was written."""
    place = {"cp1250": "Łódź", "cp1252": "Zürich €", "macroman": "São Ω"}.get(name, "Zürich" if name in ("latin1", "iso-8859-1") else "Zürich 日本 Łódź")
    column = "größe" if name != "macroman" else "città"
    lines = [f"{column};zahl;note", *(f"{place};{i};note {i}" for i in range(300))]
    path = tmp_path / "t.csv"
    path.write_bytes("\n".join(lines).encode(name))
    given = name if name in ("cp1250", "cp1252", "macroman") else None
    rows = tables.read_csv(spark, str(path), encoding=given)
    assert rows.columns == [column, "zahl", "note"] and rows.schema["zahl"].dataType.simpleString() == "int"
    assert [tuple(r) for r in rows.orderBy("zahl").collect()] == [(place, i, f"note {i}") for i in range(300)]
    assert tables.read_csv(spark, str(path), encoding=name).columns == [column, "zahl", "note"]


def test_quoted_line_ends_and_late_bytes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "q.csv"), multiline=True).orderBy("a").collect()] == [(1, "x\ny"), (2, "z")]
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"1,plain text\n" * 30_000 + b"2,Z\xfcrich\n")
    assert tables.read_csv(spark, str(tmp_path / "late.csv")).where("a = 2").first()["b"] == "Zürich"
    with pytest.raises(ValueError):
        (tmp_path / "e.csv").write_bytes("﻿".encode("utf-16-le"))
        tables.read_csv(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError, match="utf-7"):
        tables.read_csv(spark, str(tmp_path / "q.csv"), encoding="utf-7")
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, str(tmp_path / "none.csv"))

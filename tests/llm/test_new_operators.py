"""Periodic runs, quality and fill-in-the-middle against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulelens.llm import middle, periodic, quality
from rulelens.llm.queries import QUERIES

ODD = [
    (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "a b " * 40), (4, "a b " * 40), (5, "\n\n\n"), (6, "x\ny\n<S> z\n"), (None, "p q r s\n" * 9), (None, None),
    (7, "é ü 日本 😀\n" * 7 + "end"), (8, "w " * 30_000), (9, "a\x0bb\x0cc\xa0d e " * 10), (10, " ".join(map(str, range(5000)))), (13, "q\r\nq\r\n" * 20), (30, "no newline at the end\nhere"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "n", 1, [2]) for i, t in ODD], "doc_id long, text string, form string, n_runs int, runs array<int>").repartition(3).cache()


def plain_runs(w, least=12):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)  # periods ascend, so the smallest stays
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_periodic_runs_equal_plain_ones():
    r = random.Random(1)
    some = 0
    for _ in range(700):
        n, a = r.choice([r.randrange(130), r.randrange(130), r.randrange(100, 500)]), r.choice([1, 2, 2, 3, 5, 20])
        w = [r.randrange(a) for _ in range(n)]
        for _ in range(r.randrange(3)):
            if n > 14:
                i = r.randrange(n)
                p = 1 + r.randrange(1 + (n - i) // 2)
                for j in range(i + p, min(n, i + r.randrange(1, 8) * p)):
                    w[j] = w[j - p]
        got = periodic.periodic_runs(np.array(w, np.int64))
        assert got == plain_runs(w)
        some += len(got)
    assert some > 1000


def test_periodic_runs_of_long_and_awkward_texts(monkeypatch):
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    cases = [[0] * 2000, [0, 1] * 1000, [0] * 700 + [1] + [0] * 900, fib[-1][:2500], ([0, 1, 2] * 60 + [3]) * 9, list(range(40)) * 30 + list(range(900, 1300)) * 2]
    for part in (periodic.PART, 64):  # blocks in one part, and in many
        monkeypatch.setattr(periodic, "PART", part)
        for w in cases:
            assert periodic.periodic_runs(np.array(w, np.int64)) == plain_runs(w)
    assert periodic.periodic_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


@pytest.mark.parametrize("period", [1, 5, 6, 7, 14, 15, 30, 31, 62, 63])
def test_every_period_has_a_scale(period):
    b = periodic.scale_of(period)
    assert 2 * b - 1 <= max(period, 12 - period) < 4 * b - 1
    w = list(range(1000, 1050)) + [i % period for i in range(max(12, 2 * period))] + list(range(2000, 2050))
    assert periodic.periodic_runs(np.array(w)) == [(50, max(12, 2 * period), period)]


def plain_periodic(doc_id, text):
    """The row of op11, word by word."""
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    first = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_query_equals_plain_rows(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0] for r in docs if len((r[1] or "").split()) <= 700}
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in QUERIES["op11_periodic"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    assert [i for i, t in docs if i in short and got[i] != plain_periodic(i, t)] == []
    assert sum(got[i][1] > 0 for i in short) > 5
    for i, t in docs:  # of the long ones the longest run holds its period, and nothing around it does
        _, n, s, length, q, *_ = got[i]
        if n and i not in short and zlib.crc32(str(i).encode()) % 10:
            w = t.encode().split()
            assert w[s : s + length - q] == w[s + q : s + length]
            assert (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + length == len(w) or w[s + length] != w[s + length - q])


def test_periodic_on_odd_rows(odd):
    rows = [r for r in ODD if r[0] != 8]
    got = periodic.longest(periodic.detect(odd.where("doc_id IS NULL OR doc_id <> 8"), ["doc_id"], periodic.planted))
    assert got.columns == FIELDS
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_periodic(i, t)) for i, t in rows)
    long = periodic.detect(odd.where("doc_id = 8"), ["doc_id", "n_runs"]).first()
    assert [tuple(x) for x in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "w" and long["n_runs"] == 1
    assert periodic.longest(periodic.detect(odd.limit(0), ["doc_id"])).count() == 0


def test_factorisation_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality.Model(np.zeros((1, quality.KNOTS)), 0.3, rng.normal(size=50), rng.normal(size=(50, quality.FACTORS)))
    index, value = rng.permutation(50)[:20], rng.normal(size=20)
    pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(index, value, strict=True)) for j, y in list(zip(index, value, strict=True))[a + 1 :])
    assert abs(m.logit(index, value) - (0.3 + m.w[index] @ value + pairs)) < 1e-9


def test_training_learns_an_interaction():
    """Whether two features agree: no linear score tells."""
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (1500, 2))
    vectors = [(np.array([10 + a, 20 + b]), np.ones(2)) for a, b in bits]
    y = (bits[:, 0] == bits[:, 1]).astype(float)
    model = quality.train(vectors, y, np.zeros((0, quality.KNOTS)), 12)
    assert np.mean([(model.logit(*v) > 0) == bool(t) for v, t in zip(vectors, y, strict=True)]) == 1
    assert not model.v[30].any()


def test_statistics_are_spread_over_two_knots():
    knots = np.arange(quality.KNOTS, dtype=float)[None, :] * 2
    for x, want in ((3.0, {1: 0.5, 2: 0.5}), (-9.0, {0: 1.0}), (99.0, {quality.KNOTS - 1: 1.0}), (4.0, {2: 1.0})):
        places, shares = quality.Model.spread(knots, [x])
        assert {int(p) - quality.BUCKETS: s for p, s in zip(places, shares, strict=True) if s} == want


def test_quality_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op12_quality"](spark, sf_dir).collect()}
    truth = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect())
    assert got.keys() == {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], truth[i]) for i, r in got.items() if r["held_out"] and i in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_quality_ignores_labels_held_out_and_other_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).cache()
    labels = docs.select("doc_id", (F.length("text") % 2).alias("quality"))
    learn = F.col("doc_id") % 2 == 0
    wrong = labels.withColumn("quality", F.when(learn, F.col("quality")).otherwise(1 - F.col("quality")))
    one, two = (quality.fit(docs.withColumn("lang", F.lit(x)), y, learn) for x, y in (("a", labels), ("b", wrong)))
    assert one.w0 == two.w0 and (one.w == two.w).all() and (one.v == two.v).all()


def test_quality_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = [r["score"] for r in quality.score(odd, quality.fit(odd, none), ["doc_id", "form"], ["missing", "n_runs", "form"]).collect()]
    assert len(good) == len(ODD) and max(good) < 1e-9
    labels = spark.createDataFrame([(i, q) for i in range(14) for q in (i % 2, None)] + [(None, 1), (3, 0), (99, 1)], "doc_id long, quality int")
    model = quality.fit(odd, labels, metadata=["n_runs", "form"])
    got = quality.score(odd, model, ["doc_id"], ["n_runs", "form"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    twice = [r["score"] for r in got if r["doc_id"] == 4]
    assert twice[0] == twice[1]
    assert quality.score(odd.limit(0), model, ["doc_id"]).count() == 0
    only = quality.fit(odd, labels.where("quality = 1"))
    assert min(r["score"] for r in quality.score(odd, only, ["doc_id"]).collect()) > 1 - 1e-9


def test_quality_fit_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'GOOD' if i % 2 else 'bad'} text {i}") for i in range(300)] + [(None, "x")] * 50 + [(1, f"more {i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality, "train", lambda rows, y, knots: taken.append([len(v[0]) for v in rows]) or quality.Model(knots, 0.0, np.zeros(1), np.zeros((1, 1))))
    quality.fit(docs, labels, label_rows=100)
    quality.fit(docs, labels, label_entries=1000)
    assert 1 < len(taken[0]) <= 100 and 1 < sum(taken[1]) <= 1000


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_middle_query_equals_plain_rows_and_sql(spark, sf_dir):
    import duckdb

    from rulelens.llm.oracles import ORACLES

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_middle"](spark, sf_dir)
    names, rows = got.columns, sorted(map(tuple, got.collect()))
    assert rows == sorted(plain_middle(*r) for r in docs)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES['op13_middle']})").fetchall())


def test_middle_on_odd_rows(odd):
    got = middle.digest(odd)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_middle(*r)) for r in ODD)
    assert middle.digest(odd.limit(0)).count() == 0
    kept = middle.fill_in_middle(odd, ["doc_id"]).columns
    assert kept == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_middle_restores_and_is_lazy():
    r = random.Random(2)
    unit = re.compile(middle.LINES)
    for k in range(400):
        text = "".join(r.choice("a<>PSM\n") for _ in range(r.randrange(40)))
        n, form, a, m, out = middle.transform(text, k, unit)
        assert middle.restore(out, form) == text and n == len(re.findall(unit, text))
        assert form == "plain" or middle.offsets(unit, text, 0, n) == (0, len(text))
    assert {middle.transform("a\nb\n", k, unit, rate=30)[1] for k in range(50)} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        middle.restore("abc", "psm")

    class Counting:  # a pattern that tells how many matches were asked for
        asked = 0

        def finditer(self, text):
            for m in unit.finditer(text):
                Counting.asked += 1
                yield m

    assert middle.offsets(Counting(), "x\n" * 1000, 3, 5) == (6, 10) and Counting.asked == 5


def test_secret_candidates_of_every_form():
    """Values of letters only, behind headers, with blanks, short ones, and with an at sign; look-alikes are candidates that the forest refuses."""
    from rulelens.llm import secrets

    kept = {
        "Authorization: Bearer QwErTyUiOpAsDfGhJkLzXc": "QwErTyUiOpAsDfGhJkLzXc", "token: Bearer qPwOeIrUtYaLsKdJfHgZmX": "qPwOeIrUtYaLsKdJfHgZmX",
        'password="xK9 q!2 Zz"': "xK9 q!2 Zz", "pwd='q(7) v,3 Lk'": "q(7) v,3 Lk", "password=x9$k2": "x9$k2", "https://user:p@s9!K@host.internal/": "p@s9!K",
        "the secret is kLmQzXvBnWrTyPsDfGhJ, he wrote": "kLmQzXvBnWrTyPsDfGhJ",
    }
    for text, value in kept.items():
        found = [(text[a:b], s >= secrets.SECRET) for a, b, _, s in secrets.scan_text(text, secrets.standard())]
        assert found == [(value, True)], text
    for text in ("secret internationalization work", "the key characteristics-of-this", 'secret: "he said hello to us"', "password: hello", "the token was lost. The key is here", "bearer of good news"):
        assert not [f for f in secrets.scan_text(text, secrets.standard()) if f[3] >= secrets.SECRET], text
    for text, value in (("key qhwyeurtzmxncbvlaksjdhfgpq", "qhwyeurtzmxncbvlaksjdhfgpq"), ('password="a b c"', "a b c"), ("https://user:p@ss@host/", "p@ss")):
        assert [text[a:b] for a, b, _ in secrets.find(text)] == [value]
    hostile = "password=\"" * 20_000 + "token is " + "." * 200_000 + "://a:" + ":" * 200_000
    secrets.find(hostile)


def test_toxic_passages_of_repeated_words_are_whole():
    from rulelens.llm import toxicity

    model = toxicity.Model({"vile": (4.0, 9.0), "idiot": (4.0, 9.0), "kind": (-3.0, 9.0)}, curve=(1.0, -1.0))
    assert [x[:2] for x in model.segments(["idiot"] * 50)] == [(0, 49)]
    assert [x[:2] for x in model.segments(["vile", "idiot"] * 45)] == [(0, 89)]
    apart = [*["the"] * 10, *["vile", "a", "idiot", "b"] * 30, *["calm"] * 20_000, *["idiot", "vile"] * 3]
    assert [x[:2] for x in model.segments(apart)] == [(10, 128), (20_130, 20_135)]
    # the score counts a word three times in a hundred words, however often it is repeated
    assert model.segments(["idiot"] * 50)[0][2] == 12.0 == model.segments(["idiot"] * 90)[0][2]
    # a long stretch between does not take away what the passage itself scores
    assert max(x[2] for x in model.segments(["idiot"] * 50 + ["calm"] * 1000 + ["vile"])) >= 12.0
    assert model.segments([]) == [] == model.segments(["calm"] * 5) == model.segments(["kind"] * 5)

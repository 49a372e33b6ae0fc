"""The pipeline's stages and the registration of its query."""

import re

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rulelens.llm import arrowio, langid, neardup, secrets
from rulelens.llm.queries import QUERIES, vocabulary


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        assert now.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = now
        sizes.append(docs.count())
    assert sizes[1] >= 0.99 * sizes[0] and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    assert docs.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == sizes[4]


def plain_pipeline(spark, rows, benchmark):
    """(id, text) of the rows that the first four stages keep, one by one and pair by pair."""
    model = langid.fit(rows)
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    docs = [d for d, far in zip(docs, model.predict([t for _, t in docs])[2], strict=True) if not far]
    sets = [set(neardup.shingles(t, 5).tolist()) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                label[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append((d is None, d or 0, i))
    docs = [docs[min(g)[2]] for g in groups.values()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    items = [cut(t) for t in benchmark if t]
    windows = {tuple(w[a : a + 10]) for w in items if w for a in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))
    docs = [d for d in docs if not hit(cut(d[1]))]
    out = []
    for d, t in docs:
        for a, b, _, s in reversed(secrets.scan_text(t, secrets.standard())):
            t = t[:a] + "[SECRET]" + t[b:] if s >= secrets.SECRET else t
        out.append((d, t))
    return sorted(out, key=str)


def test_against_a_brute_force_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    some = docs.where("doc_id = 3").first()["text"]
    odd = [(None, None), (None, some), (3, some), (3, "another text of the same id, with words enough to be kept here"), (9001, ""), (9002, " \n"), (9003, "x"), (9004, "12 34")]
    rows = docs.unionByName(spark.createDataFrame([(d, t, None, "odd", len(t or "")) for d, t in odd], docs.schema)).withColumns({"score": F.lit(1.5), "text_hash": F.lit("x"), "items": F.lit(1)})
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert now.limit(0).transform(lambda e, s=stage: s(spark, e, sf_dir)).count() == 0, name
        now = arrowio.store(stage(spark, now, sf_dir), "stage")
        assert now.columns == rows.columns, name
    want = plain_pipeline(spark, rows, [r["text"] for r in benchmark.collect()])
    assert sorted(((r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()), key=str) == want
    assert now.where("n_chars <> length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    pieces = last(spark, now, sf_dir).collect()
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    sizes = sorted(len(plain.encode(t, add_special_tokens=False).ids) + 1 for _, t in want)
    assert sorted(p["doc_tokens"] for p in pieces if p["start"] == 0) == sizes and sum(p["length"] for p in pieces) == sum(sizes)
    assert last(spark, now.limit(0), sf_dir).count() == 0

"""The pipeline's near-duplicates against exact Jaccard similarities."""

import random

import numpy as np
import pytest

import corpus_pipeline
from rulelens.llm import neardup

SCHEMA = "doc_id long, text string, lang string"


def altered(r: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.randrange(10**9)}"
    return " ".join(out)


def plain_kept(rows: list[tuple]) -> list[int]:
    sets = [set(neardup.shingles(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a and not b or a and len(a & b) >= 0.8 * len(a | b):
                label[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)  # components, not ids, have one row each
    return sorted(low.values())


@pytest.mark.parametrize("limit", [512, 3])
def test_pairs_from_similarity_0_8_are_found(spark, sf_dir, limit, monkeypatch):
    monkeypatch.setattr(neardup, "LIMIT", limit)
    r = random.Random(3)
    rows, d = [], 0
    for _ in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(100, 500))]
        rows.append((d, " ".join(words)))
        for share in (0.005, 0.012, 0.02, 0.03, 0.05):
            d += 1
            rows.append((d, altered(r, words, max(1, int(share * len(words))))))
        d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "x"), (d + 3, "X"), (d + 3, "X"), (d + 3, "another text of the same id")]
    want = plain_kept(rows)
    docs = spark.createDataFrame([(*x, "en") for x in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(x[0] for x in kept.collect()) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_block_links_verify_and_span():
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(100)]
    sets = {0: base, 1: base[:95] + [1, 2, 3], 2: base[5:] + [7, 8], 3: [r.getrandbits(63) for _ in range(100)]}
    sets = {k: np.unique(np.array(v, np.uint64)) for k, v in sets.items()}
    fp = neardup.wide_fingerprints(list(sets.values()), neardup.WORDS)
    shared = np.tile(np.arange(neardup.BANDS), (4, 1))
    x = {"node": np.arange(4), "root": np.arange(4), "n": np.array([len(s) for s in sets.values()]), "fp": fp, "bands": shared}
    half = lambda i: {k: v[i] for k, v in x.items()}
    assert sorted(neardup.block_links(x, None, 0, 0.8, sets.get)) == [(0, 1), (0, 2)]
    assert neardup.block_links(x, None, 1, 0.8, sets.get) == []  # seen in the first bucket that they share
    assert neardup.block_links(half(slice(0, 1)), half(slice(1, 4)), 0, 0.8, sets.get) == [(0, 1), (0, 2)]
    x["root"] = np.array([0, 0, 2, 3])
    assert len(neardup.block_links(x, None, 0, 0.8, sets.get)) == 1

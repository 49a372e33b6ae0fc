"""Language identification by nearest centroids.

A text becomes a TF-IDF vector of hashed character bigrams and trigrams (letters lower-cased,
all else is one separator class), scaled to length 1. Per language several centroids come
from spherical k-means; a text takes the language of the nearest centroid by cosine. It is
rejected when even that one is further than texts of its language and of its length are: the floor
is a share of a low quantile of the similarities of the fit's rows, by powers of four of the
number of grams, as long texts share grams with everything and short ones with little.

Fitting uses at most SAMPLE_ROWS labelled rows, shared among the languages (a classifier fit
on a bounded sample; the rows are chosen by a hash of the id, all rows alike). Prediction
is one map over all rows: no shuffle, so hot sources do not matter. Texts are coded CHUNK code points
at a time, so memory depends neither on the number of rows of a batch nor on the longest text.

Null, empty and letterless texts: `und`, score 0, rejected. Very long texts count whole. Ties go to the
language first in order. Repeated rows get equal results; an empty table gives an empty result; with no
labelled row every text is `und`. Only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, texts

DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Bound of the rows that a fit collects, whatever the size of the table.
SAMPLE_ROWS = 2000
CENTROIDS = 4
#: Clusters with a smaller share of their language's rows are odd rows, not centroids.
LEAST_SHARE = 0.05
ROUNDS = 12
#: A text is rejected below SLACK times the QUANTILE of the similarities seen in the fit of its language at its length ...
QUANTILE, SLACK = 0.02, 0.4
#: ... where texts of fewer grams than this are only rejected when they share no gram with any language.
SHORT = 100
#: Code points that are coded at once.
CHUNK = 1 << 18
_SHIFT = np.uint64(64 - DIM_BITS)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_114_112)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(_letters()[codes], codes, 0)


def _buckets(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (of their last code point) and buckets of the grams of code points; place 0 and 1 begin none."""
    x = flat.astype(np.uint64)
    c, a, b = x[:-2], x[1:-1], x[2:]
    two = np.nonzero((a != 0) | (b != 0))[0]
    three = np.nonzero(a != 0)[0]
    pair = a * _STEP + b
    first = (pair[two] * _MIX) >> _SHIFT
    second = (((pair[three] + c[three] * (_STEP * _STEP)) * _MIX + _STEP) * _MIX) >> _SHIFT
    return np.concatenate([two, three]) + 2, np.concatenate([first, second]).astype(np.int64)


def _group(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = [np.zeros(2, np.int64)]
    for t in values:
        flat += [_codes(t), np.zeros(2, np.int64)]
    sizes = [len(x) for x in flat[1::2]]
    row = np.repeat(np.arange(len(values) + 1), [2, *(n + 2 for n in sizes)]) - 1
    at, bucket = _buckets(np.concatenate(flat))
    key, n = np.unique(row[at] * DIM + bucket, return_counts=True)
    return key // DIM, key % DIM, n


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.zeros(DIM, np.int64)
    last = np.zeros(2, np.int64)
    for a in range(0, len(text) + 2, CHUNK):
        codes = _codes(text[a : a + CHUNK])
        if a + CHUNK >= len(text):
            codes = np.r_[codes, np.zeros(2, np.int64)][: len(text) + 2 - a]
        codes = np.r_[last, codes]
        counts += np.bincount(_buckets(codes)[1], minlength=DIM)
        last = codes[-2:]
    bucket = np.nonzero(counts)[0]
    return np.zeros(len(bucket), np.int64), bucket, counts[bucket]


def gram_counts(values: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the grams of texts in order of row; null counts as empty."""
    out: list[tuple[np.ndarray, ...]] = []
    first, group, held = 0, [], 0

    def flush() -> None:
        if group:
            row, bucket, n = _group(group)
            out.append((row + first, bucket, n))

    for i, t in enumerate(values):
        t = (t or "").lower()
        if group and held + len(t) > CHUNK:
            flush()
            group, held = [], 0
        if len(t) > CHUNK:
            _, bucket, n = _long(t)
            out.append((np.full(len(bucket), i), bucket, n))
            continue
        if not group:
            first = i
        elif len(group) != i - first:  # a long text came between
            flush()
            first, group, held = i, [], 0
        group.append(t)
        held += len(t)
    flush()
    none = (np.zeros(0, np.int64),) * 3
    row, bucket, n = (np.concatenate(x) for x in zip(none, *out, strict=True))
    if len(row) and (row[1:] < row[:-1]).any():
        order = np.argsort(row, kind="stable")
        row, bucket, n = row[order], bucket[order], n[order]
    return row, bucket, n


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _size_class(grams: np.ndarray) -> np.ndarray:
    """0 below SHORT grams, then powers of four, up to 5."""
    return np.clip(np.floor(np.log(np.maximum(grams, 1) / SHORT) / np.log(4)) + 1, 0, 5).astype(np.int64)


class Model:
    """langs, idf (DIM), centroids (DIM x k, unit columns), owner (k), floor (langs x 6, by size class)."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.floor = langs, idf, centroids, owner, floor

    def similarities(self, rows: int, row: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x k cosines, grams per row) of sparse counts."""
        near = np.zeros((rows, self.centroids.shape[1]), np.float32)
        grams = np.bincount(row, n, rows).astype(np.int64)
        weight = np.log1p(n.astype(np.float32)) * self.idf[bucket]
        norm = np.sqrt(np.bincount(row, weight * weight, rows))
        for a in range(0, len(row), CHUNK):
            r, w = row[a : a + CHUNK], weight[a : a + CHUNK]
            starts = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0]
            near[r[starts]] += np.add.reduceat(self.centroids[bucket[a : a + CHUNK]] * w[:, None], starts, axis=0)
        return near / np.where(norm > 0, norm, 1)[:, None], grams

    def predict(self, values: list) -> tuple[list, np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        if not self.langs or not len(values):
            return ["und"] * len(values), np.zeros(len(values)), np.ones(len(values), bool)
        near, grams = self.similarities(len(values), *gram_counts(values))
        known = np.array([has_letter(t) for t in values], bool)
        best = near.argmax(1)
        cosine = np.clip(near[np.arange(len(values)), best].astype(np.float64), 0, 1)
        far = np.where(grams >= SHORT, cosine < self.floor[self.owner[best], _size_class(grams)], cosine <= 0)
        langs = [self.langs[self.owner[k]] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
        return langs, np.where(known, cosine, 0.0), ~known | far


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts: (centroids, member of each)."""
    starts = [int((x @ _unit(x.mean(0, keepdims=True))[0]).argmax())]
    near = x @ x[starts[0]]
    while len(starts) < min(k, len(x)):
        starts.append(int(near.argmin()))
        near = np.maximum(near, x @ x[starts[-1]])
    c, before = x[starts], None
    for _ in range(ROUNDS):
        member = (x @ c.T).argmax(1)
        if before is not None and (member == before).all():
            break
        before = member
        c = _unit(np.stack([x[member == i].sum(0) if (member == i).any() else c[i] for i in range(len(c))]))
    return c, (x @ c.T).argmax(1)


def _floors(near: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Least similarity by size class, from own rows; classes with few rows take the nearest shorter one's (or the next longer's)."""
    kind = _size_class(grams)
    out = np.full(6, np.nan)
    for k in range(1, 6):
        here = near[kind == k]
        if len(here) >= 10:
            out[k] = SLACK * np.quantile(here, QUANTILE)
    for k in range(2, 6):
        if np.isnan(out[k]):
            out[k] = out[k - 1]
    for k in range(4, 0, -1):
        if np.isnan(out[k]):
            # a shorter text is less like its centroid
            out[k] = out[k + 1] / 2
    return np.nan_to_num(out, nan=0.0)


def fit_vectors(langs: list[str], rows: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model of labelled rows of (buckets, counts)."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.ones(DIM, np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0, int), np.zeros((0, 6)))
    df = np.zeros(DIM)
    for bucket, _ in rows:
        df[bucket] += 1
    idf = (np.log((1 + len(langs)) / (1 + df)) + 1).astype(np.float32)
    centroids, owner, floor = [], [], []
    for i, name in enumerate(names):
        own = [r for r, lang in zip(rows, langs, strict=True) if lang == name]
        x = np.zeros((len(own), DIM), np.float32)
        for j, (bucket, n) in enumerate(own):
            x[j, bucket] = np.log1p(n.astype(np.float32)) * idf[bucket]
        x = _unit(x)
        c, member = cluster(x, CENTROIDS)
        large = np.bincount(member, minlength=len(c)) >= max(1, LEAST_SHARE * len(own))
        c = c[large]
        centroids.append(c)
        owner += [i] * len(c)
        floor.append(_floors((x @ c.T).max(1), np.array([n.sum() for _, n in own])))
    return Model(names, idf, np.ascontiguousarray(np.concatenate(centroids).T), np.array(owner), np.stack(floor))


def fit(docs: DataFrame, learn: Column | None = None, label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows of docs for which learn holds."""
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.col(label) != "und"))
    rows = (rows.where(learn) if learn is not None else rows).select("doc_id", "text", F.col(label).alias("__label"))
    sizes = {r[0]: r[1] for r in rows.groupBy("__label").count().orderBy(F.desc("count"), "__label").limit(sample_rows).collect()}
    if not sizes:
        return fit_vectors([], [])
    quota = max(1, sample_rows // len(sizes))
    cut = F.coalesce(F.create_map(*[F.lit(y) for k, n in sizes.items() for y in (k, min(1 << 30, int(quota / n * (1 << 30))))])[F.col("__label")], F.lit(0))
    # ids that repeat, or are null, still have as many places as they have texts; rows that repeat as a whole are one
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text", F.lit("langid")), F.lit(1 << 30))
    # each label has about its quota of rows; the smallest hashes keep the bound for the sum as well, before anything is collected
    single = rows.where(spot <= cut).groupBy("__label", spot.alias("spot")).agg(F.min("text").alias("text"))
    chosen = single.orderBy("spot", "__label").limit(2 * sample_rows).repartition(32, "spot")

    def run(batches):
        for batch in batches:
            row, bucket, n = gram_counts(texts(batch))
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32())) for x in (bucket, n)]
            yield pa.RecordBatch.from_arrays([column(batch, "__label"), column(batch, "spot"), *lists], ["label", "spot", "bucket", "n"])

    got = map_arrow(chosen, run, "label string, spot long, bucket array<int>, n array<int>", 64).toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["spot"]))
    return fit_vectors([r["label"] for r in got], [(np.array(r["bucket"], np.int64), np.array(r["n"], np.int64)) for r in got])


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep columns of docs, lang_pred, score and rejected (named apart from clashing columns)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, score, far = held.value.predict(texts(batch, "__text"))
            arrays = [column(batch, k) for k in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(docs.select(*[F.col(k) for k in keep], F.col("text").alias("__text")), run, f"{schema}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, _, far = held.value.predict(texts(batch))
            yield batch.filter(pa.array(~far))

    return map_arrow(docs, run, docs.schema)

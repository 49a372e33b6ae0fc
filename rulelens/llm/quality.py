"""Quality by a factorisation machine.

A text becomes a sparse vector of three kinds of features: hashed words (lower-cased, log counts, length 1), structure
(hashed shapes of tokens, and statistics such as the shares of capitals or of repeated lines, each spread
linearly over the two nearest of its quantiles), and metadata (columns of the table named by the caller;
numbers by magnitude, text by hash). Its score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

where v has FACTORS numbers per feature. The double sum is half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2, so scoring takes
time linear in the features of a text, which are linear in the text.

The fit takes at most LABEL_ROWS labelled rows (the smallest hashes of their ids; exact copies count once) and of these, in
the same order, as many as have LABEL_ENTRIES features together: a classifier fit on a bounded sample. Everything else is one map over all rows.

Null and empty texts have no words; their statistics are 0, and the model scores them like any text. A null in
metadata is a feature of its own, a missing column none. Conflicting labels of an id count as good if any is. Without labels, or with
labels of one kind, every score is the share of good labels (0 for none). Repeated rows get equal results, ties can't occur, an
empty table gives an empty result, and further columns are handed on only if they are asked for.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowio import column, forget, map_arrow, store, texts

#: Bounds of what a fit collects, whatever the size of the tables.
LABEL_ROWS = 6_000
LABEL_ENTRIES = 3_000_000
#: Hash buckets (a power of two) of words, shapes and metadata, and factors of a feature.
BUCKETS = 1 << 14
FACTORS = 8
#: Quantiles over which a statistic is spread.
KNOTS = 9
EPOCHS, BATCH, RATE, DECAY = 16, 64, 0.03, 2e-4
STATISTICS = """log_bytes log_tokens token_length capitals digits symbols beyond_ascii white_space symbol_ends letterless capital_tokens
distinct_words distinct_pairs commonest_word log_lines line_length repeated_lines long_token""".split()
#: Bytes of words in lower case, the rest blank; and of shapes: a letter (also beyond ASCII) is a or A, a digit 9, white space blank.
_WORDS = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256))
_SHAPES = bytes(97 if b > 127 else 32 if chr(b).isspace() or b < 32 else 57 if chr(b).isdigit() else 65 if chr(b).isupper() else 97 if chr(b).islower() else b for b in range(256))
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() and chr(b) > " " for b in range(256)])
_RANGES = {"capitals": (65, 91), "digits": (48, 58), "beyond_ascii": (128, 256)}


def _add(dense: np.ndarray, kind: str, counts: Counter) -> None:
    """Adds the log counts of the buckets, of length 1."""
    index = (np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) ^ zlib.crc32(kind.encode())) % BUCKETS
    sums = np.bincount(index, np.fromiter(counts.values(), np.float64, len(counts)), BUCKETS)
    used = np.flatnonzero(sums)
    logs = np.log1p(sums[used])
    dense[used] += logs / (math.sqrt(float(logs @ logs)) or 1.0)


def describe(text: str | None, meta: dict[str, object]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets and values of hashed words, shapes and metadata, statistics) of a text."""
    data = (text or "").encode()
    own = data.split()
    marks = np.frombuffer(data.translate(_SHAPES), np.uint8)
    # a shape shows the order of kinds of characters, not how many there are
    new = np.ones(len(marks), bool)
    new[1:] = marks[1:] != marks[:-1]
    shapes = Counter(marks[new].tobytes().split())
    counts = Counter(data.translate(_WORDS).split())
    dense = np.zeros(BUCKETS)
    _add(dense, "word", counts)
    _add(dense, "shape", shapes)
    np.add.at(dense, metadata_buckets(meta), 1.0)
    index = np.flatnonzero(dense)
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {name: int(by_byte[a:b].sum()) for name, (a, b) in _RANGES.items()}
    length, symbols = sum(map(len, own)), int(by_byte[_SYMBOL].sum())
    ends, letterless, capital = (sum(n for w, n in shapes.items() if test(w)) for test in (lambda w: w[-1] not in b"aA9", lambda w: not (b"a" in w or b"A" in w), lambda w: b"A" in w and b"a" not in w))
    lines = data.splitlines()
    tokens, filled = max(1, len(own)), max(1, length)
    stats = [
        math.log1p(len(data)), math.log1p(len(own)), length / tokens, share["capitals"] / filled, share["digits"] / filled, symbols / filled, share["beyond_ascii"] / filled, (len(data) - length) / max(1, len(data)),
        ends / tokens, letterless / tokens, capital / tokens, len(counts) / max(1, counts.total()), len(set(zip(own, own[1:], strict=False))) / max(1, len(own) - 1), max(counts.values(), default=0) / max(1, counts.total()),
        math.log1p(len(lines)), length / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(max(map(len, own), default=0)),
    ]
    return index, dense[index], stats


def metadata_buckets(values: dict[str, object]) -> list[int]:
    """A bucket per column and value: numbers by their magnitude, the rest as text."""
    out = []
    for name, v in values.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v:
            v = f"{'-' if v < 0 else ''}{round(2 * math.log2(1 + min(abs(v), 1e300)))}"
        out.append(zlib.crc32(f"column {name}{'' if v is None else f'={v}'}".encode()) % BUCKETS)
    return out


class Model:
    """A factorisation machine over BUCKETS hashed features and KNOTS per statistic."""

    def __init__(self, knots: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.knots, self.w0, self.w, self.v = knots, w0, w, v

    @staticmethod
    def spread(knots: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """Each statistic on the two nearest of its knots."""
        x, base = np.asarray(stats), BUCKETS + np.arange(len(knots)) * KNOTS
        k = np.clip((knots < x[:, None]).sum(1), 1, KNOTS - 1)
        low, high = knots[np.arange(len(knots)), k - 1], knots[np.arange(len(knots)), k]
        share = np.clip((x - low) / (high - low), 0.0, 1.0)
        return np.concatenate([base + k - 1, base + k]), np.concatenate([1.0 - share, share])

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        """Linear in the features: half the square of the sums less the sums of the squares."""
        rows = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * ((rows.sum(0) ** 2).sum() - (rows * rows).sum()))

    def vector(self, text: str | None, meta: dict[str, object]) -> tuple[np.ndarray, np.ndarray]:
        index, value, stats = describe(text, meta)
        places, shares = self.spread(self.knots, stats)
        return np.concatenate([index, places]), np.concatenate([value, shares])

    def score(self, text: str | None, meta: dict[str, object] | None = None) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.logit(*self.vector(text, meta or {}))))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, knots: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Adam over batches in a fixed random order; weights decay towards 0."""
    size = BUCKETS + len(knots) * KNOTS
    rng = np.random.default_rng(7)
    share = (y.sum() + 1) / (len(y) + 2)
    # column 0: the linear weights; then the factors
    weights = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, FACTORS))], 1)
    w0, first, second = math.log(share / (1 - share)), np.zeros_like(weights), np.zeros_like(weights)
    touched = np.zeros(size, bool)
    step = 0
    for epoch in range(epochs):
        rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            index, value = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            lengths = np.array([len(rows[i][0]) for i in chosen])
            cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            part = weights[index] * value[:, None]
            sums = np.add.reduceat(part, cuts, 0)
            squares = np.add.reduceat(part[:, 1:] ** 2, cuts, 0)
            z = w0 + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
            wrong = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[chosen]) / len(chosen)
            per = np.repeat(wrong, lengths) * value
            # the derivative by v_if: x_i (sum_j v_jf x_j - v_if x_i)
            grad = np.concatenate([per[:, None], per[:, None] * (np.repeat(sums[:, 1:], lengths, 0) - part[:, 1:])], 1)
            used, back = np.unique(index, return_inverse=True)
            summed = np.stack([np.bincount(back, g, len(used)) for g in grad.T], 1) + DECAY * weights[used]
            touched[used] = True
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * summed
            second[used] = 0.999 * second[used] + 0.001 * summed**2
            weights[used] -= rate * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
            w0 -= rate * float(wrong.sum())
    # what the sample doesn't show says nothing
    weights[~touched] = 0.0
    return Model(knots, w0, weights[:, 0].copy(), weights[:, 1:].copy())


def _prepared(docs: DataFrame, metadata: list[str]) -> tuple[list[Column], list[str]]:
    """The columns that a map reads: the text, and metadata as numbers or text."""
    names = [c for c in metadata if c in docs.columns]
    kinds = [T.DoubleType() if isinstance(docs.schema[c].dataType, T.NumericType) else T.StringType() for c in names]
    return [F.col("text").alias("__text"), *[F.col(f"`{c}`").cast(k).alias(f"__m{i}") for i, (c, k) in enumerate(zip(names, kinds, strict=True))]], names


def _metas(batch: pa.RecordBatch, names: list[str]) -> list[dict[str, object]]:
    columns = [texts(batch, f"__m{i}") for i in range(len(names))]
    return [dict(zip(names, row, strict=True)) for row in zip(*columns, strict=True)] if names else [{}] * batch.num_rows


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, metadata: list[str] | None = None, label_rows: int = LABEL_ROWS, label_entries: int = LABEL_ENTRIES) -> Model:
    """A model of the labelled rows for which learn (over doc_id) holds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = (rows.where(learn) if learn is not None else rows).groupBy("doc_id").agg(F.max("quality").alias("__good"))
    spot = F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality"))
    # the smallest hashes, ties by id: the same rows whatever the partitioning
    chosen = rows.withColumn("__spot", spot).orderBy("__spot", "doc_id").limit(label_rows)
    read, names = _prepared(docs, metadata or [])
    # at most label_rows ids and numbers
    train_rows = docs.select("doc_id", *read).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            found = [describe(t, m) for t, m in zip(texts(batch, "__text"), _metas(batch, names), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "__spot"), column(batch, "__good"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32())), pa.array([f[2] for f in found], pa.list_(pa.float64())),
                 pa.array([len(f[0]) + 2 * len(STATISTICS) for f in found], pa.int64()), pa.array([zlib.crc32((t or "").encode()) for t in texts(batch, "__text")], pa.int64())],
                ["spot", "good", "index", "value", "stats", "entries", "hash"],
            )

    reading = train_rows.select(*[f"__m{i}" for i in range(len(names))], "__text", "__spot", F.col("__good").cast("int").alias("__good"))
    sample = store(map_arrow(reading, run, "spot long, good int, index array<int>, value array<float>, stats array<double>, entries long, hash long"), "labelled", "zstd")
    # exact copies would count again and again; documents that repeat an id can exceed the bound, so it is kept here as well
    single = sample.dropDuplicates(["hash", "good", "entries"])
    order = ["spot", "entries", "hash", "good"]
    entries = [r[0] for r in single.orderBy(*order).select("entries").limit(label_rows).collect()]
    fitting = int(np.searchsorted(np.cumsum(entries), label_entries, "right")) if entries else 0
    got = single.orderBy(*order).limit(fitting).collect() if fitting else []
    forget(sample)
    y = np.array([r["good"] > 0 for r in got], float)
    knots = np.zeros((len(STATISTICS), KNOTS)) + np.arange(KNOTS)
    size = BUCKETS + len(STATISTICS) * KNOTS
    if not len(y) or y.all() or not y.any():
        return Model(knots, 40.0 if len(y) and y.all() else -40.0, np.zeros(size), np.zeros((size, FACTORS)))
    stats = np.array([r["stats"] for r in got])
    for i in range(len(STATISTICS)):
        low, high = stats[:, i].min(), stats[:, i].max()
        # quantiles and evenly placed edges by turns, so rare extremes have knots of their own
        edges = np.unique(np.concatenate([np.quantile(stats[:, i], np.linspace(0, 1, (KNOTS + 1) // 2)), np.linspace(low, high, KNOTS // 2 + 2)[1:-1]]))
        knots[i] = np.concatenate([edges, edges[-1] + 1 + np.arange(KNOTS - len(edges))])
    vectors = []
    for r, (places, shares) in zip(got, (Model.spread(knots, s) for s in stats), strict=True):
        vectors.append((np.concatenate([np.array(r["index"], np.int64), places]), np.concatenate([np.array(r["value"], float), shares])))
    return train(vectors, y, knots)


def score(docs: DataFrame, model: Model, keep: list[str], metadata: list[str] | None = None) -> DataFrame:
    """keep columns, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    read, names = _prepared(docs, metadata or [])

    def run(batches):
        for batch in batches:
            scores = [held.value.score(t, m) for t, m in zip(texts(batch, "__text"), _metas(batch, names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(scores, pa.float64()), pa.array([int(v >= 0.5) for v in scores], pa.int32())], [*keep, "score", "predicted"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(docs.select(*[F.col(f"`{k}`") for k in keep], *read), run, f"{schema}, score double, predicted int")

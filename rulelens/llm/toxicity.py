"""Toxic passages as maximum-scoring segments.

Token weights are log-odds ratios of toxic against other labelled texts under an informative
Dirichlet prior (the corpus' own token shares). They are learned for words and for their first
letters (compounds and inflections share a stem); a word takes the weight of the surest of
its units, and one whose ratio is within its noise is background, which costs DRIFT. A linear scan over a text finds every maximal scoring
segment (Ruzzo and Tompa), touching only the tokens that carry a weight. A segment's score, the best within it if a word that
is repeated nearby counts BURST times at most, is turned into an E-value by the extreme-value law fitted to the non-toxic texts of the fit, and
a text's segments are aggregated by the Poisson rule into one tail probability, which a
logistic curve fitted on the same rows maps to a score.

Fitting uses at most LABEL_ROWS labelled rows (a classifier fit on a bounded sample, chosen by a
hash of the id) and keeps at most MODEL_TOKENS tokens. Scoring is one map over all rows.

Null and empty texts have no token: their score is what the calibration gives to no evidence.
Ties among segments keep the earlier one. Repeated rows get equal results; conflicting labels of
an id count as toxic if any is; an empty table gives an empty result; without labels every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowio import column, forget, map_arrow, store, texts

#: Bounds of what a fit collects, whatever the size of the tables.
LABEL_ROWS = 10_000
MODEL_TOKENS = 20_000
#: Weight of the prior in tokens, its floor for a unit (Jeffreys), and the ratio in standard deviations from which a token has a weight.
PRIOR = 500.0
EACH = 0.5
LEAST_Z = 3.5
#: A weaker ratio is background too: such tokens tell topics and languages apart.
LEAST_WEIGHT = 1.5
LEAST_COUNT = 3
#: Lengths of the stems, and how often a text counts a unit at most (else a text that repeats one word sets its weight).
STEMS = (4, 5, 6, 7)
BURST = 3
#: The score of a segment counts a word at most BURST times within this many words; its extent counts all.
NEARBY = 100
#: What a background token costs, and the largest weight of a token.
DRIFT = 0.05
MOST = 8.0
#: Segments with a smaller E-value are significant passages.
SIGNIFICANT = 0.05
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    """The word and its stems; a stem ends with a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


class _Weights(dict):
    """Weight of each word met, None for background; forgets all when it has grown large."""

    def __init__(self, known: dict[str, tuple[float, float]]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float | None:
        found = [x for u in units(word) if (x := self.known.get(u)) is not None]
        if len(self) > 300_000:
            self.clear()
        self[word] = max(found, key=lambda x: abs(x[1]))[0] if found else None
        return self[word]


def maximal_segments(positions: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of every maximal scoring segment.

    positions and weights: the tokens that carry a weight, in order; all other tokens cost drift.
    A segment begins and ends with a positive weight. Amortised linear in the number of weights.
    """
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    # earlier[j]: the nearest segment before j whose left sum is below j's
    earlier: list[int] = []
    total, before = 0.0, -1
    for p, w in zip(positions, weights, strict=True):
        total -= drift * (p - before - 1)
        before = p
        start = total
        total += w
        if w <= 0:
            continue
        a, b, l, r = p, p, start, total
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= l:
                j = earlier[j]
            if j < 0 or right[j] >= r:
                break
            # the new segment extends j
            l, a = left[j], span[j][0]
            k = earlier[j]
            del left[j:], right[j:], span[j:], earlier[j:]
            j = k
        earlier.append(j)
        left.append(l)
        right.append(r)
        span.append((a, b))
    return [(a, b, r - l) for (a, b), l, r in zip(span, left, right, strict=True)]


class Model:
    """(weight, z) by unit; the law P(max >= s) = 1 - exp(-k n exp(-rate s)); the logistic curve's terms."""

    def __init__(self, weights: dict[str, tuple[float, float]], k: float = 0.1, rate: float = 1.0, curve: tuple[float, float] | None = None):
        self.weights, self.k, self.rate, self.curve = weights, k, rate, curve
        self._met = _Weights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.k, self.rate, self.curve)

    def segments(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        hits = [(i, w) for i, w in enumerate(map(self._met.__getitem__, tokens)) if w is not None]
        if not hits:
            return []
        found = maximal_segments([i for i, _ in hits], [w for _, w in hits])
        # the score is the best within the segment when a word that is repeated more often nearby is background
        counted: list[tuple[int, int, float]] = []
        at = 0
        for a, b, _ in found:
            while hits[at][0] < a:
                at += 1
            met: dict[str, deque[int]] = {}
            here = best = 0.0
            before = a - 1
            while at < len(hits) and hits[at][0] <= b:
                i, w = hits[at]
                last = met.setdefault(tokens[i], deque(maxlen=BURST))
                here -= DRIFT * (i - before - 1)
                before = i
                if len(last) < BURST or i - last[0] >= NEARBY:
                    last.append(i)
                    here += w
                else:
                    here -= DRIFT
                here = max(0.0, here)
                best = max(best, here)
                at += 1
            counted.append((a, b, best))
        return counted

    def evidence(self, tokens: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """-log10 of the text's tail probability, and its segments with their E-values."""
        n = max(len(tokens), 1)
        found = [(a, b, s, self.k * n * math.exp(-min(700.0, self.rate * s))) for a, b, s in self.segments(tokens)]
        best = 0.0
        for r, e in enumerate(sorted(x[3] for x in found)):
            # r + 1 segments with E-values up to e: a Poisson tail, at most 1
            log = (r + 1) * math.log(max(e, 1e-300)) - math.lgamma(r + 2)
            best = max(best, -log / math.log(10))
        return best, found

    def score(self, tokens: list[str]) -> tuple[float, list[tuple[int, int, float, float]]]:
        x, found = self.evidence(tokens)
        if self.curve is None:
            return 0.0, found
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * x + b)))), found


def gumbel(scores: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """(k, rate) of best segment scores of texts of these sizes, by moments of s - log(n) / rate."""
    keep = scores > 0
    if keep.sum() < 10:
        return 0.1, 1.0
    s, logs, rate = scores[keep], np.log(np.maximum(sizes[keep], 1)), 1.0
    for _ in range(20):
        rate = min(3.0, max(0.05, math.pi / math.sqrt(6 * max(float(np.var(s - logs / rate)), 1e-6))))
    mode = float(np.mean(s - logs / rate)) - 0.5772156649 / rate
    # texts without any segment make the law thinner
    return math.exp(min(50.0, rate * mode)) * float(keep.mean()), rate


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept by Newton steps."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([0.0, math.log((y.sum() + 1) / ((1 - y).sum() + 1))])
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (t - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def token_weights(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """Log-odds of tokens of rows (text, __toxic) under a Dirichlet prior."""

    def run(batches):
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(texts(batch), column(batch, "__toxic").to_pylist(), strict=True):
                to = counts[1 if y else 0]
                seen_here: Counter = Counter()
                for w, n in Counter(words(t)).items():
                    for u in units(w):
                        seen_here[u] += n
                for u, n in seen_here.items():
                    to[u] += min(n, BURST)
        seen = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([counts[1][w] for w in seen], pa.int64()), pa.array([counts[0][w] for w in seen], pa.int64())], ["token", "bad", "good"])

    totals = map_arrow(rows.select("text", "__toxic"), run, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = F.col("bad") + F.col("good")
    whole = totals.agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
    prior = F.lit(PRIOR) * both / (F.col("all_bad") + F.col("all_good")) + F.lit(EACH)
    odds = lambda n, of: F.log((F.col(n) + prior) / (F.col(of) + F.lit(PRIOR) - F.col(n) - prior))
    ratio = odds("bad", "all_bad") - odds("good", "all_good")
    noise = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    got = totals.join(F.broadcast(whole)).where(both >= LEAST_COUNT).select("token", ratio.alias("ratio"), (ratio / noise).alias("z")).where((F.abs("z") >= LEAST_Z) & (F.abs("ratio") >= LEAST_WEIGHT))
    return {r[0]: (max(-MOST, min(MOST, r[1])), r[2]) for r in got.orderBy(F.desc(F.abs("z")), "token").limit(MODEL_TOKENS).collect()}


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label_rows: int = LABEL_ROWS) -> Model:
    """A model of the labelled rows for which learn (over doc_id) holds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    rows = (rows.where(learn) if learn is not None else rows).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    size = rows.count()
    if not size:
        return Model({})
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    # the smallest hashes, ties by id: the same rows whatever the partitioning
    chosen = rows.withColumn("__spot", spot).orderBy("__spot", "doc_id").limit(label_rows).drop("__spot")
    # at most label_rows pairs of numbers
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # exact copies would count their words again and again
    train = store(train.groupBy(F.xxhash64("text").alias("__hash"), "__toxic").agg(F.first("text").alias("text")), "labelled", "zstd")
    weights = token_weights(train)
    first = Model(weights)

    def run(batches):
        for batch in batches:
            out = []
            for t, y in zip(texts(batch), column(batch, "__toxic").to_pylist(), strict=True):
                w = words(t)
                s = sorted((x[2] for x in first.segments(w)), reverse=True)
                out.append((int(bool(y)), len(w), s))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.float64()))], ["y", "n", "s"])

    got = sorted(map(tuple, map_arrow(train, run, "y int, n long, s array<double>").collect()))
    forget(train)
    y = np.array([r[0] for r in got], float)
    n = np.array([r[1] for r in got], float)
    if not y.sum() or y.all():
        return Model(weights)
    clean = y == 0
    top = np.array([max(r[2], default=0.0) for r in got])
    k, rate = gumbel(top[clean], n[clean])
    model = Model(weights, k, rate)
    x = np.zeros(len(got))
    for i, (_, size_, s) in enumerate(got):
        best = 0.0
        for r, v in enumerate(s):
            e = k * max(size_, 1) * math.exp(-min(700.0, rate * v))
            best = max(best, -((r + 1) * math.log(max(e, 1e-300)) - math.lgamma(r + 2)) / math.log(10))
        x[i] = best
    model.curve = logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep columns, score, predicted, and the significant passages (first and last word, score, E-value)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])

    def run(batches):
        for batch in batches:
            scores, passages = [], []
            for t in texts(batch, "__text"):
                v, found = held.value.score(words(t))
                scores.append(v)
                passages.append([{"first": a, "last": b, "score": s, "e_value": e} for a, b, s, e in found if e <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(scores, pa.float64()), pa.array([int(v >= 0.5) for v in scores], pa.int32()), pa.array(passages, pa.list_(passage))], [*keep, "score", "predicted", "passages"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(docs.select(*[F.col(k) for k in keep], F.col("text").alias("__text")), run, f"{schema}, score double, predicted int, passages array<struct<first:long,last:long,score:double,e_value:double>>")

"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (and its end id) are cut into pieces of the sequence length and a rest.
Rests are a cutting-stock problem over the histogram of their lengths, which has fewer rows than the
sequence length whatever the corpus: the driver solves the linear program over patterns by
column generation (dual prices from the basis, a knapsack dynamic program prices new
patterns), rounds pattern counts, and packs the few left over best-fit decreasing. Pieces are ranked
within their length, and the rank decides pattern, sequence and offset.

The histogram is counted before it is sent. A piece of the whole sequence length is a sequence of its own,
named by the task that wrote it and its place there; only rests are ranked, in as many parts per length as
hold PART_ROWS of them, so a length that a third of all documents have is not one task's burden.
Pieces are written to the shared folder once, so nothing is encoded twice.

Null and empty texts have the end id alone. Very long texts are cut like others and encoded in bounded
parts. Ties in rank differ only among equal rows. Repeated rows are packed as often as they occur; an empty
table gives an empty result; only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, store, texts
from .tokens import encoder

LENGTH = 1024
END = 0
#: Rests of one length that are ranked in one part, about.
PART_ROWS = 1_000_000
#: Column generation ends when no pattern's price exceeds its cost by more than this share, when the bound is within half a
#: sequence or, rounded up, reached, or after so many columns; a gap that then remains is logged.
GAP = 1e-4
COLUMNS = 1000
_LOG = logging.getLogger(__name__)


def piece_table(docs: DataFrame, vocabulary: str, spaced: bool, length: int = LENGTH, end: int = END, key: str = "doc_id") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, place) of the pieces of every row; place: task and number there."""

    def run(batches):
        enc = encoder(vocabulary, spaced)
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            who, start, size, crc, total = [], [], [], [], []
            for i, found in enumerate(enc.batch(texts(batch))):
                ids = np.append(found.astype("<u4"), np.uint32(end)).astype("<u4")
                for a in range(0, len(ids), length):
                    part = ids[a : a + length]
                    who.append(i)
                    start.append(a)
                    size.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
            longs = [pa.array(x, pa.int64()) for x in (start, size, crc, total, range(place, place + len(who)))]
            place += len(who)
            yield pa.RecordBatch.from_arrays([column(batch, key).take(pa.array(who, pa.int64())), *longs], [key, "start", "length", "ids_crc32", "doc_tokens", "place"])

    return map_arrow(docs.select(key, "text"), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, place long")


def _first_fit_patterns(sizes: list[int], need: np.ndarray, length: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns and amounts that use up need exactly, one size per pattern (a feasible triangular basis)."""
    left = need.astype(float).copy()
    open_ = [i for i in range(len(sizes))]  # large to small
    patterns, amounts = [], []
    while open_:
        room, pattern = length, {}
        for i in open_:
            n = min(room // sizes[i], max(1, int(left[i])))
            if n:
                pattern[i] = n
                room -= n * sizes[i]
            if room < sizes[open_[-1]]:
                break
        i = min(pattern, key=lambda k: left[k] / pattern[k])
        x = left[i] / pattern[i]
        for k, n in pattern.items():
            left[k] = max(0.0, left[k] - n * x)
        left[i] = 0.0
        open_.remove(i)
        patterns.append(pattern)
        amounts.append(x)
    return patterns, np.array(amounts)


def best_pattern(sizes: np.ndarray, prices: np.ndarray, length: int) -> tuple[float, dict[int, int]]:
    """Knapsack dynamic program: the pattern of the largest price."""
    value = np.zeros(length + 1)
    choice = np.full(length + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, p = sizes[order], prices[order]
    for c in range(1, length + 1):
        n = int(np.searchsorted(s, c, "right"))
        value[c] = value[c - 1]
        if n:
            got = value[c - s[:n]] + p[:n]
            k = int(got.argmax())
            if got[k] > value[c] + 1e-12:
                value[c], choice[c] = got[k], k
    pattern: Counter = Counter()
    c = length
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[int(order[choice[c]])] += 1
            c -= int(s[choice[c]])
    return float(value[length]), dict(pattern)


def linear_program(sizes: list[int], need: np.ndarray, length: int = LENGTH) -> tuple[list[dict[int, int]], np.ndarray, float]:
    """Basis patterns and amounts of the relaxed cutting-stock problem, by column generation, and what no plan can be below."""
    m = len(sizes)
    basis, x = _first_fit_patterns(sizes, need, length)
    size = np.array(sizes)
    column_of = lambda p: np.bincount(list(p), list(p.values()), m)
    matrix = np.stack([column_of(p) for p in basis], 1)
    inverse = np.linalg.inv(matrix)
    least = float((size * need).sum()) / length
    for step in range(COLUMNS):
        # no plan can have fewer sequences than the bound rounded up
        if x.sum() <= max(least * (1 + GAP), least + 0.5) or np.ceil(x.sum() - 1e-6) <= np.ceil(least - 1e-6):
            break
        value, pattern = best_pattern(size, np.maximum(inverse.sum(0), 0), length)
        least = max(least, x.sum() / max(value, 1.0))  # no plan needs less than the amounts over the best price
        if value <= 1 + GAP or x.sum() <= least + 0.5:
            break
        column_ = column_of(pattern)
        d = inverse @ column_
        up = d > 1e-6
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, d, 1), np.inf)
        # among equal ratios the largest pivot keeps the basis far from singular
        k = int(np.where(ratio <= ratio.min() + 1e-9, d, -np.inf).argmax())
        t = max(0.0, ratio[k])
        x = np.maximum(x - t * d, 0)
        x[k] = t
        basis[k] = pattern
        matrix[:, k] = column_
        if step % 100 == 99:
            try:
                inverse = np.linalg.inv(matrix)
            except np.linalg.LinAlgError:
                break  # x still is a feasible plan
            x = np.maximum(inverse @ need, 0)
        else:
            row = inverse[k] / d[k]
            inverse -= np.outer(d, row)
            inverse[k] = row
    _LOG.info("%d lengths, %d columns: %.2f sequences, bound %.2f", m, step, x.sum(), least)
    return basis, x, least


def best_fit(left: Counter, length: int = LENGTH) -> list[tuple[int, ...]]:
    """Bins of what is left, best-fit decreasing."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for s in sorted(left, reverse=True):
        for _ in range(left[s]):
            i = bisect_left(rooms, (s, -1))
            if i == len(rooms):
                bins.append([s])
                k, room = len(bins) - 1, length
            else:
                room, k = rooms.pop(i)
                bins[k].append(s)
            if room - s:
                insort(rooms, (room - s, k))
    return [tuple(b) for b in bins]


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(sequences, pieces of each length in one sequence) that hold the histogram exactly."""
    return bounded_plan(histogram, length)[0]


def bounded_plan(histogram: dict[int, int], length: int = LENGTH) -> tuple[list[tuple[int, dict[int, int]]], int]:
    """The plan, and the number of sequences that no plan can be below."""
    left = Counter({s: n for s, n in histogram.items() if n > 0})
    out: Counter = Counter()
    bound = left.pop(length, 0)
    if bound:
        out[((length, 1),)] = bound
    if left:
        sizes = sorted(left, reverse=True)
        basis, x, least = linear_program(sizes, np.array([left[s] for s in sizes], float), length)

        bound += math.ceil(least - 1e-6)

        def take(pattern: dict[int, int], most: int) -> int:
            n = min([most, *(left[sizes[i]] // a for i, a in pattern.items())])
            if n > 0:
                for i, a in pattern.items():
                    left[sizes[i]] -= n * a
                out[tuple(sorted(((sizes[i], a) for i, a in pattern.items()), reverse=True))] += n
            return n

        for p, v in zip(basis, x, strict=True):
            take(p, int(v + 1e-9))
        for k in sorted(range(len(x)), key=lambda i: (-(x[i] % 1), i)):
            if x[k] % 1 > 1e-6:
                take(basis[k], 1)
        for b in best_fit(Counter({s: n for s, n in left.items() if n}), length):
            out[tuple(sorted(Counter(b).items(), reverse=True))] += 1
    return [(n, dict(p)) for p, n in sorted(out.items(), key=lambda x: (-x[1], x[0]))], bound


def slots(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Sorted by (length, first rank): length, first rank, first sequence, copies in a sequence, offset of the first copy."""
    rows, used, sequence = [], Counter(), 0
    for n, pattern in patterns:
        offset = 0
        for s, a in pattern.items():
            rows.append((s, used[s], sequence, a, offset))
            used[s] += n * a
            offset += s * a
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, spaced: bool = True, length: int = LENGTH, end: int = END, key: str = "doc_id") -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; n_sequences in all, and least_sequences, which no packing of these pieces is below."""
    if length >= 1 << 20:
        raise ValueError("sequences of 2^20 ids and more are not planned on one machine")
    pieces = store(piece_table(docs, vocabulary, spaced, length, end, key), "pieces")
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    full = sizes.pop(length, 0)
    rests = pieces.where(F.col("length") < length)
    # parts of each length, by its count: at most length numbers
    parts = {s: -(-n // PART_ROWS) for s, n in sizes.items()}
    number = F.create_map(*[F.lit(x) for s, n in parts.items() for x in (s, n)])[F.col("length")] if parts else F.lit(1)
    rests = rests.withColumn("salt", F.pmod(F.xxhash64(F.col(key).cast("string"), "start"), number).cast("long"))
    before: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    for s, k, n in sorted(map(tuple, rests.groupBy("length", "salt").count().collect())):
        before[s, k] = seen[s]
        seen[s] += n
    patterns, bound = bounded_plan(sizes, length)
    table = slots(patterns)
    rests_sequences = sum(n for n, _ in patterns)
    firsts = np.array([[(s << 40) + k, n] for (s, k), n in sorted(before.items())], np.int64).reshape(-1, 2)
    held = docs.sparkSession.sparkContext.broadcast((table, firsts))
    order = Window.partitionBy("length", "salt").orderBy(F.col(key).asc_nulls_first(), "start", "doc_tokens", "ids_crc32")
    ranked = rests.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    names = [key, "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        table, firsts = held.value
        at = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            size = column(batch, "length").to_numpy()
            rank = column(batch, "rank").to_numpy() + firsts[np.searchsorted(firsts[:, 0], (size << 40) + column(batch, "salt").to_numpy()), 1]
            row = table[np.searchsorted(at, (size << 44) + rank, "right") - 1]
            inside = rank - row[:, 1]
            sequence = row[:, 2] + inside // row[:, 3]
            offset = row[:, 4] + inside % row[:, 3] * size
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    planned = map_arrow(ranked, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", 16_384)
    told = {"n_sequences": F.lit(rests_sequences + full).cast("long"), "least_sequences": F.lit(bound + full).cast("long")}
    if not full:
        return planned.withColumns(told)
    # sequences of one piece come after the planned ones
    alone = pieces.where(F.col("length") == length).select(*names, (F.col("place") + rests_sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(planned).withColumns(told)

"""Periodic runs of words: maximal stretches that repeat with a period.

A run is a stretch of words with smallest period q, of at least max(12, 2 q) words, that can't be extended.
Words become integers. If words q apart are equal over m = length - q words, then m is at least
max(q, 12 - q), and every stretch of m >= 2 b - 1 words holds a block of b words that begins at a multiple of b.
So each period belongs to one scale, the largest power of two b with 2 b - 1 <= max(q, 12 - q). At each
scale the aligned blocks go into an Aho-Corasick automaton whose keys are integer sequences, it is
searched over the words that follow them, and an occurrence at a distance of the scale's periods
seeds an exact extension to both sides, word by word.

What keeps this near linear: a block is searched for only if all its grams (up to four words, compared
exactly) recur within the scale's distances; a block well inside a run of a period that fits into it twice can only
find that run again; one near the end of such a run is searched for by its first two periods, and recurs
where these are in another known run of that period; and a distance is extended once per stretch. Blocks go
through the automaton in parts, so its size is bounded by a part or a single block.

Null and empty texts have no words and no runs. Repeated rows get equal results, texts of any length are searched as a whole, ties
follow start, then period, an empty table gives an empty result, and of further columns only those asked for are handed on.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, texts

LEAST = 12
#: Words of a part of the blocks that share an automaton (more only if one block is longer).
PART = 1 << 16
_STEP = 64


def words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space (space, tab, line feed, vertical tab, form feed, return)."""
    return text.encode().split() if text else []


def scale_of(period: int, least: int = LEAST) -> int:
    """The largest power of two b with 2 b - 1 <= the words that must be equal at that distance."""
    return 1 << ((max(period, least - period) + 1) // 2).bit_length() - 1


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value among the distinct ones, distance to its next occurrence; 0 if there is none)."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    ahead = np.zeros(len(values), np.int64)
    again = ~new[1:]
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return number, ahead


def _equal_ahead(w: np.ndarray, i: int, d: int) -> int:
    """The first j >= i with w[j] != w[j + d], or where j + d leaves the words."""
    last, step = len(w) - d, _STEP
    while i < last:
        j = min(last, i + step)
        wrong = w[i:j] != w[i + d : j + d]
        at = int(wrong.argmax())
        if wrong[at]:
            return i + at
        i, step = j, step * 2
    return last


def _equal_behind(w: np.ndarray, i: int, d: int) -> int:
    """The least j <= i such that w[k] == w[k + d] for all k of j..i-1."""
    step = _STEP
    while i > 0:
        j = max(0, i - step)
        wrong = (w[j:i] != w[j + d : i + d])[::-1]
        at = int(wrong.argmax())
        if wrong[at]:
            return i - at
        i, step = j, step * 2
    return 0


def _occurrences(w: np.ndarray, keys: dict[int, int], reach: int) -> dict[int, list[int]]:
    """keys: words of the key at each start. Of each the occurrences up to `reach` words on, found by one automaton over what follows the starts."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    own: dict[int, tuple] = {}
    for x, size in keys.items():
        own[x] = key = tuple(w[x : x + size].tolist())
        if key not in automaton:
            automaton.add_word(key, (len(automaton), size))
    number = {x: automaton.get(key)[0] for x, key in own.items()}
    del own
    automaton.make_automaton()
    places: dict[int, list[int]] = {}
    starts, k = list(keys), 0
    while k < len(starts):
        low = starts[k]
        high = low + reach + keys[low]
        while k < len(starts) and starts[k] < high:
            high = starts[k] + reach + keys[starts[k]]
            k += 1
        for end, (key, size) in automaton.iter(tuple(w[low : min(high, len(w))].tolist())):
            places.setdefault(key, []).append(low + end - size + 1)
    return {x: places.get(key, []) for x, key in number.items()}


def _scales(n: int, least: int) -> dict[int, tuple[int, int]]:
    """The shortest and the longest period of each scale that n words have room for."""
    out: dict[int, tuple[int, int]] = {}
    for p in range(1, min(least, n // 2) + 1):
        low, high = out.get(b := scale_of(p, least), (p, p))
        out[b] = min(low, p), max(high, p)
    b = scale_of(n // 2, least)
    while b >= 1:  # periods from `least` on fill whole scales
        if (top := min(4 * b - 2, n // 2)) >= (low := max(2 * b - 1, least)):
            before = out.get(b, (low, top))
            out[b] = min(low, before[0]), max(top, before[1])
        b //= 2
    return dict(sorted(out.items()))


def periodic_runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of these integers, by start, then period."""
    n = len(w)
    if n < least:
        return []
    w, _ = _dense(w)
    pair, pair_ahead = _dense(w[:-1] * n + w[1:])
    if not pair_ahead.any():
        return []
    quad_ahead = _dense(pair[:-2] * n + pair[2:])[1]
    found: dict[tuple[int, int], int] = {}
    # of known runs of short periods the one that reaches furthest from a word: its end, and its period
    far, far_period = np.zeros(n, np.int64), np.ones(n, np.int64)
    entered: set[tuple[int, int]] = set()
    for b, (shortest, reach) in _scales(n, least).items():
        # runs whose period fits into a block twice: such blocks have many occurrences, one each period
        short = [(s, e, q) for (s, e), q in found.items() if q <= b // 2 and (s, e) not in entered]
        for s, e, q in short:
            entered.add((s, e))
            more = far[s:e] < e
            far[s:e][more], far_period[s:e][more] = e, q
        gram, ahead = (4, quad_ahead) if b >= 4 else (2, pair_ahead) if b >= 2 else (1, None)
        starts = np.arange(0, n - b - shortest + 1, b)
        if ahead is not None:
            # blocks whose every gram comes again soon
            lost = np.concatenate([[0], np.cumsum((ahead == 0) | (ahead > reach))])
            starts = starts[lost[starts + b - gram + 1] == lost[starts]]
        # well inside a run of a short period there is nothing but that run
        starts = starts[far[starts] < starts + reach + b]
        if not len(starts):
            continue
        inside = (far[starts] >= starts + b) & (b >= least)
        by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if inside.any():
            for s, e, q in sorted((s, e, q) for (s, e), q in found.items() if q <= b // 2):
                by_period.setdefault(q, ([], []))[0].append(s)
                by_period[q][1].append(e)
            by_period = {q: (np.array(s), np.array(e)) for q, (s, e) in by_period.items()}
        sizes = np.where(inside, 2 * far_period[starts], b)
        done: dict[int, int] = {}

        def extend(d: int, low: int, high: int) -> None:
            """Words low..high-1 are equal to those d on: find the whole stretch."""
            s, e = _equal_behind(w, low, d), _equal_ahead(w, high, d)
            done[d] = e
            if e + d - s >= max(least, 2 * d) and found.get((s, e + d), d + 1) > d:
                found[s, e + d] = d

        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            occurrences = _occurrences(w, dict(zip(starts[a:z].tolist(), sizes[a:z].tolist(), strict=True)), reach)
            for x, own, end, q in zip(starts[a:z].tolist(), inside[a:z].tolist(), far[starts[a:z]].tolist(), far_period[starts[a:z]].tolist(), strict=True):
                places = occurrences[x]
                # occurrences within x's own run of a short period belong to multiples of that
                k, stop = bisect_left(places, max(x + shortest, end - b + 1)), bisect_right(places, x + reach)
                if k == stop:
                    continue
                if not own:
                    for y in places[k:stop]:
                        if scale_of(y - x, least) == b and x >= done.get(y - x, 0):
                            extend(y - x, x, x + b)
                    continue
                # the block recurs where another run of its period holds its first two periods and is long enough; both runs
                # are equal as far as both reach, and only where they end together can the stretch go on
                y = np.array(places[k:stop])
                at = np.searchsorted(by_period[q][0], y, "right") - 1
                s2, e2 = by_period[q][0][at], by_period[q][1][at]
                d = y - x
                ok = (at >= 0) & (y >= s2) & (y + b <= e2)
                mine = np.searchsorted(by_period[q][1], end)
                s1 = by_period[q][0][mine]
                low, high = np.maximum(s1, s2 - d), np.minimum(end, e2 - d)
                ok &= (high - low >= d) | (s1 == s2 - d) | (end == e2 - d)
                for dd, lo, hi in zip(d[ok].tolist(), low[ok].tolist(), high[ok].tolist(), strict=True):
                    if x >= done.get(dd, 0):
                        extend(dd, lo, hi)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(doc_id: str | None, own: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, for one id of ten by its hash."""
    h, n = zlib.crc32((doc_id or "").encode()), len(own)
    if h % 10 or not n:
        return own
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeats = -(-(n - a) // p)
    return own[:a] + (own[a : a + p] * repeats)[: n - a]


def detect(docs: DataFrame, keep: list[str], prepare: Callable[[str | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST) -> DataFrame:
    """keep columns, runs (start, length, period), and the text without the repeats: kept words, joined by one space. One map, no shuffle.

    prepare: changes the words of a document, given its id as text, before they are searched.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            all_runs, kept_texts = [], []
            for i, t in zip(texts(batch, "__id"), texts(batch, "__text"), strict=True):
                own = words(t)
                if prepare:
                    own = prepare(i, own)
                number: dict[bytes, int] = {}
                w = np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own))
                runs = periodic_runs(w, least)
                if runs:
                    own = [x for x, stays in zip(own, collapsed(len(own), runs).tolist(), strict=True) if stays]
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept_texts.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(all_runs, pa.list_(run_type)), pa.array(kept_texts, pa.string())], [*keep, "runs", "collapsed"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    rows = docs.select(*[F.col(f"`{k}`") for k in keep], F.col("doc_id").cast("string").alias("__id"), F.col("text").alias("__text"))
    return map_arrow(rows, run, f"{schema}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest(found: DataFrame) -> DataFrame:
    """Results of `detect` as digests: doc_id, n_runs, the longest run, and hashes of all runs and of the collapsed text."""
    first = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    one = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("__first"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length = -F.col("__first.l")
    return one.select(
        "doc_id", "n_runs", F.col("__first.s").alias("start"), length.alias("length"), F.col("__first.p").alias("period"),
        F.floor(F.lit(1000) * length / F.col("__first.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

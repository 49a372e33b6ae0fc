"""Exact removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.
All strings are compared by prefix polynomial hashes. Sorting every suffix of the corpus is not
needed to find those that share LENGTH bytes: a string's anchor is the smallest hash among its
GRAM-byte substrings (the last of equal ones), so equal strings have equal anchors at equal
offsets. Neighbouring strings with one anchor form a run; runs are a hundredth of the corpus.

1. Runs whose anchor occurs once in the corpus have no partner. Of the others, runs of equal content (a 128-bit
   key) are one kind; a kind that occurs more than once is represented by two of its runs.
2. The bytes of these runs are fetched and their suffixes sorted: a mergesort whose comparisons find the
   common extension of two suffixes by binary search over prefix hashes, in log2(LENGTH) steps; neighbours
   that share LENGTH bytes are verified byte by byte. What is repeated in a kind is so in all its runs.
3. Anchors with very many kinds (a passage that a large share of documents has) are sorted in parts. Strings
   of different parts then meet as grouped counts: first blocks of BLOCK neighbouring suffixes by the hash of the
   bytes that all of them hold, then the suffixes of blocks that are not alone by their LENGTH bytes themselves.

Grouped counts combine before they shuffle, and joins have stored tables on both sides, which Spark can
split, so a passage, source or group of copies may hold a third of all rows. What is found in each step is
written to the shared folder, and lineage ends there.

Null and empty texts have no bytes. Very long texts are cut into overlapping parts for hashing, so no string is
lost. Matches never cross documents. Repeated rows are copies of each other, whatever their ids; there are no ties.
An empty table gives an empty result; only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import byte_column, column, forget, map_arrow, store

LENGTH = 200
GRAM = 40
#: Different runs of one anchor that are sorted together.
TOGETHER = 2048
#: Offsets from the anchor that are one block.
BLOCK = 16
#: Bytes that are hashed at once.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random value per byte."""
    n = CHUNK + 4 * LENGTH
    up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n, _BACK)])
    return up, down, _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PrefixHash:
    """Hashes of any substrings of up to CHUNK bytes in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down, values = _powers()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start, length):
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours (two running minima per block)."""
    n = len(x)
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(-1, width)
    before = np.minimum.accumulate(grid, 1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first start, strings, offset of the anchor, anchor hash, content hash) of the runs of texts in data (up to CHUNK bytes)."""
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return empty
    table = PrefixHash(data)
    grams = _mix(table.of(np.arange(len(data) - GRAM + 1), GRAM))
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_minimum((grams & ~_PLACE) | (_PLACE - places), LENGTH - GRAM + 1)
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    many = np.maximum(lengths - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), many)
    if not len(text):
        return empty
    where = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts, many)
    of = anchor[where]
    first = np.nonzero(np.r_[True, (of[1:] != of[:-1]) | (text[1:] != text[:-1])])[0]
    count = np.diff(np.r_[first, len(text)])
    at, own = where[first], text[first]
    offset = of[first] - at
    content = _mix(table.of(at, count - 1 + LENGTH) + (offset * 1024 + count).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return own, at - starts[own], count, offset, grams[of[first]], content


def _chunks(starts: np.ndarray, lengths: np.ndarray):
    """Groups of (text, first byte of its part, bytes) of up to CHUNK bytes; parts of a long text overlap by LENGTH - 1."""
    group, held = [], 0
    for i, n in enumerate(lengths.tolist()):
        a = 0
        while n - a >= LENGTH:
            size = min(n - a, CHUNK)
            if held + size > CHUNK and group:
                yield group
                group, held = [], 0
            group.append((i, a, size))
            held += size
            a += size - LENGTH + 1
    if group:
        yield group


_KEY = "id long, t1 long, t2 long"


def keyed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, t1, t2, text): the id as a number for choosing, and the text's 128-bit hash, which joins copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(key), F.xxhash64(F.col(key).cast("string")).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.alias("text"))


def runs(docs: DataFrame) -> DataFrame:
    """(h, c, id, t1, t2, s, m, o) of all runs: anchor, content, text, first start, strings, anchor's offset."""

    def run(batches):
        for batch in batches:
            data, starts, lengths = byte_column(column(batch, "text"))
            ids = [column(batch, n).to_numpy(zero_copy_only=False) for n in ("id", "t1", "t2")]
            for group in _chunks(starts, lengths):
                who = np.array([g[0] for g in group])
                skip = np.array([g[1] for g in group])
                size = np.array([g[2] for g in group])
                flat = np.concatenate([data[starts[i] + a : starts[i] + a + n] for i, a, n in group])
                own, s, m, o, h, c = runs_of(flat, np.cumsum(size) - size, size)
                arrays = [h.view(np.int64), c.view(np.int64), *(x[who[own]] for x in ids), (s + skip[own]).astype(np.int32), m.astype(np.int32), o.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["h", "c", "id", "t1", "t2", "s", "m", "o"])

    return map_arrow(docs.select("id", "t1", "t2", "text"), run, f"h long, c long, {_KEY}, s int, m int, o int")


def suffix_sort(table: PrefixHash, data: np.ndarray, start: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of suffixes cut at LENGTH bytes within segments (sorted numbers).

    common[i]: bytes that the suffixes at places i and i + 1 of the order share (0 across segments).
    A stable bottom-up mergesort: each suffix finds its rank in the sibling run by binary search.
    """
    n = len(start)
    first = np.nonzero(np.r_[True, segment[1:] != segment[:-1]])[0] if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    base, limit = np.repeat(first, size), np.repeat(first + size, size)
    order = np.arange(n)
    width = 1
    while width < (size.max() if n else 0):
        live = np.nonzero(limit - base > width)[0]
        local = live - base[live]
        run = local // width
        left = run % 2 == 0
        low = np.minimum(base[live] + np.where(left, run + 1, run - 1) * width, limit[live])
        high = np.minimum(low + width, limit[live])
        begin = low.copy()
        mine = start[order[live]]
        while True:
            open_ = np.nonzero(low < high)[0]
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = start[order[mid]]
            shared = common_extension(table, mine[open_], other)
            k = np.minimum(shared, LENGTH - 1)
            equal = shared >= LENGTH
            a, b = data[mine[open_] + k], data[other + k]
            # of equal suffixes the left run's come first
            go = np.where(equal, ~left[open_], b < a)
            low[open_] = np.where(go, mid + 1, low[open_])
            high[open_] = np.where(go, high[open_], mid)
        to = base[live] + run // 2 * 2 * width + (local - run * width) + (low - begin)
        new = order.copy()
        new[to] = order[live]
        order = new
        width *= 2
    common = np.zeros(max(0, n - 1), np.int64)
    near = np.nonzero(segment[1:] == segment[:-1])[0]
    common[near] = common_extension(table, start[order[near]], start[order[near + 1]])
    return order, common


def common_extension(table: PrefixHash, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that suffixes share, up to LENGTH, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH, np.int64)
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = table.of(a, mid) == table.of(b, mid)
        low = np.where(same, mid, low)
        high = np.where(same, high, mid - 1)
    return low


def repeated(contents: list[bytes], counts: np.ndarray, offsets: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, string in it, is repeated) of all strings of runs; equal strings share anchor and offset."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    table = PrefixHash(data)
    begin = np.cumsum([0, *map(len, contents)])[:-1]
    run = np.repeat(np.arange(len(contents)), counts)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[run] + inside
    _, number = np.unique(anchors, return_inverse=True)
    segment = number[run] * (2 * LENGTH) + offsets[run] - inside
    by = np.argsort(segment, kind="stable")
    order, common = suffix_sort(table, data, start[by], segment[by])
    order = by[order]
    pair = np.nonzero(common >= LENGTH)[0]
    # equal hashes are not yet equal bytes
    for a in range(0, len(pair), 4096):
        x, y = start[order[pair[a : a + 4096]]], start[order[pair[a : a + 4096] + 1]]
        reach = np.arange(LENGTH)
        same = (data[x[:, None] + reach] == data[y[:, None] + reach]).all(1)
        pair[a : a + 4096][~same] = -1
    pair = pair[pair >= 0]
    twice = np.zeros(len(run), bool)
    twice[order[pair]] = True
    twice[order[pair + 1]] = True
    return run, inside, twice


def spans(docs: DataFrame) -> DataFrame:
    """(t1, t2, s, m): starts s .. s + m - 1 of repeated strings of LENGTH bytes in texts; docs as `keyed` gives them."""
    all_runs = store(runs(docs), "runs", "zstd")
    anchors = store(all_runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors", "zstd")
    near = store(all_runs.join(anchors, "h", "left_semi"), "near", "zstd")
    forget(all_runs, anchors)
    spot = F.struct("id", "t1", "t2", "s", "m", "o")
    kinds = store(near.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("low"), F.max(spot).alias("high")), "kinds", "zstd")
    parts = store(kinds.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts")), "parts", "zstd")
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part")
    two = F.when(F.col("n") > 1, F.array("low", "high")).otherwise(F.array("low"))
    dealt = kinds.join(parts, "h").select("h", "c", "parts", part, F.posexplode(two).alias("which", "spot"))
    looks = dealt.groupBy("spot.id", "spot.t1", "spot.t2").agg(F.collect_list(F.struct("h", "c", "which", "spot.s", "spot.m", "spot.o", "parts", "part")).alias("looks"))
    found = store(_inside(_fetched(docs, looks)), "inside", "zstd")
    forget(kinds, parts)
    hits = found.where("w1 IS NULL").select("h", "c", "k", "m").union(_across(found.where("w1 IS NOT NULL")))
    hits = store(hits.groupBy("h", "c").agg(F.collect_list(F.struct("k", "m")).alias("hits")), "hits", "zstd")
    # all runs of a kind have what its representative has
    out = store(near.join(hits, ["h", "c"]).select("t1", "t2", "s", "hits").distinct(), "spans", "zstd")
    forget(near, found, hits)
    return out.select("t1", "t2", "s", F.explode("hits").alias("x")).select("t1", "t2", (F.col("s") + F.col("x.k")).alias("s"), F.col("x.m").alias("m"))


def _across(lone: DataFrame) -> DataFrame:
    """(h, c, k, m) of the strings that parts of an anchor have in common."""
    met = store(lone.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "met")
    place = F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i")
    close = lone.join(met, ["w1", "w2"], "left_semi").select("h", "c", "k", "o", "w2", "bytes", place)
    # the anchor's offset within the block makes the place in the block, w2 the anchor and the block
    string = F.substring(F.col("bytes"), F.col("i") + 1, F.lit(LENGTH)).alias("string")
    single = store(close.select("h", "c", (F.col("k") + F.col("i")).alias("k"), (F.col("o") - F.col("i")).alias("o"), "w2", string), "single", "zstd")
    twice = store(single.groupBy("w2", "o", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w2", "o", "string"), "twice", "zstd")
    return single.join(twice, ["w2", "o", "string"], "left_semi").select("h", "c", "k", F.lit(1).alias("m"))


def _fetched(docs: DataFrame, looks: DataFrame) -> DataFrame:
    """(h, part, parts, c, which, o, m, content) of the runs to look into."""
    names = ["h", "part", "parts", "c", "which", "o", "m", "content"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        last = None
        for batch in batches:
            data, starts, _ = byte_column(column(batch, "text"))
            out = [[] for _ in names]
            keys = zip(*(column(batch, n).to_pylist() for n in ("id", "t1", "t2")), strict=True)
            looked = column(batch, "looks")
            for i, (key, at) in enumerate(zip(keys, starts.tolist(), strict=True)):
                # rows with one id and one text come one after the other
                if key == last:
                    continue
                last = key
                for x in looked[i].as_py():
                    a = at + x["s"]
                    row = (x["h"], x["part"], x["parts"], x["c"], x["which"], x["o"], x["m"], data[a : a + x["m"] - 1 + LENGTH].tobytes())
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    joined = docs.hint("merge").join(looks, ["id", "t1", "t2"]).select("id", "t1", "t2", "text", "looks")
    return map_arrow(joined, run, "h long, part int, parts int, c long, which int, o int, m int, content binary")


def _inside(fetched: DataFrame) -> DataFrame:
    """Repeated strings of kinds (h, c, k, m: strings k .. k + m - 1 of the run), and all strings of anchors in several parts as blocks.

    A block has w1, the hash of the bytes that all its strings hold, w2, its anchor and place, the first
    string's offset from the anchor (o), the number of its strings (m), and its bytes.
    """
    # an anchor's part has at most a few thousand runs, so it is whole in one task
    dealt = fetched.repartition("h", "part").sortWithinPartitions("h", "part")
    names = ["h", "c", "k", "m", "o", "w1", "w2", "bytes"]

    def solve(batch: pa.RecordBatch):
        col = lambda n: column(batch, n).to_numpy(zero_copy_only=False)
        h, parts, c, which, o, m = (col(x) for x in ("h", "parts", "c", "which", "o", "m"))
        contents = column(batch, "content").to_pylist()
        run, inside, twice = repeated(contents, m.astype(np.int64), o.astype(np.int64), h)
        # repeated strings next to each other are one row
        hit = np.nonzero(twice & (which[run] == 0))[0]
        if len(hit):
            first = _pieces(hit, run[hit])
            r, n = run[hit[first]], np.diff(np.r_[first, len(hit)])
            none = pa.nulls(len(r), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[r]), pa.array(c[r]), pa.array(inside[hit[first]].astype(np.int32)), pa.array(n.astype(np.int32)), pa.nulls(len(r), pa.int32()), none, none, pa.nulls(len(r), pa.binary())], names)
        # strings of a divided anchor may have their only partner in another part
        lone = np.nonzero((parts[run] > 1) & (which[run] == 0))[0]
        if len(lone):
            from_anchor = o[run[lone]] - inside[lone]
            block = from_anchor // BLOCK
            first = _pieces(lone, run[lone] * 1024 + block)
            r, k, b = run[lone[first]], inside[lone[first]], block[first]
            n = np.diff(np.r_[first, len(lone)])
            table = PrefixHash(np.frombuffer(b"".join(contents), np.uint8))
            begin = np.cumsum([0, *map(len, contents)])[:-1]
            core = _mix(table.of(begin[r] + o[r] - b * BLOCK, LENGTH - BLOCK + 1))
            place = _mix(h[r].view(np.uint64) + b.astype(np.uint64))
            held = [contents[i][a : a + x - 1 + LENGTH] for i, a, x in zip(r.tolist(), k.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[r]), pa.array(c[r]), pa.array(k.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(from_anchor[first].astype(np.int32)), pa.array(core.view(np.int64)), pa.array(place.view(np.int64)), pa.array(held, pa.binary())], names)

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            key = list(zip(column(held, "h").to_pylist(), column(held, "part").to_pylist(), strict=True))
            cut = len(key)
            while cut and key[cut - 1] == key[-1]:
                cut -= 1
            if cut:
                yield from solve(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held)

    return map_arrow(dealt, run, "h long, c long, k int, m int, o int, w1 long, w2 long, bytes binary", 1024)


def _pieces(places: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring places of one group begin."""
    return np.nonzero(np.r_[True, (places[1:] != places[:-1] + 1) | (group[1:] != group[:-1])])[0]


def removed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row."""
    rows = keyed(docs, key)
    found = store(spans(rows).groupBy("t1", "t2").agg(F.collect_list(F.struct("s", "m")).alias("spans")), "found", "zstd")
    joined = rows.join(found, ["t1", "t2"], "left").select(key, "text", "spans")

    def run(batches):
        for batch in batches:
            data, starts, lengths = byte_column(column(batch, "text"))
            size, gone, pieces, kept = [], [], [], []
            for at, n, here in zip(starts.tolist(), lengths.tolist(), column(batch, "spans").to_pylist(), strict=True):
                raw = data[at : at + n]
                edge = np.zeros(n + 1, np.int64)
                if here:
                    s = np.array([x["s"] for x in here])
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array([x["m"] for x in here]) - 1 + LENGTH, -1)
                cover = np.cumsum(edge[:-1]) > 0
                size.append(n)
                gone.append(int(cover.sum()))
                pieces.append(int((np.diff(np.r_[0, cover.astype(np.int8)]) == 1).sum()))
                kept.append(raw[~cover].tobytes())
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([column(batch, key), *(pa.array(x, pa.int64()) for x in (size, gone, pieces)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_arrow(joined, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where more than half of the text's shingle hashes have it (XXH64 of
the space-joined words, seed 42). Equal fingerprints are one node. Two fingerprints
within `distance` bits agree on all bits of at least three of `distance + 3` blocks, so each
node is dealt to one bucket per triple of blocks, and no link is missed. Inside a bucket the Hamming
distances to PIVOTS reference fingerprints are tabulated, pairs are discarded by their
largest coordinate difference (a lower bound of their distance), and survivors are verified.
A bucket gives spanning links instead of all its pairs; components are joined afterwards. A large
bucket begins with leaders (a member next to the bucket's majority, then members outside the largest
group): whatever is near one is linked at once, and only pairs of different groups are left to the tables.
Buckets of more than LIMIT nodes go on in blocks, and pairs of blocks are tasks of their own.

Null and empty texts have fingerprint zero and link like any other. Very long texts count whole.
Fewer words than a shingle are one shingle. A component's id is the smallest non-null id in it (null if
it has none); ties don't arise, as equal ids are one id. Repeated rows stay rows of their own; an empty table
gives an empty result; only the named columns are read, so clashing names do not matter. Copies collapse in
the map side of a grouped minimum, so a group of copies of any size is one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, store, texts
from .components import connected

SEED = 42
PIVOTS = 16
#: Buckets up to this size are compared by shifts over the whole batch, larger ones one by one.
SMALL = 12
#: Rows of a bucket that are compared at once.
BLOCK = 512
#: Leaders that a bucket begins with, and nodes of a bucket that one task compares with each other.
LEADERS = 64
LIMIT = 65_536


def _mixed(n: int) -> np.ndarray:
    """n reference fingerprints: the splitmix sequence."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PIVOTS = _mixed(PIVOTS)


def shingle_hashes(text: str | None, k: int) -> list[int]:
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    whole = b" ".join(parts)
    if len(parts) <= k:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    ends = list(accumulate(len(p) + 1 for p in parts))
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :], strict=False)]


def majority_bits(hashes: np.ndarray, starts: list[int]) -> np.ndarray:
    """(groups x 64 bool) bits that more than half of each group's hashes have."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return 2 * sums > np.diff([*starts, len(hashes)])[:, None]


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """(sets x words) fingerprints of sets of hashes that aren't empty; each word has hashes of its own."""
    out = np.zeros((len(sets), words), np.uint64)
    a = 0
    while a < len(sets):
        b, held = a, 0
        while b < len(sets) and (b == a or held + len(sets[b]) <= 60_000):
            held += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *map(len, sets[a:b])])[:-1].tolist()
        for w, f in enumerate(_mixed(words)):
            x = (flat ^ (flat >> np.uint64(31))) * (f | np.uint64(1))
            bits = majority_bits(x ^ (x >> np.uint64(29)), starts)
            out[a:b, w] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        a = b
    return out


def fingerprint_values(values: list, k: int) -> np.ndarray:
    """uint64 fingerprints of texts."""
    out = np.zeros(len(values), np.uint64)
    pending: list[int] = []
    marks: list[tuple[int, int]] = []

    def flush() -> None:
        if pending:
            bits = majority_bits(np.array(pending, np.uint64), [a for _, a in marks])
            out[[i for i, _ in marks]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
        pending.clear()
        marks.clear()

    for i, t in enumerate(values):
        if hashes := shingle_hashes(t, k):
            marks.append((i, len(pending)))
            pending.extend(hashes)
            if len(pending) > 60_000:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, shingle: int, key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array(fingerprint_values(texts(batch), shingle).view(np.int64))], [key, "fp"])

    return map_arrow(docs.select(key, "text"), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def blocks(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of distance + 3 blocks of 64 bits."""
    edges = [64 * i // (distance + 3) for i in range(distance + 4)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ _PIVOTS).astype(np.int8)


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each group) after joining i[k] with j[k]."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(flat := label[label], label):
            label = flat


def near_pairs(x: np.ndarray, y: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in x, j in y) of pairs within distance bits, some at a time; y None: pairs i < j within x."""
    table = _table(x)
    order = np.argsort(table[:, 0], kind="stable")
    left, t = x[order], table[order]
    if y is None:
        other, right, u = order, left, t
    else:
        u = _table(y)
        other = np.argsort(u[:, 0], kind="stable")
        right, u = y[other], u[other]
    for a in range(0, len(left), BLOCK):
        b = min(a + BLOCK, len(left))
        # sorted by the first pivot: only rows that can be near
        first = a if y is None else int(np.searchsorted(u[:, 0], t[a, 0] - distance))
        end = int(np.searchsorted(u[:, 0], t[b - 1, 0] + distance, "right"))
        for c in range(first, end, 4 * BLOCK):
            d = min(c + 4 * BLOCK, end)
            i, j = np.nonzero(np.abs(t[a:b, None, 1] - u[None, c:d, 1]) <= distance)
            i, j = i + a, j + c
            if y is None:
                i, j = i[i < j], j[i < j]
            for p in (0, *range(2, PIVOTS)):
                keep = np.abs(t[i, p] - u[j, p]) <= distance
                i, j = i[keep], j[keep]
            keep = np.bitwise_count(left[i] ^ right[j]) <= distance
            if keep.any():
                yield order[i[keep]], other[j[keep]]


def _majority(fp: np.ndarray) -> np.uint64:
    return np.packbits(majority_bits(fp, [0]), axis=1, bitorder="little").view(np.uint64)[0, 0]


def bucket_links(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one bucket of distinct fingerprints."""
    label = np.arange(len(fp))
    if len(fp) > BLOCK:
        leader = int(np.bitwise_count(fp ^ _majority(fp)).argmin())
        for _ in range(LEADERS):
            far = np.bitwise_count(fp ^ fp[leader])
            label = unite(label, near := np.nonzero(far <= distance)[0], np.full(len(near), leader))
            largest = np.bincount(label).argmax()
            outside = np.nonzero(label != largest)[0]
            if not len(outside):
                break
            leader = int(outside[np.bitwise_count(fp[outside] ^ fp[largest]).argmin()])
        largest = np.bincount(label).argmax()
        outside = np.nonzero(label != largest)[0]
        inside = np.nonzero(label == largest)[0]
        for i, j in near_pairs(fp[outside], fp[inside], distance):
            label = unite(label, outside[i], inside[j])
        for i, j in near_pairs(fp[outside], None, distance):
            label = unite(label, outside[i], outside[j])
    else:
        for i, j in near_pairs(fp, None, distance):
            label = unite(label, i, j)
    member = np.nonzero(label != np.arange(len(fp)))[0]
    return fp[member], fp[label[member]]


def cross_links(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two blocks of a bucket."""
    both = np.concatenate([x, y])
    label = np.arange(len(both))
    for i, j in near_pairs(x, y, distance):
        label = unite(label, i, j + len(x))
    member = np.nonzero(label != np.arange(len(both)))[0]
    return both[member], both[label[member]]


def batch_links(keys: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of whole buckets in order of key."""
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    if small.any():
        k, f = keys[small], fp[small]
        table = _table(f)
        for s in range(1, SMALL):
            i = np.nonzero(k[s:] == k[:-s])[0]
            if not len(i):
                break
            near = np.abs(table[i] - table[i + s]).max(1) <= distance
            i = i[near]
            i = i[np.bitwise_count(f[i] ^ f[i + s]) <= distance]
            yield f[i], f[i + s]
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        yield bucket_links(fp[a : a + n], distance)


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Spanning links (u, v) among distinct fingerprints fp within distance bits."""
    parts = [(F.shiftrightunsigned(F.col("fp"), a).bitwiseAND((1 << n) - 1), n) for a, n in blocks(distance)]
    keys = []
    for t, trio in enumerate(combinations(range(len(parts)), 3)):
        key = F.lit(t).cast("long")
        for k in trio:
            key = F.shiftleft(key, parts[k][1]).bitwiseOR(parts[k][0])
        keys.append(key)
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("bucket")).repartition("bucket").sortWithinPartitions("bucket")
    names = ["u", "v", "bucket", "block"]

    def found(u, v):
        if len(u):
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), none, none], names)

    def run(batches):
        keys, fp, block = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            keys = np.concatenate([keys, column(batch, "bucket").to_numpy()])
            fp = np.concatenate([fp, column(batch, "fp").to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                if block:  # the rest of a large bucket
                    first = int(np.searchsorted(keys, keys[0], "right"))
                    yield from large(keys[:first], fp[:first], block)
                    block = 0
                else:
                    first = 0
                yield from whole(keys[first:cut], fp[first:cut])
                keys, fp = keys[cut:], fp[cut:]
            while len(keys) > LIMIT:
                yield from large(keys[:LIMIT], fp[:LIMIT], block)
                keys, fp, block = keys[LIMIT:], fp[LIMIT:], block + 1
        if block:
            yield from large(keys, fp, block)
        else:
            yield from whole(keys, fp)

    def whole(k, f):
        for u, v in batch_links(k, f.view(np.uint64), distance):
            yield from found(u, v)

    def large(k, f, block):
        """A block of a large bucket: its own links, and its rows for the pairs of blocks."""
        yield from found(*bucket_links(f.view(np.uint64), distance))
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.nulls(len(f), pa.int64()), pa.array(k), pa.array(np.full(len(k), block, np.int64))], names)

    first = store(map_arrow(dealt, run, "u long, v long, bucket long, block long", 65_536), "buckets")
    rows = first.where("bucket IS NOT NULL").select("bucket", "block", F.col("u").alias("fp"))
    many = store(rows.groupBy("bucket").agg(F.max("block").alias("last")), "large")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    pairs = rows.join(many, "bucket").select("bucket", "block", "fp", other.alias("other")).where("block <> other")
    pairs = pairs.select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "fp")

    def cross(batches):
        here, parts = None, []
        for batch in batches:
            keys = list(zip(*(column(batch, c).to_pylist() for c in ("bucket", "a", "b")), strict=True))
            block, fp = column(batch, "block").to_numpy(), column(batch, "fp").to_numpy()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if keys[a] != here:
                    yield from solve(here, parts)
                    here, parts = keys[a], []
                parts.append((block[a:b], fp[a:b]))
        yield from solve(here, parts)

    def solve(key, parts):
        if parts:
            block, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from found(*cross_links(fp[block == key[1]].view(np.uint64), fp[block == key[2]].view(np.uint64), distance))

    dealt = pairs.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    second = map_arrow(dealt, cross, "u long, v long, bucket long, block long", 65_536)
    return first.where("bucket IS NULL").select("u", "v").unionByName(second.select("u", "v")).distinct()


def components(docs: DataFrame, shingle: int = 5, distance: int = 4, key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row."""
    marked = store(fingerprints(docs, shingle, key), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min(key).alias("low"))
    found = connected(links(nodes.select("fp"), distance))
    # stored tables on both sides of the joins by root: Spark can split a root that many fingerprints have
    low = store(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = store(low.groupBy("root").agg(F.min("low").alias("component_id")), "ids")
    of = low.select("fp", "root").join(ids, "root").select("fp", "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(of, "fp").select(key, digits.alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 5, distance: int = 4, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is that of their component; of rows that repeat the id, one."""
    lows = components(docs, shingle, distance, key).where(F.col(key).eqNullSafe(F.col("component_id")))
    lows = store(lows.select(F.xxhash64(F.col(key).cast("string")).alias("__id")).distinct(), "representatives")
    # one exchange of whole rows: the join's partitioning serves the choice among repeated ids
    return docs.withColumn("__id", F.xxhash64(F.col(key).cast("string"))).join(lows.hint("merge"), "__id", "left_semi").dropDuplicates(["__id"]).drop("__id")

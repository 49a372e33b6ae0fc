"""Near-duplicates by word shingles: SimHash fingerprints and distance tables, verified by exact Jaccard similarity.

Texts with equal shingle sets are one node. Each node has a fingerprint of WORDS x 64 bits (SimHash over
its distinct shingles) and a bucket for each of BANDS bands of ROWS minima: a pair at similarity s shares
a bucket with probability 1 - (1 - s ** ROWS) ** BANDS (0.999993 at 0.8). Buckets by blocks of
fingerprint bits, which serve a few differing bits, would miss such pairs: at 0.8 a sixth of the bits differ.

1. In each bucket the node next to the majority of the fingerprints is the reference of the others. Pairs with it
   that are within DISTANCE bits are verified on the shingles themselves and joined to components, so a large
   group of near copies takes as many comparisons as it has nodes.
2. Buckets that still hold several components are compared in pairs of blocks of LIMIT nodes: distances to
   reference nodes of the blocks are tabulated, pairs are discarded by their largest coordinate difference, by distance
   and by size, and each survivor is verified by shingles in the first bucket that it shares, unless its ends
   are joined already. Rows are sent once per pair of blocks, never per pair of nodes.

DISTANCE leaves 6 standard deviations above the mean at a similarity of 0.8. Null and empty texts are one node.
Very long texts count whole. Fewer words than a shingle are one shingle. Of each component one row stays: the
smallest id (null last), then the smallest text hash; of repeated rows one. An empty table gives an empty result;
all columns are as they are, whatever their names (but for those that begin with two underscores).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, forget, map_arrow, store, texts
from .components import connected
from .simhash import SEED, _mixed, shingle_hashes, wide_fingerprints

SIMILARITY = 0.8
ROWS = 5
BANDS = 30
WORDS = 4
#: Bits of WORDS * 64 in which nodes at a similarity of 0.8 differ at most: 39 in the mean for long texts, 48 for texts of a few shingles.
DISTANCE = 84
#: References of a table.
PIVOTS = 16
#: Pairs of one node that one task verifies; the node's text is sent to as many as it needs.
SHARE = 512
#: Nodes of a block of a bucket.
LIMIT = 512
_FACTORS = _mixed(ROWS * BANDS) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def shingles(text: str | None, k: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x ROWS * BANDS) minima of sets that aren't empty."""
    flat = np.concatenate(sets)
    flat ^= flat >> _HALF
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    return np.stack([np.minimum.reduceat(flat * f, starts) for f in _FACTORS], 1)


def bands(low: np.ndarray) -> np.ndarray:
    """(sets x BANDS) bucket numbers."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX, (len(low), BANDS)).copy()
    for r in range(ROWS):
        key = (key ^ low[:, r::ROWS]) * _MIX
        key ^= key >> _HALF
    return key


def _marked(docs: DataFrame, k: int, key: str) -> DataFrame:
    """(key, node, n, bands, fp) of every row; a node without shingles has no bands."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, k) for t in texts(batch)]
            full = [s for s in sets if len(s)]
            dealt = iter(bands(minima(full)).view(np.int64).tolist() if full else ())
            marks = iter(wide_fingerprints(full, WORDS))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, key), column(batch, "__hash"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([next(dealt) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array([next(marks).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                [key, "__hash", "node", "n", "bands", "fp"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return store(map_arrow(docs.select(key, "text", F.xxhash64("text").alias("__hash")), run, f"`{key}` {kind}, __hash long, node long, n long, bands array<long>, fp binary"), "minima", "zstd")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(x x y) differing bits of fingerprints of WORDS words."""
    return sum(np.bitwise_count(x[:, None, w] ^ y[None, :, w]).astype(np.int16) for w in range(x.shape[1]))


def _marks(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint64).reshape(-1, WORDS)


def _shared(nodes: DataFrame) -> DataFrame:
    """(bucket, block, node) of the buckets with more than one node; blocks have up to LIMIT nodes."""
    dealt = nodes.select("node", F.explode("bands").alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", "node")

    def run(batches):
        last, before, place = None, None, 0
        for batch in batches:
            bucket, node = column(batch, "bucket").to_numpy(), column(batch, "node").to_numpy()
            new = np.r_[last != bucket[0], bucket[1:] != bucket[:-1]] if len(bucket) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), -1)) if len(bucket) else np.zeros(0, np.int64)
            rank = np.where(first >= 0, np.arange(len(bucket)) - first, place + np.arange(len(bucket)))
            # a bucket's first node is sent when its second comes
            out = [(bucket[rank > 0], rank[rank > 0], node[rank > 0])]
            second = np.nonzero(rank == 1)[0]
            out.append((bucket[second], np.zeros(len(second), np.int64), np.array([node[i - 1] if i else before for i in second.tolist()], np.int64)))
            if len(bucket):
                last, before, place = bucket[-1], node[-1], int(rank[-1]) + 1
            b, r, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(r // limit), pa.array(n)], ["bucket", "block", "node"])

    limit = LIMIT
    return map_arrow(dealt, run, "bucket long, block long, node long", 65_536)


def _sorted_groups(batches, keys: list[str]):
    """(key, batches) of rows that come sorted by keys."""
    here, parts = None, []
    for batch in batches:
        rows = list(zip(*(column(batch, k).to_pylist() for k in keys), strict=True))
        edges = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if rows[a] != here:
                if parts:
                    yield here, pa.Table.from_batches(parts).combine_chunks()
                here, parts = rows[a], []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield here, pa.Table.from_batches(parts).combine_chunks()


def _stars(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of each node with the reference of its block, and of blocks' references with the first block's."""
    dealt = rows.select("bucket", "block", "node", "n", "fp").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "node")

    def run(batches):
        out: list[tuple] = []
        for (bucket, block), t in _sorted_groups(batches, ["bucket", "block"]):
            node, n, fp = t["node"].to_numpy(), t["n"].to_numpy(), _marks(t["fp"])
            bits = np.unpackbits(fp.view(np.uint8), axis=1)
            middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(node)).view(np.uint64)[None]
            k = int(distances(fp, middle)[:, 0].argmin())
            near = (distances(fp, fp[k : k + 1])[:, 0] <= DISTANCE) & (np.minimum(n, n[k]) >= similarity * np.maximum(n, n[k]) - 1e-6)
            near[k] = False
            out += [(int(u), int(node[k]), None, None) for u in node[near]]
            out.append((int(node[k]), None, bucket, block))
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(out):
        cols = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "bucket", "block"])

    found = store(map_arrow(dealt, run, "u long, v long, bucket long, block long", 4096), "stars")
    heads = found.where("v IS NULL").select("bucket", "block", "u")
    first = store(heads.where("block = 0").select("bucket", F.col("u").alias("v")), "heads")
    across = heads.where("block > 0").join(first, "bucket").select("u", "v")
    pairs = found.where("v IS NOT NULL").select("u", "v").unionByName(across).where("u <> v")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, held: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingles reach the similarity; held: texts of nodes."""
    pairs = store(pairs, "candidates")
    times = store(pairs.groupBy("v").agg((F.floor(F.count(F.lit(1)) / SHARE) + 1).alias("times")), "times")
    left = pairs.join(times, "v").select("u", "v", F.pmod(F.xxhash64("u"), "times").alias("part"))
    left = left.join(held.select(F.col("node").alias("u"), F.col("text").alias("__u")), "u")
    right = held.withColumnRenamed("node", "v").join(times, "v").select("v", F.col("text").alias("__v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("part"))
    joined = left.hint("merge").join(right, ["v", "part"])

    def run(batches):
        last, there = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for v, a, b in zip(column(batch, "v").to_pylist(), texts(batch, "__u"), texts(batch, "__v"), strict=True):
                if v != last:
                    last, there = v, shingles(b, k)
                keep.append(jaccard(shingles(a, k), there) >= similarity)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return store(map_arrow(joined.select("u", "v", "__u", "__v"), run, "u long, v long"), "verified")


def block_links(x: dict, y: dict | None, bucket: int, similarity: float, sets) -> list[tuple[int, int]]:
    """Verified links between nodes of two blocks (y None: within one) whose components differ.

    x, y: arrays node, root, n, fp and bands of the blocks; sets(node): its shingles.
    """
    other = x if y is None else y
    pivots = x["fp"][np.linspace(0, len(x["node"]) - 1, min(PIVOTS, len(x["node"]))).astype(np.int64)]
    left, right = distances(x["fp"], pivots), distances(other["fp"], pivots)
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while (p := parent.get(r, r)) != r:
            parent[r] = parent.get(p, p)
            r = p
        return r

    links = []
    for a in range(len(x["node"])):
        first = a + 1 if y is None else 0
        n, m = x["n"][a], other["n"][first:]
        keep = (x["root"][a] != other["root"][first:]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)
        at = np.nonzero(keep)[0] + first
        at = at[np.abs(right[at] - left[a]).max(1) <= DISTANCE] if len(at) else at
        at = at[distances(x["fp"][a : a + 1], other["fp"][at])[0] <= DISTANCE] if len(at) else at
        if len(at):
            # a pair is looked at in the first bucket that it shares
            same = other["bands"][at] == x["bands"][a]
            at = at[x["bands"][a][same.argmax(1)] == bucket]
        for b in at.tolist():
            p, q = find(int(x["root"][a])), find(int(other["root"][b]))
            if p != q and jaccard(sets(int(x["node"][a])), sets(int(other["node"][b]))) >= similarity:
                parent[max(p, q)] = min(p, q)
                links.append((int(x["node"][a]), int(other["node"][b])))
    return links


def _rest(rows: DataFrame, nodes: DataFrame, held: DataFrame, k: int, similarity: float) -> DataFrame:
    """Verified links (u, v) inside the buckets of rows (bucket, block, node, n, fp, root)."""
    last = store(rows.groupBy("bucket").agg(F.max("block").alias("last")), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    whole = rows.join(nodes.select("node", "bands"), "node").join(held, "node")
    dealt = whole.join(last, "bucket").select("bucket", "block", "node", "n", "fp", "root", "bands", "text", other)
    dealt = dealt.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other")
    dealt = dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node")

    def run(batches):
        for (bucket, a, b), t in _sorted_groups(batches, ["bucket", "a", "b"]):
            node = t["node"].to_numpy()
            place = dict(zip(node.tolist(), range(len(node)), strict=True))
            known: dict[int, np.ndarray] = {}

            def sets(v: int, t=t, place=place, known=known) -> np.ndarray:
                if v not in known:
                    known[v] = shingles(t["text"][place[v]].as_py(), k)
                return known[v]

            whole = {"node": node, "root": t["root"].to_numpy(), "n": t["n"].to_numpy(), "fp": _marks(t["fp"]), "bands": np.array(t["bands"].to_pylist(), np.int64).reshape(-1, BANDS)}
            block = t["block"].to_numpy()
            part = lambda i, whole=whole, block=block: {c: v[block == i] for c, v in whole.items()}
            links = block_links(part(a), None if a == b else part(b), bucket, similarity, sets)
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return store(map_arrow(dealt, run, "u long, v long", 1024), "rest")


def components(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(key, __hash, node) of every row, and (node, root) of the nodes that have links."""
    marked = _marked(docs, shingle, key)
    nodes = store(marked.groupBy("node").agg(F.min("__hash").alias("__hash"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("fp").alias("fp")), "nodes", "zstd")
    shared = store(_shared(nodes), "shared")
    # one text for each node that shares a bucket
    used = store(nodes.select("__hash", "node").join(shared.select("node").distinct(), "node", "left_semi"), "used")
    held = store(docs.select("text", F.xxhash64("text").alias("__hash")).hint("merge").join(used, "__hash").dropDuplicates(["node"]).select("node", "text"), "texts", "zstd")
    rows = store(shared.join(nodes.select("node", "n", "fp"), "node"), "buckets", "zstd")
    forget(shared, used)
    first = _verified(_stars(rows, similarity), held, shingle, similarity)
    roots = store(connected(first), "roots")
    rooted = store(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted", "zstd")
    forget(rows)
    mixed = store(rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket"), "mixed")
    second = _rest(rooted.join(mixed, "bucket", "left_semi"), nodes, held, shingle, similarity)
    found = store(connected(first.union(second)), "components")
    forget(rooted, held, mixed)
    return marked.select(key, "__hash", "node"), found


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, key: str = "doc_id") -> DataFrame:
    """One row of docs for each component."""
    marked, found = components(docs, shingle, similarity, key)
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("low"), "__hash")).alias("best")
    nodes = marked.groupBy("node").agg(best)
    lows = nodes.join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    lows = store(lows.select("best.__hash", F.xxhash64(F.col("best.low").cast("string")).alias("__id")).distinct(), "representatives")
    # one exchange of whole rows: the join's partitioning serves the choice among repeated rows
    here = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__id", F.xxhash64(F.col(key).cast("string")))
    return here.join(lows.hint("merge"), ["__hash", "__id"], "left_semi").dropDuplicates(["__hash", "__id"]).drop("__hash", "__id")

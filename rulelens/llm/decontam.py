"""Benchmark decontamination over a distributed positional inverted index.

Training documents are indexed block by block, whatever the benchmark: a block holds the postings of up to
BLOCK_ROWS documents (term, number of occurrences, positions), sorted by term and stored in the shared folder.
A term is the 64-bit hash of a word. A benchmark is asked in passes of at most PASS_TERMS words over the
one index: the frequencies of its terms are summed from the blocks; a block's own terms select the windows whose
rarest term it has; their postings, shifted by the term's offset, are intersected with the shifted postings of
the next rarer terms until all terms of the window agree: an exact phrase match. Proximity matches
are documents that hold the rarest terms of an item within a span of words.

A document lies in one block, so a pass' hits are complete where they are found; no shuffle, and a
source or a passage that a third of all documents share is dealt with the blocks. Several passes
unite the words they hit by row. `clean` indexes blocks in memory and lets the rows without a match through.

Null texts have no words. Very long texts are blocks of their own. Items without words have no window; items of
fewer words than a window are one window; null item ids and texts are no items. Repeated rows give equal rows;
duplicated item ids count once; ties in rarity go to the earlier term of a window, which changes no result, and
to the lesser word (by bytes) in proximity. An empty table on
either side gives rows without hits, or none. Only the named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import byte_column, column, map_arrow, store

WINDOW = 10
#: Bound of the words that one pass sends to all tasks; a larger benchmark takes more passes.
PASS_TERMS = 1_000_000
#: Documents in a block of the index.
BLOCK_ROWS = 256
#: Proximity: so many of an item's rarest terms within so many words.
NEAR_TERMS, NEAR_SPAN = 4, 20
#: Bytes that are hashed at once (and the rest of the word that they end in).
CHUNK = 1 << 20
_PLACES = 1 << 16
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether a byte belongs to words, a random value of each byte (A-Z as a-z), and of each place in a word."""
    byte = np.arange(256)
    inside = (byte >= 0x80) | (byte >= 0x30) & (byte <= 0x39) | (byte >= 0x61) & (byte <= 0x7A) | (byte >= 0x41) & (byte <= 0x5A)
    lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    r = np.random.default_rng(5)
    return inside, r.integers(1, 1 << 63, 256, dtype=np.uint64)[lower], r.integers(1, 1 << 63, _PLACES, dtype=np.uint64) | np.uint64(1)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words of each text) of texts that lie one after the other in data."""
    inside, values, places = _tables()
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    edge[0] = True
    out, firsts = [], []
    a = 0
    while a < len(data):
        b = min(a + CHUNK, len(data))
        while b < len(data) and inside[data[b]] and not edge[b]:
            b += int(np.argmax(~inside[data[b : b + CHUNK]] | edge[b : min(b + CHUNK, len(data))])) or len(data[b : b + CHUNK])
        piece = data[a:b]
        word = inside[piece]
        first = word & (np.r_[True, ~word[:-1]] | edge[a:b])
        at = np.nonzero(word)[0]
        begin = np.nonzero(first[at])[0]
        if len(begin):
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
            mixed = values[piece[at]] * places[place & (_PLACES - 1)] + (place // _PLACES).astype(np.uint64)
            h = np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), begin)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(h ^ (h >> np.uint64(29)))
            firsts.append(at[begin] + a)
        a = b
    none = np.zeros(0, np.int64)
    spot = np.concatenate(firsts or [none])
    sizes = np.searchsorted(spot, starts + lengths) - np.searchsorted(spot, starts)
    return np.concatenate(out or [none.astype(np.uint64)]), sizes.astype(np.int64)


class Block:
    """Postings of one block: distinct terms in order, and the places of each in the block's words."""

    def __init__(self, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, spot: np.ndarray):
        self.sizes, self.term, self.count, self.spot = sizes, term, count, spot
        self.first = np.r_[0, np.cumsum(sizes)]
        self.start = np.r_[0, np.cumsum(count)]

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        hashes, sizes = word_hashes(*byte_column(texts))
        spot = np.argsort(hashes, kind="stable")
        ordered = hashes[spot]
        first = np.nonzero(np.r_[True, ordered[1:] != ordered[:-1]])[0] if len(ordered) else np.zeros(0, np.int64)
        return cls(sizes, ordered[first], np.diff(np.r_[first, len(ordered)]), spot)

    def own(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the sorted terms the block has, the number of each here), from the block's own terms."""
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        here = np.nonzero(terms[at] == self.term)[0]
        return at[here], here

    def documents(self, spot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, spot, "right") - 1


class Queries:
    """Windows of benchmark items over their terms."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        kept = [(str(i), t) for i, t in items if t]
        hashes, sizes = word_hashes(*byte_column(pa.array([t for _, t in kept], pa.string())))
        self.terms, at, ids = np.unique(hashes, return_index=True, return_inverse=True)
        words = [w for _, t in kept for w in _WORD.findall(t.encode().lower())]
        #: Place of each term's word among all in order of their bytes.
        self.rank = np.argsort(np.array(sorted(range(len(at)), key=lambda k: words[at[k]]), np.int64))
        self.items: list[str] = []
        self.words: list[np.ndarray] = []
        rows: dict[bytes, list[int]] = {}
        for (name, _), a, n in zip(kept, np.cumsum(sizes) - sizes, sizes, strict=True):
            if n:
                own = ids[a : a + n].astype(np.int32)
                self.items.append(name)
                self.words.append(np.unique(own))
                for k in range(max(1, n - window + 1)):
                    rows.setdefault(own[k : k + window].tobytes(), []).append(len(self.items) - 1)
        self.windows = [np.frombuffer(w, np.int32) for w in rows]
        self.owners = [sorted(set(o)) for o in rows.values()]
        self.window = window

    def ready(self, frequency: np.ndarray, near: int = NEAR_TERMS) -> dict:
        """What a task needs: terms and offsets of every window, rarest term first (-1: none), and where each term leads."""
        terms = np.full((len(self.windows), self.window), -1, np.int64)
        offsets = np.zeros_like(terms)
        sizes = np.array([len(w) for w in self.windows], np.int64)
        for i, w in enumerate(self.windows):
            order = np.lexsort((np.arange(len(w)), frequency[w]))
            terms[i, : len(w)], offsets[i, : len(w)] = w[order], order
        rare = [w[np.lexsort((self.rank[w], frequency[w]))[:near]] for w in self.words]
        led = lambda firsts: (order := np.argsort(firsts, kind="stable"), np.searchsorted(firsts[order], np.arange(len(self.terms) + 1)))
        heads = terms[:, 0] if len(terms) else np.zeros(0, np.int64)
        return {
            "vocabulary": self.terms, "terms": terms, "offsets": offsets, "sizes": sizes, "owners": self.owners, "items": self.items,
            "windows_of": led(heads), "rare": rare, "items_of": led(np.array([r[0] for r in rare], np.int64)),
        }


def _led(table: tuple[np.ndarray, np.ndarray], terms: np.ndarray) -> np.ndarray:
    """What the terms lead to."""
    order, start = table
    n = start[terms + 1] - start[terms]
    return order[np.arange(n.sum()) + np.repeat(start[terms] - (np.cumsum(n) - n), n)]


def exact(block: Block, q: dict) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its first word) of every occurrence in the block."""
    none = np.zeros(0, np.int64)
    own, here = block.own(q["vocabulary"])
    if not len(own):
        return none, none
    # place of each term of the benchmark among the block's terms
    at = np.full(len(q["vocabulary"]) + 1, -1, np.int64)
    at[own] = here
    rows = _led(q["windows_of"], own)
    rows = rows[((at[q["terms"][rows]] >= 0) | (q["terms"][rows] < 0)).all(1)]
    head = at[q["terms"][rows, 0]]
    n = block.count[head]
    window = np.repeat(rows, n)
    spot = block.spot[np.arange(n.sum()) + np.repeat(block.start[head] - (np.cumsum(n) - n), n)] - q["offsets"][window, 0]
    for k in range(1, q["terms"].shape[1]):
        need = np.nonzero(q["sizes"][window] > k)[0]
        if not len(need):
            break
        t = at[q["terms"][window[need], k]]
        low, end = block.start[t], block.start[t + 1]
        high = end.copy()
        wanted = spot[need] + q["offsets"][window[need], k]
        # binary search inside each list at once
        while (open_ := np.nonzero(low < high)[0]).size:
            mid = (low[open_] + high[open_]) >> 1
            less = block.spot[mid] < wanted[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        hit = (low < end) & (block.spot[np.minimum(low, len(block.spot) - 1)] == wanted)
        keep = np.ones(len(window), bool)
        keep[need[~hit]] = False
        window, spot = window[keep], spot[keep]
    inside = (spot >= 0) & (block.documents(spot) == block.documents(spot + q["sizes"][window] - 1)) if len(spot) else np.zeros(0, bool)
    return window[inside], spot[inside]


def near(block: Block, q: dict, span: int = NEAR_SPAN) -> list[tuple[int, int]]:
    """(document, item) where all of the item's rarest terms lie within span words."""
    own, here = block.own(q["vocabulary"])
    if not len(own):
        return []
    at = np.full(len(q["vocabulary"]) + 1, -1, np.int64)
    at[own] = here
    out = []
    for i in _led(q["items_of"], own).tolist():
        t = at[q["rare"][i]]
        if (t < 0).any():
            continue
        lists = [block.spot[block.start[k] : block.start[k + 1]] for k in t]
        # from each occurrence of the rarest term: the latest and the next of every other
        around = lists[0]
        for other in lists[1:]:
            spots = np.r_[-(1 << 40), other, 1 << 40]
            k = np.searchsorted(spots, around)
            around = around[np.minimum(around - spots[k - 1], spots[k] - around) < span]
        if not len(around):
            continue
        spot = np.concatenate(lists)
        which = np.repeat(np.arange(len(t)), [len(x) for x in lists])
        close = np.searchsorted(around, spot - span), np.searchsorted(around, spot + span, "right")
        some = close[1] > close[0]
        spot, which = spot[some], which[some]
        order = np.argsort(spot, kind="stable")
        spot, which = spot[order], which[order]
        begin = block.first[block.documents(spot)]
        latest = np.stack([np.maximum.accumulate(np.where(which == k, spot, -1)) for k in range(len(t))]).min(0)
        found = (latest >= begin) & (spot - latest < span)
        out += [(d, i) for d in np.unique(block.documents(spot[found])).tolist()]
    return out


def index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks of the positional index, stored: number, ids and word counts of the documents, and the postings.

    term: distinct terms in order (as unsigned numbers), count: postings of each, spot: their places, by term.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "keys", "sizes", "term", "count", "spot"]

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            block = Block.of(column(batch, "text"))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if t is None else pa.array(x, t))
            arrays = [one(column(batch, key), None), one(block.sizes, pa.int64()), one(block.term.view(np.int64), pa.int64()), one(block.count.astype(np.int32), pa.int32()), one(block.spot.astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *arrays], names)
            number += 1

    return store(map_arrow(docs.select(key, "text"), run, f"block long, keys array<{kind}>, sizes array<long>, term array<long>, count array<int>, spot array<int>", BLOCK_ROWS), "postings", "zstd")


def _blocks(batches) -> Iterator[tuple[int, pa.Array, Block]]:
    """(number, ids, postings) of stored blocks."""
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda n: column(batch, n)[r].values  # noqa: B023, E731
            yield column(batch, "block")[r].as_py(), get("keys"), Block(get("sizes").to_numpy(), get("term").to_numpy().view(np.uint64), get("count").to_numpy().astype(np.int64), get("spot").to_numpy().astype(np.int64))


def _frequencies(counted: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each term from rows (term, n); as many numbers as the pass has terms."""
    out = np.zeros(terms, np.int64)
    for t, n in counted.groupBy("term").agg(F.sum("n")).collect():
        out[t] = n
    return out


def _counting(vocabulary, blocks_of):
    """A task's counts of the terms of a vocabulary."""

    def run(batches):
        total = np.zeros(len(vocabulary.value), np.int64)
        for block in blocks_of(batches):
            own, here = block.own(vocabulary.value)
            total[own] += block.count[here]
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["term", "n"])

    return run


def _united(spot: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the union of the spans."""
    order = np.argsort(spot, kind="stable")
    a, b = spot[order], np.maximum.accumulate((spot + size)[order])
    new = np.r_[True, a[1:] > b[:-1]]
    return a[new], b[np.r_[new[1:], True]]


def matches(blocks: DataFrame, queries: Queries, key: str = "doc_id", proximity: bool = True) -> DataFrame:
    """(block, place, key, n_words, n_hit, items, near, starts, ends) of every document.

    items: with occurring windows; near: with their rarest terms close together; starts, ends: the words that windows cover.
    """
    sc = blocks.sparkSession.sparkContext
    vocabulary = sc.broadcast(queries.terms)
    counted = map_arrow(blocks.select("block", "keys", "sizes", "term", "count", "spot"), _counting(vocabulary, lambda batches: (b for _, _, b in _blocks(batches))), "term int, n long", 1)
    held = sc.broadcast(queries.ready(_frequencies(counted, len(queries.terms))))
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    names = ["block", "place", key, "n_words", "n_hit", "items", "near", "starts", "ends"]

    def run(batches):
        q = held.value
        for number, keys, block in _blocks(batches):
            n = len(block.sizes)
            hit, items, close, starts, ends = np.zeros(n, np.int64), *([[] for _ in range(n)] for _ in range(4))
            window, spot = exact(block, q)
            doc = block.documents(spot) if len(spot) else spot
            order = np.argsort(doc, kind="stable")
            doc, window, spot = doc[order], window[order], spot[order]
            edges = np.nonzero(np.r_[True, doc[1:] != doc[:-1]])[0].tolist() if len(doc) else []
            for a, b in zip(edges, [*edges[1:], len(doc)], strict=False):
                d = int(doc[a])
                s, e = _united(spot[a:b] - block.first[d], q["sizes"][window[a:b]])
                hit[d], starts[d], ends[d] = int((e - s).sum()), s.tolist(), e.tolist()
                items[d] = sorted({q["items"][i] for w in np.unique(window[a:b]).tolist() for i in q["owners"][w]})
            if proximity:
                for d, i in near(block, q):
                    close[d].append(q["items"][i])
            words, longs = pa.list_(pa.string()), pa.list_(pa.int64())
            arrays = [pa.array(np.full(n, number)), pa.array(np.arange(n)), keys, pa.array(block.sizes), pa.array(hit), pa.array(items, words), pa.array([sorted(set(c)) for c in close], words), pa.array(starts, longs), pa.array(ends, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return map_arrow(blocks, run, f"block long, place long, `{key}` {kind}, n_words long, n_hit long, items array<string>, near array<string>, starts array<long>, ends array<long>", 1)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items in proximity) of every document."""
    passes = _passes(benchmark, window)
    queries, more = next(passes), next(passes, None)
    blocks = index(docs, key)
    found = matches(blocks, queries, key) if more is None else _merged(blocks, chain([queries, more], passes), key)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def _merged(blocks: DataFrame, passes: Iterator[Queries], key: str) -> DataFrame:
    """(key, n_words, n_hit, items, near) of every document over several passes.

    A document is known by its block and its place there, so repeated ids stay rows of their own; covered words
    and items are united by document.
    """
    hits = None
    for queries in passes:
        part = store(matches(blocks, queries, key).where("n_hit > 0 OR size(near) > 0").select("block", "place", "items", "near", "starts", "ends"), "matches", "zstd")
        hits = part if hits is None else hits.unionByName(part)
    united = lambda c: F.flatten(F.collect_list(c))
    spans = F.arrays_zip("starts", "ends")
    names = lambda c: F.array_sort(F.array_distinct(united(c))).alias(c)
    hits = hits.groupBy("block", "place").agg(names("items"), names("near"), F.array_sort(united(spans)).alias("spans"))
    # spans in order: each adds the words beyond the furthest end so far
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(x["starts"], s["end"]))).alias("n"), F.greatest(s["end"], x["ends"]).alias("end"))
    hits = hits.select("block", "place", "items", "near", F.aggregate("spans", state, step, lambda s: s["n"]).alias("n_hit"))
    none = F.array().cast("array<string>")
    rows = blocks.select("block", F.posexplode(F.arrays_zip("keys", "sizes")).alias("place", "x"))
    rows = rows.select("block", F.col("place").cast("long").alias("place"), F.col("x.keys").alias(key), F.col("x.sizes").alias("n_words"))
    return rows.join(hits, ["block", "place"], "left").select(key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def _passes(benchmark: DataFrame, window: int) -> Iterator[Queries]:
    """Queries of the benchmark's distinct items, in parts of at most PASS_TERMS words; at least one.

    Items come to the driver one by one; a part is what it holds and sends at once.
    """
    part, held, given = [], 0, False
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        n = len(text.split())
        if part and held + n > PASS_TERMS:
            yield Queries(part, window)
            part, held, given = [], 0, True
        part.append((item, text))
        held += n
    if part or not given:
        yield Queries(part, window)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without an occurring window, all columns as they are.

    Rows never leave their task: one map counts the terms, another indexes each block in memory,
    intersects, and lets the rows without a match through.
    """
    sc = docs.sparkSession.sparkContext
    for queries in _passes(benchmark, window):
        if not queries.windows:
            continue
        vocabulary = sc.broadcast(queries.terms)
        counted = map_arrow(docs.select("text"), _counting(vocabulary, lambda batches: (Block.of(column(b, "text")) for b in batches)), "term int, n long", BLOCK_ROWS)
        held = sc.broadcast(queries.ready(_frequencies(counted, len(queries.terms))))

        def keep(batches, held=held):
            for batch in batches:
                block = Block.of(column(batch, "text"))
                _, spot = exact(block, held.value)
                free = np.ones(batch.num_rows, bool)
                free[block.documents(spot)] = False
                yield batch.filter(pa.array(free))

        docs = map_arrow(docs, keep, docs.schema, BLOCK_ROWS)
    return docs

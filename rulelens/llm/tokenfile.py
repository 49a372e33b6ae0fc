"""Token-id files: adaptive context-mixing range coding in checksummed, independent blocks.

A block holds whole documents. Its ids are dealt to lanes (contiguous runs) that are coded in
lockstep, so one model, shared by the lanes and adapted after every step, serves thousands of
ids per vector operation. Order 2 and order 1 predict the id that they saw last in the context, with a
confidence; adaptive chances of both, by their confidences, are mixed logistically, in whole numbers, into the chances
that it is the one or the other, and order 0 is a distribution over all ids that shares the rest. One step of a
range coder with carries, one per lane, codes which order it is, a second one the id by order 0. The coder
writes 16-bit words. Encoder and decoder run the same code, so they can't drift apart.

Block: MAGIC, crc32 of all that follows, then zlib-packed head (ids of documents, id counts,
words per lane), then the lanes' words. Blocks start from an empty model and raise ValueError
when damaged. `write` stores blocks as rows of Parquet in ascending order of documents
(part, first), the safe way to write files from many executors; `encode_block` and
`decode_block` are the format itself.

Null and empty texts have the end id alone. Null ids come first. Repeated rows are kept, in any
order among equals. An empty table gives no block. Only the named columns are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowio import column, map_arrow, store, texts
from .tokens import encoder

MAGIC = b"RLTC"
END = 2
#: Ids of a block (whole documents; a longer document is a block of its own), lanes, and least ids of a lane.
BLOCK_IDS = 1 << 21
LANES, LEAST = 8192, 64
#: The order-0 table is refreshed after the first, second, fourth and then every REFRESH-th step; its counts add up to 2 ** SCALE.
REFRESH, SCALE = 8, 22
_ORDER2 = 18
_LOW = np.uint64((1 << 48) - 1)
_W16, _W32, _SCALE = np.uint64(16), np.uint64(32), np.uint64(SCALE)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch of 12-bit chances, and squash of its sums (both whole numbers, made without rounding modes of a machine)."""
    squash = np.array([round(65536 / (1 + 2.718281828459045 ** (-x / 256))) for x in range(-2047, 2048)], np.int64).clip(32, 65536 - 32)
    at = np.arange(4096) * 16 + 8
    return np.searchsorted(squash, at).astype(np.int64).clip(0, 4094) - 2047, squash


_STRETCH, _SQUASH = _tables()
#: Confidence after a hit and after a miss, in place above the id.
_UP = (np.minimum(np.arange(16) + 1, 15) << 16).astype(np.int32)
_DOWN = (np.arange(16) >> 1 << 16).astype(np.int32)


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _LOW, np.uint64)
        self.out = np.zeros((lanes, 3 * steps + 8), np.int32)
        self.at = np.zeros(lanes, np.int64)

    def _narrow(self, lanes, cum: np.ndarray, freq: np.ndarray, shift: np.uint64) -> None:
        r = self.range[lanes] >> shift
        low = self.low[lanes] + cum.view(np.uint64) * r
        r *= freq.view(np.uint64)
        over = low > _LOW
        if over.any():
            low &= _LOW
            who = np.nonzero(over)[0] if isinstance(lanes, slice) else lanes[over]
            p = self.at[who] - 1
            self.out[who, p] += 1
            while (full := self.out[who, p] > 65535).any():
                who, p = who[full], p[full]
                self.out[who, p] = 0
                p = p - 1
                self.out[who, p] += 1
        short = np.nonzero(r < np.uint64(1 << 32))[0]
        if len(short):
            who = short if isinstance(lanes, slice) else lanes[short]
            self.out[who, self.at[who]] = (low[short] >> _W32).astype(np.int32)
            self.at[who] += 1
            low[short] = (low[short] << _W16) & _LOW
            r[short] <<= _W16
        self.low[lanes], self.range[lanes] = low, r

    def which(self, lanes, first: np.ndarray, second: np.ndarray, choice: np.ndarray) -> np.ndarray:
        """Code 0, 1 or 2, of which 0 ends at chance first and 1 at second (of 2 ** 16)."""
        cum = np.where(choice == 0, 0, np.where(choice == 1, first, second))
        end = np.where(choice == 0, first, np.where(choice == 1, second, 65536))
        self._narrow(lanes, cum, end - cum, _W16)
        return choice

    def symbol(self, lanes: np.ndarray, table: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """Code sym by the cumulative counts table[sym], table[sym + 1]."""
        cum = table[sym]
        self._narrow(lanes, cum, table[sym + 1] - cum, _SCALE)
        return sym

    def words(self) -> list[np.ndarray]:
        for k in (32, 16, 0):
            self.out[np.arange(len(self.at)), self.at] = ((self.low >> np.uint64(k)) & np.uint64(65535)).astype(np.int32)
            self.at += 1
        return [o[:n].astype("<u2") for o, n in zip(self.out, self.at, strict=True)]


class _Decoder:
    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words = np.r_[words.astype(np.uint64), np.zeros(4, np.uint64)]
        self.at = np.r_[0, np.cumsum(counts)][:-1].astype(np.int64)
        self.range = np.full(len(counts), _LOW, np.uint64)
        self.code = self.words[self.at] << _W32 | self.words[self.at + 1] << _W16 | self.words[self.at + 2]
        self.at += 3
        self.table = self.first = None

    def _narrow(self, lanes, r: np.ndarray, cum: np.ndarray, freq: np.ndarray) -> None:
        code = self.code[lanes] - cum.view(np.uint64) * r
        r = r * freq.view(np.uint64)
        short = np.nonzero(r < np.uint64(1 << 32))[0]
        if len(short):
            who = short if isinstance(lanes, slice) else lanes[short]
            code[short] = code[short] << _W16 | self.words[np.minimum(self.at[who], len(self.words) - 1)]
            self.at[who] += 1
            r[short] <<= _W16
        self.code[lanes], self.range[lanes] = code, r

    def _value(self, lanes, shift: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        r = self.range[lanes] >> shift
        return r, np.minimum(self.code[lanes] // r, (np.uint64(1) << shift) - np.uint64(1)).view(np.int64)

    def which(self, lanes, first: np.ndarray, second: np.ndarray, choice: None) -> np.ndarray:
        r, v = self._value(lanes, _W16)
        choice = (v >= first).astype(np.int64) + (v >= second)
        cum = np.where(choice == 0, 0, np.where(choice == 1, first, second))
        end = np.where(choice == 0, first, np.where(choice == 1, second, 65536))
        self._narrow(lanes, r, cum, end - cum)
        return choice

    def symbol(self, lanes: np.ndarray, table: np.ndarray, sym: None) -> np.ndarray:
        r, v = self._value(lanes, _SCALE)
        if self.table is not table:
            # the first id that may hold a value, by its leading bits
            self.table, self.first = table, np.searchsorted(table, np.arange(1 << SCALE - 10) << 10, "right") - 1
        sym = self.first[v >> 10]
        late = np.nonzero(table[sym + 1] <= v)[0]
        for _ in range(3):
            if not len(late):
                break
            sym[late] += 1
            late = late[table[sym[late] + 1] <= v[late]]
        if len(late):
            sym[late] = np.searchsorted(table, v[late], "right") - 1
        sym = np.minimum(sym, 65535)
        cum = table[sym]
        self._narrow(lanes, r, cum, table[sym + 1] - cum)
        return sym


class _Mixer:
    """Chance of a hit for each pair of confidences (s1 << 4 | s2): one context's, both's and the chance in all, mixed.

    All lanes with one pair of confidences have one chance, so tables are mixed and learned, not lanes.
    """

    def __init__(self, axis: int):
        # the axis of the (s1, s2) table along which the one context's confidence does not change
        self.axis = axis
        self.chance = [np.full(n, 32768, np.int64) for n in ((1, 16) if axis == 0 else (16, 1), (16, 16), (1, 1))]
        self.weight = [90, 90, 40]

    def table(self) -> np.ndarray:
        total = sum(_STRETCH[p >> 4] * w for p, w in zip(self.chance, self.weight, strict=True)) >> 7
        self.mixed = _SQUASH[np.minimum(np.maximum(total, -2047), 2047) + 2047]
        return self.mixed

    def update(self, count: np.ndarray, hits: np.ndarray) -> None:
        """Learn from how often each pair of confidences came up, and was right."""
        n = max(1, int(count.sum()))
        error = (hits << 16) - count * self.mixed
        for k, p in enumerate(self.chance):
            along = (self.axis, (), (0, 1))[k]
            c, h, e = (x.sum(along, keepdims=True) if k != 1 else x for x in (count, hits, error))
            if k < 2:
                self.weight[k] = min(400, max(0, self.weight[k] + int((_STRETCH[p >> 4] * e).sum()) // n // 65536))
            p += ((h << 16) - c * p) // (c + 24)
            self.chance[k] = np.minimum(np.maximum(p, 64), 65536 - 64)


def _cumulative(counts: np.ndarray) -> np.ndarray:
    """Cumulative counts of all ids, each at least 1, to at most 2 ** SCALE."""
    total = int(counts.sum())
    freq = 1 + counts * ((1 << SCALE) - 65536) // total if total else np.full(65536, (1 << SCALE) // 65536, np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(freq)])


def _code(coder, n: int, lanes: int, steps: int, ids: np.ndarray | None) -> np.ndarray:
    """Run the model over n ids in lanes; ids: what to encode, or None to decode."""
    grid = np.zeros((steps, lanes), np.int64)
    if ids is not None:
        full = np.zeros(steps * lanes, np.int64)
        full[:n] = ids
        grid = np.ascontiguousarray(full.reshape(lanes, steps).T)
    rest = n - (lanes - 1) * steps
    # id, and above it how sure it is
    order1, order2 = np.zeros(1 << 16, np.int32), np.zeros(1 << _ORDER2, np.int32)
    hit2, hit1 = _Mixer(0), _Mixer(1)
    times = lambda x: np.bincount(x, minlength=256).reshape(16, 16)
    counts = np.zeros(1 << 16, np.int64)
    order0 = _cumulative(counts)
    seen: list[np.ndarray] = []
    before1 = np.zeros(lanes, np.int64)
    before2 = np.zeros(lanes, np.int64)
    for t in range(steps):
        active = lanes if t < rest else lanes - 1
        if not active:
            break
        p1, p2 = before1[:active], before2[:active]
        slot = ((p2 * 40503 + p1) * 2654435761 >> 7) & ((1 << _ORDER2) - 1)
        e1, e2 = order1[p1], order2[slot]
        c1, s1, c2, s2 = e1 & 65535, e1 >> 16, e2 & 65535, e2 >> 16
        both = (s1 << 4) + s2
        # what followed the last two ids; what followed the last one, where that differs; or any id
        one = hit2.table()
        two = (one + np.maximum((65536 - one) * hit1.table() >> 16, 1)).ravel()
        one = one.ravel()
        differs = c1 != c2
        first = one[both]
        second = np.where(differs, two[both], first)
        actual = grid[t, :active] if ids is not None else None
        choice = coder.which(slice(0, active), first, second, np.where(actual == c2, 0, np.where(differs & (actual == c1), 1, 2)) if ids is not None else None)
        hit2.update(times(both), times(both[choice == 0]))
        hit1.update(times(both[differs & (choice > 0)]), times(both[choice == 1]))
        value = np.where(choice == 0, c2, c1).astype(np.int64)
        lit = np.nonzero(choice == 2)[0]
        if len(lit):
            value[lit] = coder.symbol(lit, order0, actual[lit] if ids is not None else None)
            seen.append(value[lit])
        grid[t, :active] = value
        # a context keeps its id while it is confirmed more often than missed
        new = value.astype(np.int32)
        for table, at, c, e, sure in ((order1, p1, c1, e1, s1), (order2, slot, c2, e2, s2)):
            kept = np.where(e >= 131072, c + _DOWN[sure], new + 65536)
            right = np.nonzero(new == c)[0]
            kept[right] = c[right] + _UP[sure[right]]
            table[at] = kept
        before2[:active] = p1
        before1[:active] = value
        if seen and (t + 1) % REFRESH == 0 or t in (0, 1, 3):
            counts += np.bincount(np.concatenate(seen), minlength=1 << 16) if seen else 0
            order0 = _cumulative(counts)
            seen = []
    return grid.T.ravel()[:n] if ids is None else grid


def encode_block(keys: list, lengths: np.ndarray, ids: np.ndarray, first: int = 0) -> bytes:
    """A block of documents: their keys (whole numbers or None), id counts, and ids (below 65,536)."""
    n = len(ids)
    lanes = max(1, min(LANES, n // LEAST))
    steps = -(-n // lanes)
    lanes = -(-n // steps) if n else 0
    words: list[np.ndarray] = []
    if n:
        coder = _Encoder(lanes, steps)
        _code(coder, n, lanes, steps, ids.astype(np.int64))
        words = coder.words()
    nulls = np.packbits(np.array([k is None for k in keys], bool))
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    head = struct.pack("<QIIII", first, len(keys), n, lanes, steps if n else 0) + nulls.tobytes() + numbers.tobytes() + lengths.astype("<u4").tobytes() + np.array([len(w) for w in words], "<u4").tobytes()
    head = zlib.compress(head, 6)
    body = struct.pack("<I", len(head)) + head + b"".join(w.tobytes() for w in words)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def decode_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """(keys, id counts, ids, first) of a block; ValueError if it is damaged."""
    if data[:4] != MAGIC or len(data) < 12 or zlib.crc32(data[8:]) != struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("not a block, or a damaged one")
    size = struct.unpack_from("<I", data, 8)[0]
    head = zlib.decompress(data[12 : 12 + size])
    first, docs, n, lanes, steps = struct.unpack_from("<QIIII", head)
    at = struct.calcsize("<QIIII")
    nulls = np.unpackbits(np.frombuffer(head, np.uint8, -(-docs // 8), at))[:docs]
    at += -(-docs // 8)
    numbers = np.frombuffer(head, "<i8", docs, at)
    lengths = np.frombuffer(head, "<u4", docs, at + 8 * docs).astype(np.int64)
    counts = np.frombuffer(head, "<u4", lanes, at + 12 * docs).astype(np.int64)
    ids = np.zeros(0, np.int64)
    if n:
        ids = _code(_Decoder(np.frombuffer(data, "<u2", int(counts.sum()), 12 + size), counts), n, lanes, steps, None)
    keys = [None if z else k for z, k in zip(nulls.tolist(), numbers.tolist(), strict=True)]
    return keys, lengths, ids, first


def write(docs: DataFrame, vocabulary: str, spaced: bool, end: int = END, key: str = "doc_id") -> DataFrame:
    """(part, first, ids, block) in the shared folder: all documents in ascending order of key."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(key).cast("long").alias(key), "text").repartitionByRange(parts, F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first())

    def run(batches):
        enc = encoder(vocabulary, spaced)
        part = TaskContext.get().partitionId()
        keys, pieces, held, first = [], [], 0, 0

        def block():
            lengths = np.array([len(p) for p in pieces], np.int64)
            data = encode_block(keys, lengths, np.concatenate(pieces), first)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "first", "ids", "block"])

        for batch in batches:
            for k, found in zip(column(batch, key).to_pylist(), enc.batch(texts(batch)), strict=True):
                ids = np.append(found, np.uint16(end))
                if pieces and held + len(ids) > BLOCK_IDS:
                    yield block()
                    keys, pieces, held, first = [], [], 0, first + held
                keys.append(k)
                pieces.append(ids)
                held += len(ids)
        if pieces:
            yield block()

    return store(map_arrow(ordered, run, "part int, first long, ids long, block binary"), "tokens", "none")


def read(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from its decoded block."""
    # one number per part of the file
    sums = sorted((r[0], r[1]) for r in blocks.groupBy("part").agg(F.sum("ids")).collect())
    offset, total = {}, 0
    for part, n in sums:
        offset[part] = total
        total += n
    held = blocks.sparkSession.sparkContext.broadcast(offset)

    def run(batches):
        for batch in batches:
            for part, data in zip(column(batch, "part").to_pylist(), column(batch, "block").to_pylist(), strict=True):
                keys, lengths, ids, first = decode_block(data)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4")
                crc = [zlib.crc32(flat[b - n : b]) for n, b in zip(lengths.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held.value[part] + first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return map_arrow(blocks.select("part", "block"), run, f"{key} long, start long, n_tokens long, ids_crc32 long", 1)

"""Token ids of whole texts by the tokenizers library, piece by piece.

Both vocabularies cut texts into pieces (letters, digits, other marks, white space) before they
merge, so a text's ids are those of its pieces in turn. Pieces are found for many texts at once
from the classes of their code points, and each distinct piece is merged by the library's model once and
remembered in flat arrays (a bounded number; the rest is merged again). A piece of up to SHORT code points is known by these
themselves, packed into two numbers; a longer one is found by a hash and compared with the code points that are remembered with it.

Texts whose cut could differ go to the library whole: those with an apostrophe (contractions), with
a string of a special token, or with code points outside the ranges below, whose classes,
lower case and normal form are the same in every version of Unicode.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache

import numpy as np

#: Pieces that a worker remembers (some 45 bytes each), and slots of the table that finds them.
REMEMBERED = 1 << 20
_BITS = 21
#: Code points that fit into the two numbers of a key, 16 bits each.
SHORT = 8
#: Code points that are cut at once.
CHUNK = 1 << 19
#: Code points in these ranges may be cut here: Latin, Greek, Cyrillic, and general punctuation.
RANGES = ((0, 0x530), (0x2010, 0x2028), (0x2030, 0x205F))
SPACE, WHITE, LETTER, DIGIT, OTHER, UNSAFE = range(6)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    if c in " \n\t\r":
        return SPACE if c == " " else WHITE
    if c == "'" or c == "Σ" or c.isspace() or kind[0] in "CMZ" or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c:
        return UNSAFE
    return LETTER if kind[0] == "L" else DIGIT if kind[0] == "N" else OTHER


#: The first 0 to 4 code points of a number.
_MASKS = np.array([(1 << 16 * n) - 1 for n in range(5)], np.uint64)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case of each code point (the last entry stands for all beyond), and powers and random values of two hashes."""
    top = RANGES[-1][1]
    classes = np.full(top + 1, UNSAFE, np.uint8)
    lower = np.arange(top + 1, dtype=np.uint32)
    for a, b in RANGES:
        for i in range(a, b):
            classes[i] = _class(chr(i))
            if classes[i] != UNSAFE:
                lower[i] = ord(chr(i).lower())
    bases = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
    back = np.array([pow(int(b), -1, 1 << 64) for b in bases], np.uint64)
    n = CHUNK + 1
    up = np.stack([np.cumprod(np.r_[np.uint64(1), np.full(n, b)]) for b in bases])
    down = np.stack([np.cumprod(np.r_[np.uint64(1), np.full(n, b)]) for b in back])
    values = np.random.default_rng(11).integers(1, 1 << 63, (2, max(top + 1, 0x2100)), dtype=np.uint64)
    return classes, lower, up, down, values


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for count[i] numbers each, one after the other."""
    last = np.cumsum(count)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(first - (last - count), count)


class _Memory:
    """Ids of the pieces met: keys to a place in one pool of ids, and the code points of long pieces."""

    def __init__(self):
        self.slots = np.full(1 << _BITS, -1, np.int32)
        self.keys = np.zeros((2, 1 << 16), np.uint64)
        self.spot = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.letter_spot = np.zeros(1 << 16, np.int64)
        self.letter_size = np.zeros(1 << 16, np.int32)
        self.letters = np.zeros(1 << 18, np.uint16)
        self.n = self.used = self.spelled = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 where there is none."""
        out = np.full(h.shape[1], -1, np.int32)
        live = np.arange(h.shape[1])
        slot = (h[0] >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(live):
            e = self.slots[slot]
            there = e >= 0
            live, slot, e = live[there], slot[there], e[there]
            same = (self.keys[0, e] == h[0, live]) & (self.keys[1, e] == h[1, live])
            out[live[same]] = e[same]
            live, slot = live[~same], (slot[~same] + 1) & ((1 << _BITS) - 1)
        return out

    def add(self, h: np.ndarray, ids: list[bytes], spelling: np.ndarray, lengths: np.ndarray, keep: int) -> np.ndarray:
        """Entries of new pieces; the first `keep` can be found from now on. spelling: the code points of long pieces, lengths: how many (0 for short ones)."""
        n = len(ids)
        sizes = np.array([len(x) >> 1 for x in ids], np.int32)
        flat = np.frombuffer(b"".join(ids), np.uint16)
        while self.n + n > len(self.spot):
            self.keys, self.spot, self.size = np.concatenate([self.keys, self.keys], 1), np.r_[self.spot, self.spot], np.r_[self.size, self.size]
            self.letter_spot, self.letter_size = np.r_[self.letter_spot, self.letter_spot], np.r_[self.letter_size, self.letter_size]
        while self.spelled + len(spelling) > len(self.letters):
            self.letters = np.r_[self.letters, self.letters]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, self.pool]
        entry = np.arange(self.n, self.n + n)
        self.keys[:, entry], self.size[entry] = h, sizes
        self.spot[entry] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.letter_size[entry] = lengths
        self.letter_spot[entry] = self.spelled + np.cumsum(lengths) - lengths
        self.letters[self.spelled : self.spelled + len(spelling)] = spelling
        wait, slot = entry[:keep], (h[0, :keep] >> np.uint64(64 - _BITS)).astype(np.int64)
        while len(wait):
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(wait), bool)
            won[first] = self.slots[slot[first]] < 0
            self.slots[slot[won]] = wait[won]
            wait, slot = wait[~won], (slot[~won] + 1) & ((1 << _BITS) - 1)
        self.n += n
        self.used += len(flat)
        self.spelled += len(spelling)
        return entry

    def differ(self, entry: np.ndarray, spelling: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which long pieces aren't those of their entries."""
        wrong = self.letter_size[entry] != lengths
        same = np.repeat(~wrong, lengths)
        stored = self.letters[_ranges(self.letter_spot[entry][~wrong], lengths[~wrong])]
        owner = np.repeat(np.flatnonzero(~wrong), lengths[~wrong])
        wrong[owner[stored != spelling[same]]] = True
        return wrong

    def shrink(self, entries: int) -> None:
        """Forget what came after so many entries (those that can't be found)."""
        if self.n > entries:
            self.used, self.spelled, self.n = int(self.spot[entries]), int(self.letter_spot[entries]), entries


class Encoder:
    """ids of texts as uint16; spaced: whether a word's leading space is part of it (byte-level vocabularies).

    special: whether strings of special tokens in a text are those tokens, as the library has it.
    """

    def __init__(self, path: str, spaced: bool, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("more ids than 16 bits hold")
        self.model, self.spaced = self.tokenizer.model, spaced
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.letters = _byte_letters()
        self.written = str.maketrans({i: "".join(self.letters[b] for b in chr(i).encode()) for a, b in RANGES for i in range(a, b)})
        self.memory = _Memory()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, values: list) -> list[np.ndarray]:
        """ids of each text; null counts as empty."""
        out: list = []
        group: list[str] = []
        held = 0
        for t in values:
            t = t or ""
            if len(t) > CHUNK:
                out += self._cut(group) if group else []
                group, held = [], 0
                out.append(self._long(t))
                continue
            if held + len(t) > CHUNK:
                out += self._cut(group)
                group, held = [], 0
            group.append(t)
            held += len(t)
        return out + (self._cut(group) if group else [])

    def _long(self, text: str) -> np.ndarray:
        """A text of more than CHUNK code points, in parts that begin with a single space between other characters."""
        if any(s in text for s in self.special):
            return self.whole(text)
        parts, a = [], 0
        while len(text) - a > CHUNK:
            b = text.rfind(" ", a + 1, a + CHUNK)
            while b > a and (text[b - 1].isspace() or text[b + 1].isspace() or ord(text[b - 1]) >= RANGES[0][1] or ord(text[b + 1]) >= RANGES[0][1]):
                b = text.rfind(" ", a + 1, b)
            if b <= a:
                return self.whole(text)
            parts.append(text[a:b])
            a = b
        return np.concatenate([self._cut([p])[0] for p in [*parts, text[a:]]])

    def _cut(self, texts: list[str]) -> list[np.ndarray]:
        classes, lower, up, down, values = _tables()
        joined = "".join(texts)
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        if not len(joined):
            return [np.zeros(0, np.uint16)] * len(texts)
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), len(classes) - 1)
        kind = classes[codes]
        text = np.repeat(np.arange(len(texts)), size)
        unsafe = np.zeros(len(texts), bool)
        unsafe[text[kind == UNSAFE]] = True
        if any(s in joined for s in self.special):
            unsafe |= [any(s in t for s in self.special) for t in texts]
        white = kind <= WHITE
        begin = np.zeros(len(codes) + 1, bool)
        begin[(ends - size)[size > 0]] = True
        start = begin[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.spaced:
            # a run of white space is one piece but for its last character, which a space gives to what follows
            follows = np.r_[~white[1:] & ~begin[1:-1], False]
            start[1:] &= ~(white[1:] & white[:-1]) | begin[1:-1]
            start |= white & follows
            start[1:] &= ~(~white[1:] & (kind[:-1] == SPACE)) | begin[1:-1]
        else:
            codes = lower[codes]
            start |= kind == DIGIT
        at = np.nonzero(start)[0]
        to = np.r_[at[1:], len(codes)]
        keep = ~unsafe[text[at]] if self.spaced else ~unsafe[text[at]] & ~white[at]
        at, to = at[keep], to[keep]
        own = text[at]
        length = to - at
        long = np.nonzero(length > SHORT)[0]
        # four code points (plus one, so none is 0) in a number, from every place on
        lanes = np.zeros(len(codes) + SHORT, np.uint64)
        lanes[: len(codes)] = codes.astype(np.uint64) + np.uint64(1)
        four = lanes[:-3] | lanes[1:-2] << np.uint64(16) | lanes[2:-1] << np.uint64(32) | lanes[3:] << np.uint64(48)
        h = np.stack([four[at] & _MASKS[np.minimum(length, 4)], four[at + 4] & _MASKS[np.clip(length - 4, 0, 4)]])
        if len(long):
            for k in (0, 1):
                sums = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(values[k][codes] * up[k][: len(codes)], out=sums[1:])
                # no short key has the highest bit
                h[k, long] = (sums[to[long]] - sums[at[long]]) * down[k][at[long]] | np.uint64(1 << 63)
        # one to one, so short keys stay exact
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h[0] ^= (h[1] << np.uint64(17)) | (h[1] >> np.uint64(47))
        memory = self.memory
        entry = memory.find(h)
        missing = np.nonzero(entry < 0)[0]
        known = memory.n
        if len(missing):
            _, first, back = np.unique(h[0, missing], return_index=True, return_inverse=True)
            pieces = missing[first]
            if (h[1, missing] != h[1, pieces][back]).any():  # one hash, two pieces
                first, back = np.arange(len(missing)), np.arange(len(missing))
                pieces = missing
            tokenize, written = self.model.tokenize, self.written
            ids = []
            source = joined if self.spaced else codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for a, b in zip(at[pieces].tolist(), to[pieces].tolist(), strict=True):
                ids.append(array("H", [t.id for t in tokenize(source[a:b].translate(written))]).tobytes())
            room = max(0, REMEMBERED - memory.n)
            spelled = np.where(length[pieces] > SHORT, length[pieces], 0)
            entry[missing] = memory.add(h[:, pieces], ids, codes[_ranges(at[pieces], spelled)], spelled, min(room, len(ids)))[back]
            known = min(memory.n, max(known, REMEMBERED))
        if len(long):
            # two long pieces of one hash: the library gets their texts whole
            wrong = memory.differ(entry[long], codes[_ranges(at[long], length[long])], length[long])
            unsafe[own[long[wrong]]] = True
        count = memory.size[entry].astype(np.int64)
        flat = memory.pool[_ranges(memory.spot[entry], count)]
        memory.shrink(known)
        per_text = np.bincount(own, count, len(texts)).astype(np.int64)
        edge = np.cumsum(per_text)
        return [self.whole(t) if bad else flat[b - n : b] for t, bad, b, n in zip(texts, unsafe.tolist(), edge.tolist(), per_text.tolist(), strict=True)]


@lru_cache(4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, spaced)

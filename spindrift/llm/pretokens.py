"""Splits text as the byte-level pattern does, over whole arrays of code points.

The pattern is fixed by the vocabulary file: contractions, then an optional
space before letters, numbers or other signs, then white space, the last of
which goes with what follows. Here a piece starts where the class of characters
changes; a few corrections move starts for spaces and contractions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

from spindrift.llm.common import Table, span_hash, spans_equal, spread

# White space of the pattern's \s.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What follows an apostrophe in the pattern's contractions.
SHORT, LONG = "stmd", ("re", "ve", "ll")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
SPECIAL = "<|endoftext|>"
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _classes:
        out = np.full(0x110000, OTHER, np.uint8)
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, points):
                for c in m[0]:
                    out[ord(c)] = kind
        out[WHITE] = SPACE
        _classes.append(out)
    return _classes[0]


def starts_of(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Marks each code point at which a piece starts. doc_starts: where texts start, ascending, all below len(points)."""
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 3, bool)
    first[doc_starts] = True
    first[n:] = True
    change = first[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = change.copy()
    i = np.flatnonzero(change & ~first[:n] & (kind != SPACE))
    i = i[kind[i - 1] == SPACE]
    starts[i - 1] = True
    starts[i] = points[i - 1] != 0x20
    i = np.flatnonzero(change & (points == 0x27))
    i = i[(i + 1 < n)]
    i = i[~first[i + 1]]
    i = i[kind[i + 1] == LETTER]
    i = i[first[i] | (points[i - 1] != 0x20)]
    if len(i):
        a = points[i + 1]
        b = np.where(first[i + 2], 0, points[np.minimum(i + 2, n - 1)])
        one = np.isin(a, [ord(c) for c in SHORT])
        two = np.zeros(len(i), bool)
        for x, y in LONG:
            two |= (a == ord(x)) & (b == ord(y))
        for j in (i[one] + 2, i[two & ~one] + 3):
            starts[j[~first[j]]] = True
        starts[i[one | two] + 1] = False
    return starts


class Pool:
    """Arrays one after another in one that grows and always has some room behind."""

    def __init__(self, kind: type) -> None:
        self.data, self.used, self.n = np.zeros(1 << 16, kind), 0, 0
        self.at, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def add(self, arrays: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, arrays), np.int64, len(arrays))
        got = np.concatenate(arrays)
        if self.used + len(got) + 8 > len(self.data):
            self.data = np.resize(self.data, 2 * (self.used + len(got) + 8))
        if self.n + len(size) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * (self.n + len(size))), np.resize(self.size, 2 * (self.n + len(size)))
        self.data[self.used : self.used + len(got)] = got
        self.at[self.n : self.n + len(size)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.used += len(got)
        self.n += len(size)


class Encoder:
    """Token ids of whole texts; each distinct piece is encoded once and kept in a bounded table.

    encode: pieces (bytes) to arrays of ids. A full table is emptied; results don't depend on it.
    Pieces are found by 64-bit hashes and then compared byte by byte; one whose hash
    belongs to another piece is encoded each time.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], special: int, bits: int = 22) -> None:
        self.encode, self.special, self.bits = encode, special, bits
        self.empty()

    def empty(self, bits: int = 0) -> None:
        self.table, self.known = Table(bits or self.bits), 0
        self.ids, self.letters = Pool(np.int32), Pool(np.uint8)

    def learn(self, pieces: list[bytes], hashes: np.ndarray | None = None) -> np.ndarray:
        """Encodes new pieces; their numbers. Without hashes they can't be found again."""
        self.ids.add(self.encode(pieces))
        self.letters.add([np.frombuffer(p, np.uint8) for p in pieces])
        numbers = np.arange(self.known, self.known + len(pieces), dtype=np.int32)
        self.known += len(pieces)
        if hashes is not None:
            self.table.add(hashes, numbers)
        return numbers

    def numbers(self, data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each piece data[a:b]; new ones are learned."""
        letters = np.frombuffer(data, np.uint8)
        cut = lambda at: [data[x:y] for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)]
        h = span_hash(letters, a, b)
        number = self.table.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            uh, index, back = np.unique(h[new], return_index=True, return_inverse=True)
            if len(uh) > self.table.room or self.known > 1 << self.bits:
                new = np.arange(len(h))
                uh, index, back = np.unique(h, return_index=True, return_inverse=True)
                self.empty(max(self.bits, len(uh).bit_length() + 2))
            number[new] = self.learn(cut(new[index]), uh)[back]
        size = b - a
        same = self.letters.size[number] == size
        at = np.flatnonzero(same)
        same[at] = spans_equal(letters, a[at], self.letters.data, self.letters.at[number[at]], size[at])
        other = np.flatnonzero(~same)
        if len(other):
            number[other] = self.learn(cut(other))
        return number

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        parts, owner, marks = [], [], []
        for k, text in enumerate(texts):
            split = text.split(SPECIAL) if SPECIAL in text else [text]
            for j, part in enumerate(split):
                if j:
                    marks.append((len(parts), k))
                if part:
                    parts.append(part)
                    owner.append(k)
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        counts = np.zeros(len(texts), np.int64)
        if not len(points):
            ids = np.zeros(0, np.int32)
            at_part = np.zeros(1, np.int64)
        else:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts))
            begin = np.cumsum(lengths) - lengths
            s = np.flatnonzero(starts_of(points, begin))
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            to_byte = np.zeros(len(points) + 1, np.int64)
            np.cumsum(width, out=to_byte[1:])
            data = whole.encode()
            a = to_byte[s]
            b = np.append(a[1:], len(data))
            number = self.numbers(data, a, b)
            n = self.ids.size[number]
            ids = self.ids.data[spread(self.ids.at[number], n)]
            part_of = np.searchsorted(begin, s, side="right") - 1
            per_part = np.bincount(part_of, n, len(parts)).astype(np.int64)
            counts += np.bincount(np.array(owner), per_part, len(texts)).astype(np.int64)
            at_part = np.append(0, np.cumsum(per_part))
        if marks:
            ids = np.insert(ids, [at_part[p] for p, _ in marks], self.special)
            np.add.at(counts, [k for _, k in marks], 1)
        return ids, counts

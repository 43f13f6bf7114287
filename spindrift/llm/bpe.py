"""Operator 7: byte-pair encoding and decoding over contiguous rank arrays.

Words of one length are encoded together: a row of part ids per word and, beside
it, a row with the ranks of adjacent parts. Again and again the row is scanned
for its minimum, the boundary there is deleted, and the two neighbouring ranks
are looked up anew. Words over ``LONG_WORD`` bytes, for which scanning would be
quadratic, take the same merges from a heap.

Null texts are empty; an empty text has no ids and decodes to "". The literal
<|endoftext|> in a text is the special id, as in the library. Rows with equal
ids, repeated rows and extra columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices
from spindrift.llm.pretokens import SPECIAL, Encoder

LONG_WORD = 64
NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Merges:
    """A byte-level vocabulary file's ids, and ranks of pairs as sorted arrays."""

    def __init__(self, path: str) -> None:
        model = (whole := json.loads(Path(path).read_text(encoding="utf-8")))["model"]
        letters, vocab = byte_letters(), model["vocab"]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.special = next(x["id"] for x in whole["added_tokens"] if x["content"] == SPECIAL)
        self.strings = [b""] * (max(max(vocab.values()), self.special) + 1)
        for word, i in vocab.items():
            self.strings[i] = bytes(of_letter[c] for c in word)
        self.strings[self.special] = SPECIAL.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # A direct table from hashed pairs to places in key; checked against key, so that clashes only cost a search.
        self.hint = np.full(1 << 20, -1, np.int32)
        self.hint[self.slot(self.key)] = np.arange(len(self.key))

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return (key * np.int64(0x1E35A7BD) >> np.int64(14)) & np.int64((1 << 20) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that never merge."""
        key = a.astype(np.int64) << 20 | b
        at = self.hint[self.slot(key)]
        hit = self.key[at] == key
        out = np.where(hit, self.rank[at], NONE)
        miss = np.flatnonzero(~hit & (at >= 0))
        if len(miss):
            at = np.minimum(np.searchsorted(self.key, key[miss]), len(self.key) - 1)
            out[miss] = np.where(self.key[at] == key[miss], self.rank[at], NONE)
        return out

    def words(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length, a row of byte ids each."""
        n, length = ids.shape
        out: list[np.ndarray | None] = [None] * n
        left, ids = np.arange(n), ids.copy()
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1) if length > 1 else np.zeros((n, 0), np.int32)
        size = np.full(n, length)
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            low = rank[np.arange(len(left)), at]
            over = low == NONE
            if over.any():
                for k, row, m in zip(left[over].tolist(), ids[over], size[over].tolist(), strict=True):
                    out[k] = row[:m]
                keep = ~over
                left, ids, rank, size, at, low = left[keep], ids[keep], rank[keep], size[keep], at[keep], low[keep]
            if not len(left):
                break
            rows = np.arange(len(left))
            ids[rows, at] = self.made[low]
            # Delete the boundary after ``at``: everything behind it moves one place to the left.
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
            size -= 1
            if rank.shape[1] == 1:
                rank = rank[:, :0]
                break
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            has = at < size - 1
            rank[rows[has], at[has]] = self.ranks(ids[rows[has], at[has]], ids[rows[has], at[has] + 1])
            has = at > 0
            rank[rows[has], at[has] - 1] = self.ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
            past = np.arange(rank.shape[1]) >= (size - 1)[:, None]
            rank[past] = NONE
        for k, row, m in zip(left.tolist(), ids, size.tolist(), strict=True):
            out[k] = row[:m]
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """The same merges, least rank and then leftmost first, from a heap over linked parts."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (new := int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])) != NONE:
                    heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def __call__(self, pieces: list[bytes]) -> list:
        """Ids of each piece, pieces of one length at a time."""
        out: list = [None] * len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for length in np.unique(size).tolist():
            at = np.flatnonzero(size == length)
            if length > LONG_WORD:
                for k in at.tolist():
                    out[k] = self.long_word(pieces[k])
                continue
            for part in np.array_split(at, -(-len(at) // (1 << 15))):
                block = np.frombuffer(b"".join(pieces[k] for k in part.tolist()), np.uint8).reshape(len(part), length)
                for k, got in zip(part.tolist(), self.words(self.byte_id[block]), strict=True):
                    out[k] = got
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        s = self.strings
        return b"".join([s[i] for i in ids]).decode(errors="replace")


_kept: dict[str, tuple[Merges, Encoder]] = {}


def encoder(path: str) -> tuple[Merges, Encoder]:
    """One for each worker process and file."""
    if path not in _kept:
        _kept[path] = ((m := Merges(path)), Encoder(m, m.special, bits=20))
    return _kept[path]


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", exact: str = "") -> DataFrame:
    """df with a list of int ids in column ``to`` and, if named, whether they decode to the text in column ``exact``; columns of those names are replaced."""
    df = df.drop(to, exact)
    schema = df.select("*", F.lit(None).cast("array<int>").alias(to), *([F.lit(True).alias(exact)] if exact else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, of = encoder(path)
        for part in slices(batches, text, 1 << 20):
            texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            ids, counts = of(texts)
            ends = np.append(0, np.cumsum(counts))
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]
            if exact:
                columns.append(pa.array([merges.decode(ids[a:b].tolist()) == x for x, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the text of the ids; null ids are null."""
    df = df.drop(to)
    schema = df.withColumn(to, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else merges.decode(x) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, path: str) -> DataFrame:
    """Digests of encode and decode in one pass, for documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, of = encoder(path)
        for part in slices(batches):
            ids, counts = of([x or "" for x in part.column(1).to_pylist()])
            ends = np.cumsum(counts).tolist()
            raw, as_list = ids.astype("<u4").tobytes(), ids.tolist()
            spans = list(zip([0, *ends[:-1]], ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(merges.decode(as_list[a:b]).encode()).hexdigest() for a, b in spans]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(run, DIGEST)

"""Operator 2: repeated byte spans by distributed prefix-free parsing.

A string of ``SPAN`` bytes (a window) is repeated if it also starts earlier in the
corpus order (by doc_id, then by place). Each window's trigger is the least rolling
hash of its ``GRAM``-byte strings, so equal windows have equal triggers at equal
places. Neighbouring windows with one trigger form a phrase, which reaches over
all their bytes: a text is parsed to overlapping phrases.

Dictionary: of the equal phrases of a slice of texts, all but the first in corpus order
are settled at once, so that a passage of many texts is one row a slice. The others
meet under their trigger, in corpus order; every later occurrence repeats the first as
a whole, which settles nearly all of a repetitive corpus at one row a phrase. Only phrases that share a trigger with a different
phrase can share some windows without sharing all. The first occurrences of those
meet under their trigger, some triggers at a time: a suffix array of this part of
the dictionary, cut at SPAN bytes, gives runs of equal suffixes, and the order of
the parse (document, place) tells the first of each run. No array of the whole
corpus is needed, as equal suffixes have equal triggers. A trigger with over
``CROWD`` phrases isn't gathered: its suffixes are put in the same order by Spark's
sort, dealt out by the suffix, and read as a stream.

Null texts are empty. Texts under SPAN bytes lose nothing. A null doc_id comes
before all others. Equal rows don't repeat each other; rows with equal doc_id and
different texts lose the spans found in either, cut at the shorter. Extra columns
are ignored, or kept by remove().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import chunks_for, flat, rolling_hash, rolling_sums, slices, spread, stored

SPAN, GRAM = 100, 36
GRAMS = SPAN - GRAM + 1
#: Windows that are looked at together; their arrays stay in the CPU's cache.
SEGMENT = 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
FIRST_ID = -(1 << 63)
CROWD = 1 << 14


def parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases as (trigger, phrase hash, number of the text, first window, last window); places count from the text's start."""
    for at in range(0, max(0, len(data) - SPAN + 1), SEGMENT):
        part = data[at : at + SEGMENT + SPAN - 1]
        sums = rolling_sums(part)
        n = len(part) - GRAM + 1
        grams = np.arange(n)
        gram = rolling_hash(sums, grams, grams + GRAM)
        least = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
        have = 1
        while have < GRAMS:
            step = min(have, GRAMS - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        trigger = (least & _PLACE).astype(np.int64)
        starts = np.arange(len(least)) + at
        text = np.searchsorted(offsets, starts, side="right") - 1
        ok = starts + SPAN <= offsets[text + 1]
        new = ok.copy()
        new[1:] &= (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = ok & np.append(~ok[1:] | new[1:], True)
        last = np.flatnonzero(stop)
        of = text[first]
        base = at - offsets[of]
        yield gram[trigger[first]].view(np.int64), rolling_hash(sums, first, last + SPAN).view(np.int64), of, first + base, last + base


PHRASES = "trigger long, phrase long, doc long, windows long"


def phrases(df: DataFrame) -> DataFrame:
    """PHRASES of df (doc, text); windows: first << 32 | last. trigger and phrase are null for one that repeats an earlier one of its slice; one of equal rows stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            docs = part.column(0).to_numpy(zero_copy_only=False)
            found = [(trigger, phrase, docs[of], a << 32 | b) for trigger, phrase, of, a, b in parse(*flat(part.column(1)))]
            if not found:
                continue
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            trigger, phrase, doc, windows = (c[order] for c in columns)
            same = np.append(False, (trigger[1:] == trigger[:-1]) & (phrase[1:] == phrase[:-1]))
            equal = same & np.append(False, (doc[1:] == doc[:-1]) & (windows[1:] == windows[:-1]))
            keep = ~equal
            later = same[keep]
            yield pa.RecordBatch.from_arrays([pa.array(trigger[keep], mask=later), pa.array(phrase[keep], mask=later), pa.array(doc[keep], pa.int64()), pa.array(windows[keep])], names=["trigger", "phrase", "doc", "windows"])

    return df.mapInArrow(run, PHRASES)


#: trigger is null for a phrase that repeats an earlier one.
FOUND = "doc long, windows long, trigger long"


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From PHRASES in order, nulls first: those that repeat an earlier phrase, and first occurrences that share a trigger with another phrase."""
    tail: tuple[np.ndarray, ...] | None = None
    told = False
    for batch in batches:
        settled = batch.column(0).null_count
        if settled:
            yield pa.RecordBatch.from_arrays([batch.column(2)[:settled], batch.column(3)[:settled], pa.nulls(settled, pa.int64())], names=["doc", "windows", "trigger"])
            batch = batch.slice(settled)
        columns = [batch.column(i).to_numpy() for i in range(4)]
        if not len(columns[0]):
            continue
        if tail is not None:
            columns = [np.append(t, c) for t, c in zip(tail, columns, strict=True)]
        trigger, phrase, doc, windows = columns
        new_trigger = np.append(True, trigger[1:] != trigger[:-1])
        new = new_trigger.copy()
        new[1:] |= phrase[1:] != phrase[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeated = ~new & ((doc != doc[first]) | (windows != windows[first]))
        group = np.cumsum(new_trigger) - 1
        many = np.bincount(group, new) > 1
        many[0] |= told
        unsure = new & many[group]
        if tail is not None and told:
            unsure[0] = False
        keep = first[-1]
        tail, told = tuple(c[keep : keep + 1] for c in columns), bool(many[-1])
        rows = repeated | unsure
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(windows[rows]), pa.array(trigger[rows], mask=repeated[rows])], names=["doc", "windows", "trigger"])


PIECES = "trigger long, crowd boolean, doc long, at long, bytes binary"


def pieces(df: DataFrame) -> DataFrame:
    """PIECES, the bytes of phrases, for df (doc, text, found: list of (trigger, crowd, windows))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = flat(part.column(1))
            lists = part.column(2)
            trigger, crowd, packed = lists.flatten().flatten()
            doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            a, b = packed.to_numpy() >> 32, (packed.to_numpy() & 0xFFFFFFFF) + SPAN
            ok = b <= np.diff(offsets)[doc]
            start, length = (a + offsets[doc])[ok], (b - a)[ok]
            cut = data[spread(start, length)]
            keep = pa.array(ok)
            column = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(cut)])
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([trigger.filter(keep), crowd.filter(keep), pa.array(ids[doc[ok]], pa.int64()), pa.array(a[ok]), column], names=["trigger", "crowd", "doc", "at", "bytes"])

    return df.mapInArrow(run, PIECES)


def suffix_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of each suffix by its first SPAN bytes, by doubling; equal beginnings have equal ranks. Behind the end stand zeros."""
    padded = np.append(data, np.zeros(SPAN, np.uint8)).astype(np.uint64)
    key = np.zeros(len(data) + SPAN - 8, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(key)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < SPAN:
        step = min(have, SPAN - have)
        n = len(rank) - step
        rank = np.unique(rank[:n] * (len(rank) + 1) + rank[step : step + n], return_inverse=True)[1].astype(np.int64)
        have += step
    return rank[: len(data)]


def shared_suffixes(doc: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, windows) of the windows of pieces that equal an earlier one among them."""
    size = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    place = spread(offsets[:-1], size)
    of = np.repeat(np.arange(len(doc)), size)
    where = at[of] + place - offsets[of]
    rank = suffix_ranks(data)[place]
    order = np.lexsort((where, doc[of], rank))
    r = rank[order]
    new = np.append(True, r[1:] != r[:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    mark = np.zeros(len(place), bool)
    mark[order] = ~new & ((doc[of][order] != doc[of][first]) | (where[order] != where[first]))
    begin = mark & ~np.append(False, mark[:-1] & (of[1:] == of[:-1]))
    end = mark & ~np.append(mark[1:] & (of[1:] == of[:-1]), False)
    return doc[of[begin]], where[begin] << 32 | where[end]


REPEATED = "doc long, windows long"


def by_suffix_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From PIECES in order of their triggers, whole triggers of about 1 MB at a time: REPEATED rows."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0

    def told(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        data, offsets = flat(table.column("bytes").combine_chunks().view(pa.string()))
        found = shared_suffixes(table.column("doc").to_numpy(), table.column("at").to_numpy(), data, offsets)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["doc", "windows"])

    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            held.append(part)
            bytes_held += part.nbytes
            if bytes_held < 1 << 20:
                continue
            table = pa.Table.from_batches(held)
            trigger = table.column("trigger").to_numpy()
            k = int(np.searchsorted(trigger, trigger[-1]))
            if k:
                yield told(table.slice(0, k))
            held = table.slice(k).to_batches()
            bytes_held = sum(x.nbytes for x in held)
    if held:
        yield told(pa.Table.from_batches(held))


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """suffix, doc, at: the windows of PIECES, one row each."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            data, offsets = flat(part.column(4).view(pa.string()))
            size = np.maximum(np.diff(offsets) - SPAN + 1, 0)
            place, of = spread(offsets[:-1], size), np.repeat(np.arange(part.num_rows), size)
            if not len(place):
                continue
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, SPAN)[place])
            column = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer((np.arange(len(place) + 1) * SPAN).astype(np.int32)), pa.py_buffer(rows)])
            yield pa.RecordBatch.from_arrays([column, pa.array(part.column(2).to_numpy()[of]), pa.array(part.column(3).to_numpy()[of] + place - offsets[of])], names=["suffix", "doc", "at"])


def equal_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From suffixes in order: doc and windows of those that equal an earlier one."""
    last: tuple[bytes, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        data, _ = flat(batch.column(0).view(pa.string()))
        rows = data.reshape(-1, SPAN)
        doc, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if last is not None:
            rows, doc, at = np.concatenate([np.frombuffer(last[0], np.uint8)[None], rows]), np.append(last[1], doc), np.append(last[2], at)
        new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeated = ~new & ((doc != doc[first]) | (at != at[first]))
        k = int(first[-1])
        last = rows[k].tobytes(), int(doc[k]), int(at[k])
        yield pa.RecordBatch.from_arrays([pa.array(doc[repeated]), pa.array(at[repeated] << 32 | at[repeated])], names=["doc", "windows"])


def repeated_windows(df: DataFrame) -> DataFrame:
    """doc, windows: all repeated windows of df (doc, text) as ranges first << 32 | last, which may overlap."""
    # A partition for about 4 MB of files: some 25 rows of 40 bytes for each KB of text.
    n = chunks_for(df, 4 << 20)
    ordered = phrases(df).repartition(n, F.coalesce("trigger", F.xxhash64("doc", "windows"))).sortWithinPartitions("trigger", "phrase", "doc", "windows")
    found = stored(ordered.mapInArrow(later, FOUND), "phrases")
    unsure = found.filter("trigger is not null")
    crowds = unsure.groupBy("trigger").agg((F.count(F.lit(1)) > CROWD).alias("crowd"))
    lists = unsure.join(crowds, "trigger").groupBy("doc").agg(F.collect_set(F.struct("trigger", "crowd", "windows")).alias("found"))
    kept = stored(pieces(df.join(lists, "doc").select("doc", "text", "found")), "pieces")
    few = kept.filter("not crowd").repartition(n, "trigger").sortWithinPartitions("trigger").mapInArrow(by_suffix_array, REPEATED)
    many = kept.filter("crowd").mapInArrow(suffixes, "suffix binary, doc long, at long").repartition(n, F.xxhash64("suffix")).sortWithinPartitions("suffix", "doc", "at")
    found = found.filter("trigger is null").select("doc", "windows")
    return found.union(few).union(many.mapInArrow(equal_suffixes, REPEATED))


def covered(data: np.ndarray, offsets: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Marks the bytes under each text's list of windows."""
    packed = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    a = np.minimum((packed >> 32) + offsets[doc], offsets[doc + 1])
    b = np.minimum((packed & 0xFFFFFFFF) + SPAN + offsets[doc], offsets[doc + 1])
    depth = np.bincount(a, minlength=len(data) + 1) - np.bincount(b, minlength=len(data) + 1)
    return np.cumsum(depth)[:-1] > 0


def with_windows(df: DataFrame) -> DataFrame:
    """df's columns as c0.. and ``windows``, the list of its repeated windows (null: none)."""
    names = [f"c{i}" for i in range(len(df.columns))]
    docs = df.toDF(*names)
    key = F.coalesce(docs[names[df.columns.index("doc_id")]], F.lit(FIRST_ID))
    found = repeated_windows(docs.select(key.alias("doc"), F.coalesce(docs[names[df.columns.index("text")]], F.lit("")).alias("text")))
    lists = found.groupBy("doc").agg(F.collect_list("windows").alias("windows"))
    return docs.join(lists, key == lists["doc"], "left").drop("doc")


def cut(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Calls make(part, data, offsets, mark) for slices of with_windows(df) whose text is column ``text``."""
    at = f"c{df.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            data, offsets = flat(part.column(part.schema.get_field_index(at)))
            yield make(part, data, offsets, covered(data, offsets, part.column(part.num_columns - 1)))

    return with_windows(df).mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for documents (doc_id, text)."""

    def make(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        edge = mark.copy()
        edge[1:] &= ~mark[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        edge[starts] = mark[starts]
        removed, spans = (np.append(0, np.cumsum(x))[offsets] for x in (mark, edge))
        kept = data[~mark].tobytes()
        at = (offsets - removed).tolist()
        digest = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans)), pa.array(digest)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(df.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(df: DataFrame) -> DataFrame:
    """df with the repeated spans cut from ``text`` (a character that is cut in two goes whole)."""
    k = df.columns.index("text")
    names = [f"c{i}" for i in range(len(df.columns))]

    def make(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        columns = list(part.columns[:-1])
        texts = [data[a:b][~mark[a:b]].tobytes().decode(errors="ignore") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        columns[k] = pa.array([None if old is None else new for old, new in zip(columns[k].to_pylist(), texts, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays(columns, names=names)

    return cut(df, make, df.toDF(*names).schema).toDF(*df.columns)

"""What the operators share: bounded slices of Arrow batches, vectorised hashing, shared storage.

Every Python stage works on slices of at most ``SLICE`` bytes of text (a longer
single text is one slice of its own), so a worker's memory does not depend on
how many rows an Arrow batch or a partition has.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 2 << 20
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None
BASE = 0x9E3779B97F4A7C55 | 1
BASE_INV = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that was set.

    Where neither is set a local master gets a folder beside its warehouse; on a cluster that is an error,
    as a machine's own folder would lose what the others write.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
        found = context._jsc.sc().getCheckpointDir().get()
    return found


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder; a lost executor costs no lineage before it, and the shuffles before it are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


STATIC, RUNTIME = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def merge_joins(spark: SparkSession) -> Iterator[None]:
    """In here, no join broadcasts a side: neither by an estimate nor by its size as shuffled.

    Estimates start from compressed files and count an array as one item, so a side of
    hundreds of MB passes for a few. And each broadcast table, however small, costs the
    driver megabytes of heap and a thread; iterative operators make dozens of them.
    """
    before = {name: spark.conf.get(name, None) for name in (STATIC, RUNTIME)}
    for name in before:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files, or of the cached or local rows, that df's plan reads; where Spark doesn't know them, df's strings are measured.

    The leaves of the plan are summed: the optimizer's figure for a join is a product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 62:
        return known
    return text_bytes(df)


def text_bytes(df: DataFrame) -> int:
    """Bytes of all strings of df, counted."""
    strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() == "string"]
    return int(df.agg(F.coalesce(F.sum(sum(strings, F.lit(8).cast("long"))), F.lit(0))).first()[0])


def chunks_for(df: DataFrame, each: int) -> int:
    """How many chunks of about ``each`` input bytes df makes: at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // each))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices with at most ``most`` bytes in ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if not len(col):
            continue
        ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    trim()


def trim() -> None:
    """Gives memory that a task has freed back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = BASE, name: str = "up") -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept for the next call."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, SLICE + (1 << 16)), base, np.uint64)
        p[0] = 1
        have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans over this many bytes are hashed, or compared, one at a time.
LONG_SPAN = 512


def eights(data: np.ndarray, padded: bool = False) -> np.ndarray:
    """The 8 bytes from each place on as a number; padded: the last 8 bytes are room, else zeros stand behind the end."""
    if not padded:
        data = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal spans wherever they stand; never 0.

    Eight bytes at a time are stirred into what came before, so no hash is a sum over
    its letters, and spans that differ in a regular way don't meet.
    """
    eight, size = eights(data), end - start
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(BASE))
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        if at >= LONG_SPAN:
            for k in live.tolist():
                h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
            break
        part = eight[start[live] + at] & LOW_BYTES[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ part) * np.uint64(BASE))
        at += 8
        live = live[size[live] > at]
    return h | np.uint64(1 << 40)


def spans_equal(data: np.ndarray, start: np.ndarray, other: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the spans data[start : start + size] equal other[begin : begin + size], byte by byte; other has 8 bytes of room behind."""
    ok = np.ones(len(size), bool)
    a, b = eights(data), eights(other, padded=True)
    live, at = np.flatnonzero(size > 0), 0
    while len(live):
        if at >= LONG_SPAN:
            for k in live.tolist():
                ok[k] = data[start[k] : start[k] + size[k]].tobytes() == other[begin[k] : begin[k] + size[k]].tobytes()
            break
        ok[live] = ((a[start[live] + at] ^ b[begin[live] + at]) & LOW_BYTES[np.minimum(size[live] - at, 8)]) == 0
        at += 8
        live = live[ok[live] & (size[live] > at)]
    return ok


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """Sums for rolling_hash. Each place stands for its 8 bytes, stirred, not for one letter."""
    n = max(0, len(data) - 7)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(eights(data)[:n] * np.uint64(BASE)) * powers(n), out=out[1:])
    return out


def rolling_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of 8 bytes or more, equal for equal spans wherever they stand."""
    h = (sums[end - 7] - sums[start]) * powers(len(sums), BASE_INV, "down")[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Table:
    """Open-addressed map from nonzero 64-bit hashes to int32, filled and read by whole arrays."""

    def __init__(self, bits: int = 22) -> None:
        self.bits, self.mask, self.n = bits, (1 << bits) - 1, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    @property
    def room(self) -> int:
        return (1 << self.bits) // 2 - self.n

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values, -1 where a hash is not in the map."""
        out = np.full(len(h), -1, np.int32)
        left, at = None, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while True:
            k = self.keys[at]
            hit = k == h
            if left is None:
                out[hit] = self.values[at[hit]]
                left = np.arange(len(h))
            else:
                out[left[hit]] = self.values[at[hit]]
            go = ~hit & (k != 0)
            if not go.any():
                return out
            left, h, at = left[go], h[go], (at[go] + 1) & self.mask

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct hashes that are not in the map; there must be room."""
        self.n += len(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            done = self.keys[at] == h
            self.values[at[done]] = values[done]
            go = ~done
            h, values, at = h[go], values[go], (at[go] + 1) & self.mask


def spread(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i] + lengths[i] - 1 for each i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(offsets - (ends - lengths), lengths)

"""Operator 6: token ids in Parquet list columns, in ascending order of documents.

Texts are range-partitioned by doc_id, pieces in number by the input's size, and encoded in that order, each followed by
an end id, and written by Spark's Parquet writer: ids in a dictionary-encoded
list column, row groups and pages of stated sizes, page indexes for doc_id, so
that a reader of some documents, or of the counts alone, reads those pages only.

Null texts are empty (the end id alone). Equal doc_ids stand in order of their
texts' hashes; null doc_ids come first. An empty table makes an empty file set.
Extra columns aren't written.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.common import chunks_for, shared_dir, slices
from spindrift.llm.pretokens import SPECIAL, Encoder

#: Bytes of input for a piece of the order, about.
PIECE = 32 << 20
FILE = "part int, doc_id long, at long, n_tokens int, ids array<int>"
_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The library's ids, asked for once for each distinct piece and worker."""
    if path not in _kept:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        # The library's threads would each keep memory of their own; and its results are large until their ids are taken.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        def encode(pieces: list[bytes]) -> list[np.ndarray]:
            parts = (pieces[i : i + 1024] for i in range(0, len(pieces), 1024))
            return [np.array(x.ids, np.int32) for part in parts for x in library.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)]

        _kept[path] = Encoder(encode, library.token_to_id(SPECIAL), bits=21)
    return _kept[path]


def write(df: DataFrame, folder: str, path: str, *, end_id: int = 0, group_mb: int = 16, page_kb: int = 256) -> None:
    """Writes FILE rows of df (doc_id, text): ``part`` counts the pieces of the order, ``at`` is the place of a document's first id in its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for rows in slices(batches):
            ids, counts = of([x or "" for x in rows.column(1).to_pylist()])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(counts), part), pa.int32()),
                    rows.column(0).cast(pa.int64()),
                    pa.array(at + ends - counts, pa.int64()),
                    pa.array(counts, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32())),
                ],
                names=["part", "doc_id", "at", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    docs = df.select("doc_id", "text")
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks_for(docs, PIECE))
    # An id that many rows have is split by the texts' hashes, which are its order.
    order = (F.col("doc_id"), F.xxhash64("text"))
    ordered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order)
    options = {
        "compression": "zstd",
        "parquet.block.size": str(group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#at": "false",
    }
    ordered.mapInArrow(run, FILE).write.options(**options).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """What write() wrote; filters on doc_id and unused columns reach the pages."""
    return spark.read.schema(FILE).parquet(folder)


def starts(files: DataFrame) -> DataFrame:
    """part, before: how many ids stand before each piece; from the counts alone, one row a piece."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(running, F.lit(0)).alias("before"))


def digests(df: DataFrame, path: str) -> DataFrame:
    """Writes df's ids in the shared folder and digests what is read back."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/spindrift-tokens-{uuid.uuid4().hex}"
    write(df, folder, path)
    files = read(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4", copy=False))).cast("B")
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                ],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    back = files.select("part", "doc_id", "at", "ids").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return back.join(starts(files), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")

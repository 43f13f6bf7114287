"""Operator 9: chat formatting by columnar byte assembly.

A turn is ``### <role>: <text></turn>`` and a line feed. In texts and roles each
backslash, ``###`` and ``</turn>`` (in roles also each colon) gets a backslash
before it, so no control string stands unescaped inside a text and reading is
exact. For a slice of turns the segments' lengths give their offsets, and headers,
texts and ends are scattered into one preallocated buffer, which becomes an Arrow
string column without another copy. The loss mask holds the places (code points)
of the assistant's texts.

Turns come sorted by conversation and turn, as a stream: a conversation longer
than a slice is several pieces, so that memory stays bounded however long one
conversation is. Null texts and roles are empty; rows with a null conv_id are one
conversation; null turns come first; rows of equal turn are ordered by role and
text, and repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import flat, slices, spread

END = b"</turn>\n"
LOSS = "assistant"
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ((?:[^\\<]|\\(?:\\|###|</turn>)|<(?!/turn>))*)</turn>\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
PIECE = "conv_id long, formatted string, loss array<struct<start:int,end:int>>"


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[list[dict[str, int]]]]:
    """Formatted pieces and loss spans of turns; first: at which turns a piece starts."""
    loss = pc.equal(pc.fill_null(roles, ""), LOSS).to_numpy(zero_copy_only=False)
    roles = pc.replace_substring_regex(pc.fill_null(roles, ""), pattern=r"(\\|###|</turn>|:)", replacement=r"\\\1")
    texts = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=r"(\\|###|</turn>)", replacement=r"\\\1")
    segments = [flat(pc.binary_join_element_wise("### ", roles, ": ", "")), flat(texts)]
    n = len(texts)
    lengths = [np.diff(offsets) for _, offsets in segments]
    size = lengths[0] + lengths[1] + len(END)
    start = np.append(0, np.cumsum(size))
    out = np.empty(int(start[-1]), np.uint8)
    at = start[:-1]
    for (data, _), length in zip(segments, lengths, strict=True):
        out[spread(at, length)] = data
        at = at + length
    out[at[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    edges = start[np.append(first, n)]
    pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(out))
    points = np.append(0, np.cumsum((out & 0xC0) != 0x80))
    base = points[edges[:-1]][np.searchsorted(first, np.arange(n), side="right") - 1]
    a, b = points[at - lengths[1]] - base, points[at] - base
    spans = [[{"start": int(a[k]), "end": int(b[k])} for k in range(i, j) if loss[k]] for i, j in zip(first.tolist(), [*first[1:].tolist(), n], strict=True)]
    return pieces, spans


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE rows of turns (conv_id, role, text) in order; neighbouring rows of one conversation make it up."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for part in slices(batches):
        conv = part.column(0)
        ids, known = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), conv.is_valid().to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])))
        formatted, spans = assemble(part.column(1), part.column(2), first)
        yield pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted, pa.array(spans, kind)], names=["conv_id", "formatted", "loss"])


def ordered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text: each conversation in one partition, in order."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_chats(turns: DataFrame) -> DataFrame:
    """PIECE rows of turns (conv_id, turn, role, text); the pieces of a conversation follow one another in a partition."""
    return ordered(turns).mapInArrow(pieces, PIECE)


def read(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted pieces alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: list | None = None

        def told() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        def ended(x: list) -> tuple:
            return x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5]

        for batch in pieces(batches):
            for conv, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        rows.append(ended(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    now[3] += len(text)
                    now[4].update(text.encode())
                now[5] += len(formatted)
            if len(rows) >= 1000:
                yield told()
                rows = []
        if now is not None:
            rows.append(ended(now))
        yield told()

    return ordered(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Operator 10: language identification from averaged hashed subword embeddings.

Every run of 3 and of 4 bytes (A-Z lower-cased, other ASCII that isn't a letter
read as a space) is hashed to one of ``BUCKETS`` embeddings. A text is the mean
of its embeddings; a linear softmax gives the languages, and besides them ``NOISE``:
what a drawn text becomes when its characters are shuffled. Embeddings and weights
are trained by stochastic gradient descent in numpy on at most about ``rows``
labelled documents (a documented bound; drawn evenly by language by a hash of id and
text, one of equal rows) and one shuffled text for every ``EVERY`` of them. A fifth
is held back: it sets the temperature of the softmax (on smoothed targets, so that it
is finite) and the score under which a prediction is rejected: half-way between the
scores of shuffled texts and those of all but ``lost`` of the documents that are
predicted rightly, or the latter if they overlap. The score is the share of the best
language in a softmax that noise takes part in.

A null text, or one without a letter, is ``und`` with score 0 and rejected; so is
every text if there are no labels. Very long texts count whole. Repeated rows get
equal results; ties go to the language that sorts first.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import crc_of_id, flat, slices, trim

#: 16 at most: a bucket is sent in two bytes.
BUCKETS_BITS = 16
WIDTHS = (3, 4)
UNKNOWN, NOISE = "und", ""
EVERY = 4
_LOWER = np.full(256, 0x20, np.uint8)
_LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LOWER[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = re.compile("[A-Za-z]")


def features(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the byte runs that start at each place, one array a width (shorter than data by width - 1)."""
    b = _LOWER[data].astype(np.uint32)
    out = []
    for width in WIDTHS:
        n = max(0, len(b) - width + 1)
        code = np.full(n, width * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(width):
            code = (code ^ b[k : k + n]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        out.append((code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS_BITS))
    return out


def sums(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the sum of its runs' rows of table, and how many runs it has."""
    total, count = np.zeros((len(offsets) - 1, table.shape[1])), np.zeros(len(offsets) - 1)
    for width, h in zip(WIDTHS, features(data), strict=True):
        a, b = np.minimum(offsets[:-1], len(h)), np.minimum(np.maximum(offsets[1:] - width + 1, offsets[:-1]), len(h))
        full = np.flatnonzero(b > a)
        if not len(full):
            continue
        keep = np.stack([a[full], b[full]], axis=1).ravel()
        rows = table[np.append(h, 0)]
        rows[-1] = 0
        total[full] += np.add.reduceat(rows, keep, axis=0)[::2]
        count[full] += (b - a)[full]
    return total, count


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The share of each language; noise, which is the last class of all, has the rest."""
        total, count = sums(self.table, data, offsets)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)[:, : len(self.languages)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(found: list[tuple[str, np.ndarray, np.ndarray]], *, dim: int = 16, epochs: int = 8, rate: float = 2.0, lost: float = 0.002, seed: int = 7) -> Model | None:
    """Fits a model to (language or NOISE, buckets, shares of the text's runs)."""
    names = sorted({x[0] for x in found} - {NOISE})
    if not names:
        return None
    classes = [*names, NOISE]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(found))
    back = order[: len(found) // 5]
    fit = order[len(found) // 5 :]
    k = len(classes)
    embed = (rng.random((1 << BUCKETS_BITS, dim), np.float32) - 0.5) / dim
    weight, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit).tolist():
            name, at, share = found[i]
            now = rate * (1 - step / steps)
            step += 1
            x = share @ embed[at]
            g = softmax(x @ weight + bias)
            g[classes.index(name)] -= 1
            down = weight @ g
            weight -= now * np.outer(x, g)
            bias -= now * 0.01 * g
            embed[at] -= now * share[:, None] * down
    model = Model(names, embed @ weight, bias)
    if len(back) >= 5:
        z = np.stack([found[i][2] @ model.table[found[i][1]] + bias for i in back])
        y = np.array([classes.index(found[i][0]) for i in back])
        target = np.full(z.shape, 1 / (len(back) + 2) / (k - 1))
        target[np.arange(len(y)), y] = 1 - 1 / (len(back) + 2)
        model.temperature = min(np.geomspace(0.005, 50, 185), key=lambda t: -(target * np.log(np.maximum(softmax(z / t), 1e-30))).sum()).item()
        p = softmax(z / model.temperature)[:, :-1]
        known = y < len(names)
        right = np.sort(p.max(axis=1)[known & (p.argmax(axis=1) == y)])
        if len(right):
            model.least = float(right[int(lost * len(right))])
            noise = np.sort(p.max(axis=1)[~known])
            if len(noise):
                model.least = min(model.least, (model.least + float(noise[-1 - int(0.01 * len(noise))])) / 2)
    return model


def fit(labelled: DataFrame, *, rows: int = 4000, **options: float) -> Model | None:
    """Trains on at most about ``rows`` of labelled (doc_id, text, lang), evenly by language; rows without lang or a letter don't count."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    # A hash of id and text in 0..2**31-1 under a language's share of it; so no row moves but those drawn, and of equal rows one.
    share: Column = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1 << 31, int((1 << 31) * rows / len(counts) / n))).otherwise(share)
    drawn = usable.select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text"), F.lit(10)).alias("h"))
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 31)) < share).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for lang, text, h in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if not lettered(text):
                    continue
                out.append((lang, h, *counted(text)))
                if h % EVERY == 0:
                    out.append((NOISE, h, *counted(shuffled(text, h))))
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["lang", "h", "at", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        found = [(lang.as_py(), read(at, "<u2"), read(share, "<f4")) for batch in batches for lang, _, at, share in zip(*batch.columns, strict=True) if len(at.as_buffer())]
        model = train(found, **options)
        found.clear()
        trim()
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # A drawn text may have every bucket, so the sample is learned from in a task; the driver gets the model alone.
    sample = drawn.mapInArrow(run, "lang string, h long, at binary, share binary").repartition(1).sortWithinPartitions("lang", "h")
    found = sample.mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def lettered(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def counted(text: str) -> tuple[bytes, bytes]:
    """A text's buckets and their shares of its runs, as bytes."""
    h = np.concatenate(features(np.frombuffer(text.encode(), np.uint8)))
    at, n = np.unique(h, return_counts=True)
    return at.astype("<u2").tobytes(), (n / max(1, len(h))).astype("<f4").tobytes()


def shuffled(text: str, seed: int) -> str:
    """The text's characters in another order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.random.default_rng(seed & 0xFFFFFFFF).permutation(points.copy()).tobytes().decode("utf-32-le")


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score and rejected (columns of those names are replaced)."""
    df = df.drop("lang_pred", "score", "rejected")
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in slices(batches, text, 1 << 19):
            column = part.column(part.schema.get_field_index(text))
            letters = np.array([model is not None and x is not None and lettered(x) for x in column.to_pylist()], bool)
            best, names = np.zeros(len(letters)), np.array([UNKNOWN] * len(letters), object)
            if model is not None:
                p = model.scores(*flat(column))
                best = np.where(letters, p.max(axis=1), 0.0)
                names = np.where(letters, np.array(model.languages, object)[p.argmax(axis=1)], UNKNOWN)
            gone = ~letters | (best < (model.least if model else 0))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(best, pa.float64()), pa.array(gone)], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame) -> DataFrame:
    """Learns from the documents that aren't held out and predicts all."""
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))
    model = fit(df.filter(~held))
    return predict(df.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(df: DataFrame) -> DataFrame:
    """df's rows whose language is accepted, by a model of df's own labels; columns as they are."""
    model = fit(df)
    names = [f"c{i}" for i in range(len(df.columns))]
    found = predict(df.toDF(*names), model, text=names[df.columns.index("text")])
    return found.filter(~F.col("rejected")).select(*names).toDF(*df.columns)

"""Operator 4: scores of texts by a word table (base) and by logistic context mixing.

Both need the counts of the corpus's keys: words (64-bit hashes), and strings of six
bytes. Texts are dealt into chunks by a hash; a chunk lists each of its distinct keys
once, with its count in training texts, packed into a row for each part that the keys
are dealt into by a hash. A part adds the lists up, as a stream, to the corpus's
counts of its keys, works out what is to be known of each, and answers each list with
a list of the same length. So no row stands for one key, and no table of all keys is
ever in one place.

Base: words and one end token a text, with counts over all training texts.

Model: a byte is eight binary decisions. For each, the orders 0 to 5 (so many bytes
before it) look up counts of zeros and ones after exactly these bytes over all
training texts; the logits of these predictors, and a bias, are mixed by weights that the
number of orders that know the context and the place of the bit select, learned online by
gradient descent on coding cost over all the training texts' contexts, each shard
for itself, the shards' weights averaged. An adaptive map by order-1 context
refines the mixed probability. As a decision depends on six bytes alone, all corpus
passes work on counts of distinct six-byte strings, which are the same sums as over
the texts; ``score`` is the log10 of the product of the texts' byte probabilities,
and ``bits_per_byte`` follows from it.

The counts are a distributed table that grows with the corpus. Strings with the same
three bytes before their last are in one part, which so has all counts of the orders
from 3 on of its strings. Those of lower orders are at most 2**24, one for each three
bytes that occur, and go to all. Each part is a shard of the training. The number of
chunks and parts, and the order in which a part learns, follow from the texts alone:
scores don't depend on how tables and shuffles are partitioned (but for rounding in
the last places of sums).

Null texts are empty: an end token, a score of 0. Null ids are trained on. Without
training texts all counts are 0. Repeated rows are scored alike and count as often
as they occur. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import crc_of_id, flat, forget, mix, slices, stored, text_bytes
from spindrift.llm.near_dedup import word_hashes

#: Bytes of texts in a chunk, about, and the least number of chunks.
CHUNK, CHUNKS = 8 << 20, 16
#: Parts at most; there are as many as chunks otherwise.
PARTS = 1 << 12
GRAM, WORD = 0, 1
ORDERS = 6
#: The least order whose contexts are dealt into parts.
DEALT = 3
#: Strings that are worked on together, if contexts end there.
BLOCK = 1 << 17
GATES = (ORDERS + 1) * 8
MAP_CONTEXTS, MAP_LEVELS = 256, 24
END_TOKEN = 1


# ---- keys and counts


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte, it and the ORDERS - 1 before it in its text (0 where there is none), as one number."""
    out = data.astype(np.uint64)
    for k in range(1, ORDERS):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k]
        for j in range(k):
            at = offsets[:-1] + j
            at = at[at < offsets[1:]]
            before[at] = 0
        out |= before << np.uint64(8 * k)
    return out


def turned(gram: np.ndarray) -> np.ndarray:
    """Grams as keys that sort by the DEALT bytes before the last, then by the bytes before those, then by the last."""
    last, context, older = gram & np.uint64(0xFF), gram >> np.uint64(8) & np.uint64(0xFFFFFF), gram >> np.uint64(32)
    return context << np.uint64(24) | older << np.uint64(8) | last


def unturned(key: np.ndarray) -> np.ndarray:
    last, context, older = key & np.uint64(0xFF), key >> np.uint64(24), key >> np.uint64(8) & np.uint64(0xFFFF)
    return older << np.uint64(32) | context << np.uint64(8) | last


class Tally:
    """Distinct keys of a stream, sorted, with sums of their weights."""

    def __init__(self) -> None:
        self.keys, self.sums, self.have = [np.zeros(0, np.uint64)], [np.zeros(0)], 0

    def add(self, keys: np.ndarray, weights: np.ndarray, distinct: bool = False) -> None:
        if not distinct:
            keys, back = np.unique(keys, return_inverse=True)
            weights = np.bincount(back, weights, len(keys))
        self.keys.append(keys)
        self.sums.append(weights)
        self.have += len(keys)
        if self.have > max(4 << 20, 2 * len(self.keys[0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            every, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.sums = [np.bincount(back, np.concatenate(self.sums), len(every))]
            self.keys, self.have = [every], 0
        return self.keys[0], self.sums[0]


def pieces(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a chunk's texts: rows, offsets of bytes, keys of grams, where words start, keys of words, and which texts are trained on."""
    for part in slices(iter(table.combine_chunks().to_batches())):
        names = part.schema.names
        data, offsets = flat(part.column(names.index("text")))
        words, at = word_hashes(data, offsets)
        train = ~part.column(names.index("held_out")).to_numpy(zero_copy_only=False)
        yield part, offsets, turned(grams_of(data, offsets)), at, words, train


def tallies(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts in training texts) of a chunk's grams and of its words."""
    grams, words = Tally(), Tally()
    for _, offsets, g, at, w, train in pieces(table):
        grams.add(g, np.repeat(train, np.diff(offsets)).astype(np.float64))
        words.add(np.append(w, np.uint64(END_TOKEN)), np.append(np.repeat(train, np.diff(at)).astype(np.float64), train.sum()))
    return [grams.merge(), words.merge()]


def parted(kind: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by part, and where each part ends in it."""
    part = (mix(keys >> np.uint64(24) if kind == GRAM else keys) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))


def packed(kind: int, keys: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, : ORDERS if kind == GRAM else 8]).tobytes()


def unpacked(kind: int, raw: bytes) -> np.ndarray:
    width = ORDERS if kind == GRAM else 8
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


LISTS = "part int, kind int, chunk int, keys binary, counts binary"


def key_lists(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """LISTS of docs (chunk, held_out, text) in n chunks: a row for each chunk, kind and part."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        rows = []
        for kind, (keys, counts) in enumerate(tallies(table)):
            order, ends = parted(kind, keys, parts)
            keys, counts = keys[order], counts[order].astype("<u4")
            rows += [(p, kind, chunk, packed(kind, keys[a:b]), counts[a:b].tobytes()) for p, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if b > a]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["part", "kind", "chunk", "keys", "counts"])

    return docs.select("chunk", "held_out", "text").repartition(n, "chunk").groupBy("chunk").applyInArrow(run, LISTS)


TOTALS = "part int, kind int, keys binary, counts binary"


def key_totals(lists: DataFrame, parts: int) -> DataFrame:
    """TOTALS of LISTS: a row for each part and kind, with all its keys, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()

        def told() -> pa.RecordBatch:
            keys, counts = tally.merge()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed(now[1], keys)], pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=["part", "kind", "keys", "counts"])

        for batch in batches:
            for part, kind, keys, counts in zip(*(batch.column(i) for i in (0, 1, 3, 4)), strict=True):
                at = part.as_py(), kind.as_py()
                if at != now:
                    if now is not None:
                        yield told()
                    now, tally = at, Tally()
                tally.add(unpacked(at[1], keys.as_buffer()), np.frombuffer(counts.as_buffer(), "<u4").astype(np.float64), distinct=True)
        if now is not None:
            yield told()

    return lists.repartition(parts, "part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(run, TOTALS)


def training_tokens(totals: DataFrame) -> tuple[int, int]:
    """All training tokens, and how many different ones there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = v = 0
        for batch in batches:
            for raw in batch.column(0):
                counts = np.frombuffer(raw.as_buffer(), "<i8")
                n, v = n + int(counts.sum()), v + int((counts > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([v], pa.int64())], names=["n", "v"])

    row = totals.filter(F.col("kind") == WORD).select("counts").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


def blocks_in(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Neighbouring keys of a part with all that share their contexts: where they are, their grams in order, and their counts, in that order."""
    ends = np.append(np.flatnonzero(np.diff(keys >> np.uint64(24))) + 1, len(keys))
    a = 0
    while a < len(keys):
        b = int(ends[min(len(ends) - 1, max(np.searchsorted(ends, a + 1), np.searchsorted(ends, a + BLOCK, side="right") - 1))])
        yield slice(a, b), unturned(keys[a:b]), counts[a:b]
        a = b


def grams_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys and counts of each part, from TOTALS of grams."""
    for batch in batches:
        for keys, counts in zip(batch.column(2), batch.column(3), strict=True):
            yield unpacked(GRAM, keys.as_buffer()), np.frombuffer(counts.as_buffer(), "<i8").astype(np.float64)


def low_orders(totals: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order below DEALT the sorted pairs of context and byte, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in grams_in(batches):
            pair, back = np.unique(unturned(keys) & np.uint64((1 << 8 * DEALT) - 1), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(np.bincount(back, n, len(pair)).astype(np.int64))], names=["pair", "n"])

    # At most 2**24 rows, whatever the input's size.
    found = totals.filter(F.col("kind") == GRAM).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = found.column("pair").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    out = []
    for order in range(DEALT):
        every, back = np.unique(pair & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
        out.append((every, np.bincount(back, n, len(every))))
    return out


# ---- model


class Counts:
    """Counts of zeros and ones after each context of a block's distinct grams that occur n times each."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.orders = []
        for order in range(ORDERS):
            pair = gram & np.uint64((1 << 8 * (order + 1)) - 1)
            if order < DEALT:
                every, total = low[order]
                own = np.isin(every >> np.uint64(8), np.unique(pair >> np.uint64(8)))
                every, total = every[own], total[own]
                back = np.searchsorted(every, pair)
            else:
                every, back = np.unique(pair, return_inverse=True)
                total = np.bincount(back, n, len(every))
            self.orders.append((every, total, back.astype(np.int32)))

    def of(self, bit: int) -> list[np.ndarray]:
        """For each order the zeros and ones of the bit-th decision of each pair of context and byte."""
        out = []
        for every, total, _ in self.orders:
            node = every >> np.uint64(8 - bit)
            group = np.cumsum(np.append(False, node[1:] != node[:-1]))
            y = (every >> np.uint64(7 - bit) & np.uint64(1)).astype(np.float64)
            out.append(np.stack([np.bincount(group, total * (1 - y))[group], np.bincount(group, total * y)[group]], axis=1))
        return out

    def rows(self, found: list[np.ndarray], at: np.ndarray | slice) -> np.ndarray:
        """What ``of`` found, for the grams at these places: orders x grams x 2."""
        return np.stack([n[back[at]] for n, (_, _, back) in zip(found, self.orders, strict=True)])


class Mixer:
    """Gated weights and the adaptive map, of fixed size."""

    def __init__(self) -> None:
        self.weights = np.zeros((GATES, ORDERS + 1))
        self.weights[:, :ORDERS] = 0.3
        self.map = np.zeros((MAP_CONTEXTS * MAP_LEVELS, 2))

    def inputs(self, gram: np.ndarray, bit: int, n: np.ndarray, left_out: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the predictors (grams x inputs), gates, outcomes; n: what Counts.rows gives; left_out: occurrences that are not counted."""
        y = (gram >> np.uint64(7 - bit) & np.uint64(1)).astype(np.int64)
        if left_out:
            n[:, np.arange(len(y)), y] = np.maximum(n[:, np.arange(len(y)), y] - left_out, 0)
        x = np.empty((len(y), ORDERS + 1))
        x[:, :ORDERS] = np.log((n[:, :, 1] + 0.3) / (n[:, :, 0] + 0.3)).T
        x[:, ORDERS] = 0.3
        seen = (n.sum(axis=2) > 1).sum(axis=0)
        return x, seen * 8 + bit, y

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip((x * self.weights[gate]).sum(axis=1), -12, 12)

    def cell(self, gram: np.ndarray, bit: int, z: np.ndarray) -> np.ndarray:
        """Place in the adaptive map: the byte before with the bits so far, and the logit's level."""
        context = mix((gram.astype(np.uint64) >> np.uint64(8 - bit) & np.uint64((1 << 8 + bit) - 1)) << np.uint64(3) | np.uint64(bit)) >> np.uint64(56)
        return context.astype(np.int64) * MAP_LEVELS + np.clip((z + 12).astype(np.int64), 0, MAP_LEVELS - 1)

    def learn(self, gram: np.ndarray, n: np.ndarray, counts: Counts, rate: float = 0.02, block: int = 2048) -> None:
        """One online pass over grams that occur n times each, in an order of its own; the bits have weights of their own."""
        order = np.random.default_rng(0).permutation(np.flatnonzero(n))
        for bit in range(8):
            found = counts.of(bit)
            for i in range(0, len(order), block):
                at = order[i : i + block]
                weight = np.sqrt(n[at])
                x, gate, y = self.inputs(gram[at], bit, counts.rows(found, at), 1)
                error = (y - 1 / (1 + np.exp(-self.mixed(x, gate)))) * weight
                step = np.stack([np.bincount(gate, error * x[:, k], GATES) for k in range(ORDERS + 1)], axis=1)
                total = np.bincount(gate, weight, GATES)
                self.weights += rate * step / np.maximum(total, 1)[:, None]

    def map_counts(self, gram: np.ndarray, n: np.ndarray, counts: Counts, block: int = 8192) -> np.ndarray:
        size = MAP_CONTEXTS * MAP_LEVELS
        out = np.zeros(2 * size)
        train = np.flatnonzero(n)
        for bit in range(8):
            found = counts.of(bit)
            for i in range(0, len(train), block):
                at = train[i : i + block]
                x, gate, y = self.inputs(gram[at], bit, counts.rows(found, at), 1)
                out += np.bincount(2 * self.cell(gram[at], bit, self.mixed(x, gate)) + y, n[at], 2 * size)
        return out.reshape(size, 2)

    def log10(self, gram: np.ndarray, counts: Counts, block: int = 8192) -> np.ndarray:
        """log10 probability of each gram's last byte after its others."""
        total = np.zeros(len(gram))
        for bit in range(8):
            found = counts.of(bit)
            for i in range(0, len(gram), block):
                at = slice(i, i + block)
                x, gate, y = self.inputs(gram[at], bit, counts.rows(found, at))
                z = self.mixed(x, gate)
                p = 1 / (1 + np.exp(-z))
                cell = self.map[self.cell(gram[at], bit, z)]
                refined = (cell[:, 1] + 8 * p) / (cell.sum(axis=1) + 8)
                p = np.clip(0.5 * p + 0.5 * refined, 1e-6, 1 - 1e-6)
                total[at] += np.log10(np.where(y == 1, p, 1 - p))
        return total


def train(totals: DataFrame, low: list[tuple[np.ndarray, np.ndarray]]) -> Mixer:
    """A mixer of all grams of the TOTALS that training texts have."""
    context = totals.sparkSession.sparkContext
    mixer, sent = Mixer(), context.broadcast(low)
    grams = totals.filter(F.col("kind") == GRAM)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in grams_in(batches):
            own = Mixer()
            for _, gram, n in blocks_in(keys, counts):
                own.learn(gram, n, Counts(gram, n, sent.value))
            if total := float(np.sqrt(counts).sum()):
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([own.weights.ravel().tolist()])], names=["total", "weights"])

    sums = [F.sum(F.col("total") * F.col("weights")[i]) for i in range(mixer.weights.size)]
    row = grams.mapInArrow(learn, "total double, weights array<double>").agg(F.sum("total"), F.array(*sums)).first()
    if row[0]:
        mixer.weights = np.array(row[1]).reshape(mixer.weights.shape) / row[0]
        weighted = context.broadcast(mixer)

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros_like(weighted.value.map)
            for keys, counts in grams_in(batches):
                for _, gram, n in blocks_in(keys, counts):
                    out += weighted.value.map_counts(gram, n, Counts(gram, n, sent.value))
            used = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(out[used, 0]), pa.array(out[used, 1])], names=["cell", "n0", "n1"])

        cells = grams.mapInArrow(refine, "cell long, n0 double, n1 double").groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        mixer.map = np.zeros_like(mixer.map)
        mixer.map[cells.column("cell").to_numpy()] = np.stack([cells.column("n0").to_numpy(), cells.column("n1").to_numpy()], axis=1)
    return mixer


ANSWERS = "chunk int, kind int, part int, found binary"


def answers(lists: DataFrame, totals: DataFrame, low: list[tuple[np.ndarray, np.ndarray]], mixer: Mixer, parts: int) -> DataFrame:
    """ANSWERS to each of the LISTS: for its grams their log10 probabilities, for its words their counts."""
    sent = lists.sparkSession.sparkContext.broadcast((low, mixer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, mixer = sent.value
        every, known = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            out = []
            for part, kind, chunk, keys, counts in zip(*(batch.column(i) for i in range(5)), strict=True):
                kind = kind.as_py()
                if chunk.as_py() < 0:  # a part's totals come before its lists
                    every, known = unpacked(kind, keys.as_buffer()), np.frombuffer(counts.as_buffer(), "<i8")
                    if kind == GRAM:
                        n, known = known.astype(np.float64), np.zeros(len(every), "<f4")
                        for at, gram, count in blocks_in(every, n):
                            known[at] = mixer.log10(gram, Counts(gram, count, low))
                else:
                    at = np.searchsorted(every, unpacked(kind, keys.as_buffer()))
                    out.append((chunk.as_py(), kind, part.as_py(), known[at].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["chunk", "kind", "part", "found"])

    asked = lists.withColumn("counts", F.lit(None).cast("binary")).unionByName(totals.withColumn("chunk", F.lit(-1)))
    return asked.repartition(parts, "part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(run, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double"


def chunk_scores(docs: pa.Table, found: pa.Table, parts: int) -> pa.Table:
    """SCORES of a chunk's texts, by the ANSWERS to its lists; logs is the sum of log10(c + 1) over tokens."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "bits_per_byte")}
    kinds, places = found.column("kind").to_numpy(), found.column("part").to_numpy()
    held, distinct = [], [Tally(), Tally()]
    for part, offsets, grams, at, words, train in pieces(docs):
        uniques = [np.unique(x, return_inverse=True) for x in (grams, np.append(words, np.uint64(END_TOKEN)))]
        for tally, (keys, _) in zip(distinct, uniques, strict=True):
            tally.add(keys, np.zeros(len(keys)), distinct=True)
        held.append((part.column(part.schema.names.index("doc_id")), offsets, at, train, [(keys, back.astype(np.int32)) for keys, back in uniques]))
    every, values = [tally.merge()[0] for tally in distinct], []
    for kind, keys in enumerate(every):
        rows = np.flatnonzero(kinds == kind)
        rows = rows[np.argsort(places[rows])]
        got = np.frombuffer(b"".join(found.column("found")[int(i)].as_py() for i in rows), "<f4" if kind == GRAM else "<i8")
        order, _ = parted(kind, keys, parts)
        value = np.empty(len(keys), np.float64)
        value[order] = got
        values.append(value)
    for doc_id, offsets, at, train, uniques in held:
        value, counts = (values[kind][np.searchsorted(every[kind], keys)][back] for kind, (keys, back) in enumerate(uniques))
        logs = np.log10(counts + 1.0)
        # The end's count stands behind those of the words.
        sums, known, bits = (np.append(0, np.cumsum(x)) for x in (logs[:-1], counts[:-1] > 0, value))
        score = bits[offsets[1:]] - bits[offsets[:-1]]
        out["doc_id"] += doc_id.to_pylist()
        out["held_out"] += (~train).tolist()
        out["n_tokens"] += (np.diff(at) + 1).tolist()
        out["n_known"] += (known[at[1:]] - known[at[:-1]] + (counts[-1] > 0)).tolist()
        out["logs"] += (sums[at[1:]] - sums[at[:-1]] + logs[-1]).tolist()
        out["score"] += score.tolist()
        out["bits_per_byte"] += (-score / np.log10(2) / np.maximum(np.diff(offsets), 1)).tolist()
    types = {"held_out": pa.bool_(), "logs": pa.float64(), "score": pa.float64(), "bits_per_byte": pa.float64()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def score(docs: DataFrame, told: DataFrame, n: int, parts: int) -> DataFrame:
    """SCORES of docs (chunk, doc_id, held_out, text) in n chunks, by ANSWERS."""
    docs = docs.select("chunk", "doc_id", "held_out", "text").repartition(n, "chunk")
    return docs.groupBy("chunk").cogroup(told.repartition(n, "chunk").groupBy("chunk")).applyInArrow(lambda a, b: chunk_scores(a, b, parts), SCORES)


def dealt(documents: DataFrame) -> tuple[DataFrame, int]:
    """chunk, doc_id, held_out, text for each row of documents, and the number of chunks."""
    held = F.coalesce(crc_of_id(F.col("doc_id")) % 7 == 2, F.lit(False)).alias("held_out")
    docs = documents.select("doc_id", held, F.coalesce("text", F.lit("")).alias("text"))
    n = max(CHUNKS, -(-text_bytes(docs) // CHUNK))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def digests(documents: DataFrame) -> DataFrame:
    """Base and model scores of all documents; the model learns from those that aren't held out."""
    docs, n = dealt(documents)
    parts = min(PARTS, n)
    lists = stored(key_lists(docs, n, parts), "lists", compression="zstd")
    totals = stored(key_totals(lists, parts), "totals", compression="zstd")
    tokens, kinds = training_tokens(totals)
    low = low_orders(totals)
    told = stored(answers(lists, totals, low, train(totals, low), parts), "answers", compression="zstd")
    forget(lists, totals)
    scored = stored(score(docs, told, n, parts), "scores")
    forget(told)
    whole = F.log10(F.lit(float(tokens + kinds + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), "score", "bits_per_byte")

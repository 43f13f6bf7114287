"""Operator 5: near-duplicate documents by a join on the coordinates of MinHash signatures.

A document is its set of distinct runs of ``SHINGLE`` words (hashed to 48 bits).
Documents with equal sets are one node of the graph of links. Each node has a
signature of ``COORDINATES`` least hashes; it is posted under each pair of
coordinate and value. Nodes that agree in ``MATCHES`` coordinates or more must
meet under one of their COORDINATES - MATCHES + 1 rarest pairs (prefix filter,
one order of pairs by frequency for all), so the long lists under common pairs are
skipped, and a pair that only one node has is not looked at.

Lists are resolved without pairing all their members. Each is compared with a
pivot, its least id. Distances (1 - similarity) are a metric, so members within LINK
of the pivot are in one component, and one that is farther than twice LINK from the
pivot links to none of those. What is left is compared in blocks of about ``BLOCK``
by ``BLOCK`` members with ``BLOCK_SHINGLES`` shingles on a side: members that the pivot isn't linked to among
themselves, and those within twice LINK of the pivot with those that it is linked
to. In a block, coincidences of the signatures are counted first, and pairs with
MATCHES or more in different components are compared on whole sets; a block returns
one link for two components at most. Two sets of similarity 0.75 agree in fewer than
MATCHES coordinates in about one of a million cases.

Texts without words (null, empty) have no set and link with nothing; fewer than
SHINGLE words are one shingle. A null doc_id links with nothing, its component is
null, and it is kept. Rows with equal doc_id are one document. Other columns are
ignored by components() and stay as they are in drop_duplicates().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import flat, forget, merge_joins, mix, slices, span_hash, stored

SHINGLE, COORDINATES, MATCHES = 5, 32, 12
LINK_OF_100 = 75
FAR = 1 - LINK_OF_100 / 100
#: Members of a block's side, and shingles of their sets, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.random.default_rng(5).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) | np.uint64(1)
_PLACE = [np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64)) for k in range(SHINGLE)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z lower-cased), and where each text's words start in them."""
    gap = _SPACE[data]
    starts, ends = ~gap, ~gap
    starts, ends = starts.copy(), ends.copy()
    starts[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = ~gap[edge]
    ends[edge - 1] = ~gap[edge - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return span_hash(_LOWER[data], a, b), np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 48-bit shingle hashes of each text."""
    h, at = word_hashes(data, offsets)
    n = max(0, len(h) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += h[k : k + n] * _PLACE[k]
    s = mix(s) >> np.uint64(16)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(31) + h[k : k + 1] * _PLACE[k - a])
            out.append(x >> np.uint64(16))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Least of COORDINATES hashes over a set, 32 bits each."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        part = s[i : i + 4096]
        x = part[None, :] * _ODD[0][:, None] + _ODD[1][:, None]
        x ^= x >> np.uint64(29)
        x *= _ODD[1][:, None]
        least = np.minimum(least, (x >> np.uint64(32)).min(axis=1))
    return least.astype(np.uint32).view(np.int32)


def packed(s: np.ndarray) -> bytes:
    return np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def signatures(df: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), digest (of the set), sig for each row of df (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(*flat(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([signature(s).tolist() for s in sets], pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "digest", "sig"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary, sig array<int>")


def whole_sets(df: DataFrame) -> DataFrame:
    """id, set (packed) for each row of df (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(*flat(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([packed(s) for s in sets], pa.binary())], names=["id", "set"])

    return df.mapInArrow(run, "id long, set binary")


def common(pairs: DataFrame) -> DataFrame:
    """a, b, both, either: sizes of intersection and union for each row of pairs (a, b, set_a, set_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            last, x = None, np.zeros(0, np.uint64)
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                p = p.as_buffer()
                if last is None or not p.equals(last):
                    last, x = p, unpacked(p)
                y = unpacked(q.as_buffer())
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                sizes.append((both, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=["a", "b", "both", "either"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, both int, either int")


def postings(nodes: DataFrame) -> DataFrame:
    """key, id, n, pivot: nodes (id, n, sig) under their rarest keys that others have too; pivot: the key's least id."""
    key = (F.col("j").cast("long") * (1 << 32) + F.col("v").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("key")
    every = nodes.select("id", "n", F.posexplode("sig").alias("j", "v")).select("id", "n", F.col("j"), F.col("v").cast("long").alias("v")).select("id", "n", key)
    lists = every.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("pivot")).filter("df > 1")
    shared = every.join(lists, "key").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key", "pivot"))).alias("keys"))
    # The keys that the node has alone are the rarest and come first; what is left of the prefix are shared ones.
    left = F.size("keys") - F.lit(MATCHES - 1)
    return shared.filter(left > 0).select("id", "n", F.explode(F.slice("keys", F.lit(1), left)).alias("k")).select("k.key", "id", "n", "k.pivot")


def block_links(table: pa.Table) -> pa.Table:
    """a, b: links between different components in a block of members (side, id, component, sig, set); side 2: compared with all, 0 with 1."""
    side, ids, comp = (table.column(k).to_numpy() for k in ("side", "id", "component"))
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    sets = [unpacked(x.as_buffer()) for x in table.column("set").combine_chunks()]
    sizes = np.array([len(x) for x in sets])
    places = np.append(0, np.cumsum(sizes))
    flat_sets = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(int(flat_sets.max()) + 1, bool)
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    out = []
    for i in range(len(ids)):
        j = np.arange(i + 1, len(ids))
        j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] == 2)) & (4 * np.minimum(sizes[j], sizes[i]) >= 3 * np.maximum(sizes[j], sizes[i]))]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(axis=1) >= MATCHES]
        if not len(j):
            continue
        own = flat_sets[places[i] : places[i + 1]]
        mark[own] = True
        for k in j.tolist():
            x, y = root(int(comp[i])), root(int(comp[k]))
            if x == y:
                continue
            both = int(mark[flat_sets[places[k] : places[k + 1]]].sum())
            if 100 * both >= LINK_OF_100 * (sizes[i] + sizes[k] - both):
                top[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[k])))
        mark[own] = False
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def connected(edges: DataFrame) -> DataFrame:
    """id, component (the least id reachable) for each id in edges (a, b)."""
    # Both ways from one run of edges: which links stand for a block's components may differ from run to run.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.select(F.explode(ways).alias("e")).select("e.*").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    table = labels
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        root = lower.select(F.col("id").alias("r"), F.col("component").alias("of_root"))
        jumped = lower.join(root, lower["component"] == root["r"], "left").select("id", F.least("component", "of_root").alias("component"), "old")
        jumped = stored(jumped, "labels")
        forget(table)
        labels, table = jumped.select("id", "component"), jumped
        if jumped.filter("component <> old").isEmpty():
            forget(both)
            return labels


def links(documents: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """id, component for the nodes that have links; None if no two nodes share a key. documents: id, text of the nodes and of others."""
    lists = stored(postings(nodes), "postings")
    if lists.isEmpty():
        return None
    ids = lists.select("id").union(lists.select("pivot")).distinct()
    sets = stored(whole_sets(documents.join(ids, "id", "left_semi").select("id", "text")), "sets")
    # Sets of which one has not half the other's size are farther than twice LINK from each other; their distance isn't needed.
    pivot_sizes = nodes.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"))
    asked = lists.filter("id <> pivot").select("id", "n", "pivot").distinct().join(pivot_sizes, "pivot")
    asked = asked.filter(2 * F.least("n", "pivot_n") >= F.greatest("n", "pivot_n"))
    sa = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    sb = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    got = common(asked.select(F.col("pivot").alias("a"), F.col("id").alias("b")).join(sb, "b").join(sa, "a"))
    linked = 100 * F.col("both").cast("long") >= LINK_OF_100 * F.col("either").cast("long")
    found = stored(got.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("both") / F.col("either")).alias("d"), linked.alias("linked")), "compared")
    known = connected(found.filter("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    component = F.coalesce("component", "id").alias("component")
    told = lists.filter("id <> pivot").join(found, ["pivot", "id"], "left").join(known, "id", "left")
    told = stored(told.select("key", "pivot", "id", "n", component, F.coalesce("linked", F.lit(False)).alias("linked"), F.coalesce("d", F.lit(1.0)).alias("d")), "told")
    block = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    # Members that their list's pivot isn't linked to, list by list; lists of the same members are one.
    rest = told.filter("not linked")
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    sizes = sizes.filter("n > 1 and low <> high").groupBy("n", "size", "x", "y").agg(F.min("key").alias("key"))
    among = rest.join(sizes.select("key", block("n", "size").alias("blocks")), "key")
    among = among.withColumn("own", part("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    among = among.select(F.col("key").alias("g"), i.alias("i"), j.alias("j"), F.when(i == j, 2).when(F.col("own") == i, 0).otherwise(1).alias("side"), "id", "component")

    # Members that a pivot is linked to, against those near it that are in another component, pivot by pivot.
    pairs = told.select("pivot", "id", "n", "component", "linked", "d").distinct()
    home = known.select(F.col("id").alias("pivot"), F.col("component").alias("home"))
    pairs = pairs.join(home, "pivot").filter(F.col("linked") | ((F.col("d") <= 2 * FAR + 1e-9) & (F.col("component") != F.col("home"))))
    counted = [F.sum(F.when(x, y)).alias(name) for x, a, b in ((F.col("linked"), "n", "n_size"), (~F.col("linked"), "m", "m_size")) for y, name in ((F.lit(1), a), (F.col("n"), b))]
    both = pairs.groupBy("pivot").agg(*counted).filter("n > 0 and m > 0")
    across = pairs.drop("n").join(both.select("pivot", block("n", "n_size").alias("n"), block("m", "m_size").alias("m")), "pivot")
    across = across.withColumn("i", F.explode(F.when(F.col("linked"), F.array(part("n"))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    across = across.withColumn("j", F.explode(F.when(F.col("linked"), F.sequence(F.lit(0), F.col("m") - 1)).otherwise(F.array(part("m")))))
    across = across.select((-1 - F.col("pivot")).alias("g"), "i", "j", F.when(F.col("linked"), 0).otherwise(1).alias("side"), "id", "component")

    members = among.withColumn("kind", F.lit(0)).unionByName(across.withColumn("kind", F.lit(1)))
    members = members.join(nodes.select("id", "sig"), "id").join(sets, "id")
    more = members.groupBy("kind", "g", "i", "j").applyInArrow(block_links, "a long, b long")
    edges = found.filter("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    out = connected(edges.unionByName(more))
    forget(lists, sets, found, told)
    return out


def components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of documents (doc_id, text)."""
    all_sets = stored(signatures(documents), "signatures")
    full = all_sets.filter("n > 0 and doc_id is not null")
    nodes = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = stored(nodes, "nodes")
    # An id with several texts is a node under each of its sets, which are linked by the id.
    with merge_joins(documents.sparkSession):
        known = links(documents.select(F.col("doc_id").alias("id"), "text"), nodes.select("id", "n", "sig"))
    of_set = nodes.select("digest", "id")
    if known is not None:
        of_set = of_set.join(known.hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    else:
        of_set = of_set.withColumnRenamed("id", "component")
    rows = all_sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    # Rows without a set get a key of their own, so that they don't meet in one task.
    rows = rows.withColumn("digest", F.coalesce("digest", F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    # This join is planned by the caller, by estimates.
    out = rows.join(of_set.hint("merge"), "digest", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id; columns as they are."""
    gone = components(documents).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    names = [f"c{i}" for i in range(len(documents.columns))]
    docs = documents.toDF(*names)
    return docs.join(gone, docs[names[documents.columns.index("doc_id")]] == gone["gone_id"], "left_anti").toDF(*documents.columns)

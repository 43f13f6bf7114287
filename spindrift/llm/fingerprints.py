"""Operator 8: I-Match fingerprints, in DataFrame functions alone.

The lexicon holds the terms (hashed words) that between ``RARE`` and ``COMMON`` of
all documents have, two documents at least: a band of inverse document frequency. As
each of its terms is in RARE of the documents, it has at most (mean terms of a
document) / RARE terms, however many documents there are; a bitmap by the terms'
hashes, sized by their number, stands for it (a term whose bit is set by another term
counts as in the lexicon). The lexicon is dealt at random into ``SUBSETS`` subsets,
each term into one of them, so that they cover it together. A text's distinct terms
of the lexicon are sorted, and those of each subset are hashed: the fingerprint is
the list of these hashes. A text without any such terms, so with all subsets empty,
has the hashes of its whole instead.

Likeness of two fingerprints: the share of equal ones among the subsets that are
not empty in both; 1 for equal fingerprints.

Null texts are empty. Documents of equal doc_id are ordered by the hash of their
text; null ids come last in descending order. A lone document is its own next.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import collections
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import chunks_for, forget, stored
from spindrift.llm.decontaminate import bitmap, has_bit, words

RARE, COMMON = 0.0005, 0.1
#: A term's subset is told by its first BITS bits; those of the bitmap are its last.
BITS = 6
SUBSETS = 1 << BITS
#: Ranges of doc_id at most; their bounds go with the plan.
RANGES = 1 << 15
LAST_ID = -(1 << 63)


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), lambda w: F.xxhash64(w)))


def lexicon(documents: DataFrame) -> DataFrame:
    """term, df: the band of documents (text)."""
    n = documents.count()
    every = documents.select(F.explode(terms(F.col("text"))).alias("term"))
    return every.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(max(2, RARE * n), COMMON * n))


def hashes(kept: str, text: str) -> Column:
    """A hash for each subset of the lexicon, null where the text has no term of it; hashes of the whole text where it has none of any.

    kept is sorted, so the terms of a subset are neighbours: one pass closes a subset when the next begins.
    """
    subset = lambda t: F.shiftright(t, 64 - BITS).cast("int") + SUBSETS // 2
    gap = lambda n: F.array_repeat(F.lit(None).cast("bigint"), n)
    closed = lambda have: F.when(have["at"] < 0, have["done"]).otherwise(F.array_append(have["done"], have["hash"]))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("hash"))
    more = lambda have, t: F.struct(have["done"].alias("done"), have["at"].alias("at"), F.xxhash64(have["hash"], t).alias("hash"))
    other = lambda have, t: F.struct(F.concat(closed(have), gap(subset(t) - have["at"] - 1)).alias("done"), subset(t).alias("at"), F.xxhash64(t).alias("hash"))
    found = F.aggregate(kept, start, lambda have, t: F.when(subset(t) == have["at"], more(have, t)).otherwise(other(have, t)), lambda have: F.concat(closed(have), gap(SUBSETS - 1 - have["at"])))
    whole = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.xxhash64(text, s))
    return F.when(F.size(kept) == 0, whole).otherwise(found)


def written(found: str) -> Column:
    """The hashes in hexadecimal digits, "" for empty subsets."""
    return F.array_join(F.transform(found, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit(""))), ".")


def likeness(a: str, b: str) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), x.eqNullSafe(y).cast("int")))
    known = F.filter(pairs, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0), lambda s, x: s + x)
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(F.size(known) > 0, total / F.size(known)).otherwise(F.lit(0.0)).cast("double")


def fingerprint(df: DataFrame, bits: DataFrame, text: str, to: str) -> DataFrame:
    """df with the list of hashes of column ``text``."""
    df = df.withColumn("terms", terms(F.col(text))).withColumn("bitmap", bits.scalar())
    df = df.withColumn("kept", F.array_sort(F.filter("terms", has_bit))).drop("terms", "bitmap")
    return df.withColumn(to, hashes("kept", text)).drop("kept")


def range_of(value: Column, bounds: list[int]) -> list[Column]:
    """Steps of a binary search for how many of the bounds are below the value; each step is a function of column ``range`` before it."""
    size = 1 << max(1, len(bounds).bit_length())
    padded = F.from_json(F.lit(str([*bounds, *[(1 << 63) - 1] * (size - len(bounds))])), "array<bigint>")
    step, out = size // 2, []
    while step:
        out.append(F.col("range") + F.when(F.get(padded, F.col("range") + step - 1) < value, step).otherwise(0))
        step //= 2
    return out


def ranges(documents: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """Adds ``at``, ``tie`` (the order of documents) and ``range``, of which there are about n, to frames of documents.

    An id that many rows have fills several ranges, by the texts' hashes.
    """
    order = F.coalesce("doc_id", F.lit(LAST_ID))
    found = documents.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"]
    times = collections.Counter(found or [])
    bounds = sorted(times)
    hot = F.from_json(F.lit(json.dumps({str(b): k for b, k in times.items() if k > 1})), "map<string,int>")

    def ranged(df: DataFrame) -> DataFrame:
        df = df.withColumn("at", order).withColumn("tie", F.xxhash64("text")).withColumn("range", F.lit(0))
        for step in range_of(F.col("at"), bounds):
            df = df.withColumn("range", step)
        parts = F.try_element_at(hot, F.col("at").cast("string"))
        part = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * parts), parts - 1) + 1
        return df.withColumn("range", F.col("range").cast("long") * (2 * RANGES) + F.coalesce(part, F.lit(0)))

    return ranged


def with_next(documents: DataFrame, add: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """add(documents (doc_id, text)) with next_<c> for each carried column: those of the next document in descending order of ids, the first after the last."""
    n = max(2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks_for(documents, 16 << 20))
    # Several ranges a partition, so that partitions are alike.
    ranged = ranges(documents, min(8 * n, RANGES))
    # Each range's first document also stands, as a guard, at the end of the range before it: at most 2 * RANGES rows.
    every = ranged(documents)
    heads = every.groupBy("range").agg(F.max(F.struct("at", "tie")).alias("head"))
    around = Window.orderBy(F.desc("range"))
    to = F.coalesce(F.lag("range").over(around), F.first(F.col("range")).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(to.alias("to"), F.col("head.at").alias("head_at"), F.col("head.tie").alias("head_tie"))
    guards = every.join(F.broadcast(heads), (F.col("at") == F.col("head_at")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["to"])
    guards = guards.withColumn("range", F.col("to")).drop("to", "head_at", "head_tie").withColumn("guard", F.lit(1))
    both = every.withColumn("guard", F.lit(0)).unionByName(guards)
    # What is added is worked out behind the shuffle, once for each row.
    both = add(both.repartition(n, "range"))
    ordered = Window.partitionBy("range").orderBy("guard", F.desc("at"), F.desc("tie"))
    for c in carried:
        both = both.withColumn(f"next_{c}", F.lead(c).over(ordered))
    return both.filter("guard = 0").drop("guard", "at", "tie", "range")


def digests(documents: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edited texts, and their likeness."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = stored(lexicon(docs), "lexicon")
    # The bitmap is made once and read back as one row.
    bits = bitmap(band.select(F.col("term").alias("fp")), band.count())
    forget(band)
    docs = with_next(docs, lambda df: fingerprint(df, bits, "text", "own"), ["text", "own"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumn("edited", edited).drop("text", "next_text")
    docs = fingerprint(docs, bits, "edited", "other")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written("own").alias("fingerprint"),
        written("other").alias("edited_fingerprint"),
        likeness("own", "other").alias("near_edited"),
        likeness("own", "next_own").alias("near_next"),
    )

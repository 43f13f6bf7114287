"""Operator 3: benchmark decontamination by winnowing, in DataFrame functions alone.

Every window of ``WINDOW`` words has a fingerprint: the least hash of its runs of
``GRAM`` words. So each shared window shares its fingerprint, and no window that
is long enough can be missed. Neighbouring windows with one fingerprint are one
posting: its first place, and its words. Postings of documents that may have one of
the benchmark's fingerprints (a bitmap sized by their number, ``MOST_WORDS`` at most,
tells; it decides nothing) are joined with the benchmark's fingerprints, and hits are
extended: the words of each window of a hit are joined with the benchmark's windows.
A benchmark item with fewer words is one window of its own length; such lengths
(twelve at most) get fingerprints of their own.

Null texts and ids: a null text has no words; a null id is a document of its own
id. Rows with equal id and text count once. Very long texts are taken whole; an
empty benchmark hits nothing. Extra columns are ignored, and kept by clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import stored

WINDOW, GRAM = 13, 6
#: Windows of a posting at most.
POSTING = WINDOW - GRAM + 1
#: Bits of a bitmap for each of its entries, and its size at most in numbers of 64 bits (16 MB).
BITS_EACH, MOST_WORDS = 16, 1 << 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A-Z lower-cased, then the runs of characters that part no words."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN, -1), ""), F.array().cast("array<string>"))


def paired(df: DataFrame, old: str, new: str, shift: int, f) -> DataFrame:
    """Adds ``new``: f of each element of ``old`` and the one ``shift`` places on."""
    left = F.greatest(F.size(old) - shift, F.lit(0))
    return df.withColumn(new, F.zip_with(F.slice(old, F.lit(1), left), F.slice(old, F.lit(1 + shift), left), f))


def over(df: DataFrame, old: str, new: str, width: int, f) -> DataFrame:
    """Adds ``new``: f folded over each ``width`` neighbours of ``old``, by doubling; f may meet an element twice."""
    have, at, made = 1, old, []
    while have < width:
        shift = min(have, width - have)
        name = new if have + shift == width else f"{new}_{have + shift}"
        df = paired(df, at, name, shift, f)
        made.append(name)
        have, at = have + shift, name
    if width == 1:
        df = df.withColumn(new, F.col(old))
    return df.drop(*made[:-1])


def fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """df (words, ..) with fp_<n> for each length n: the fingerprint of the window of n words at each place."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    grams = sorted({min(GRAM, n) for n in lengths})
    for k in grams:
        df = over(df, "hashes", f"gram_{k}", k, lambda a, b: F.xxhash64(a, b))
    for n in lengths:
        df = over(df, f"gram_{min(GRAM, n)}", f"fp_{n}", n - min(GRAM, n) + 1, lambda a, b: F.least(a, b))
    return df.drop("hashes", *(f"gram_{k}" for k in grams))


def places(n: int) -> Column:
    return F.when(F.size(f"fp_{n}") > 0, F.sequence(F.lit(0), F.size(f"fp_{n}") - 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """item_id, n, fp, said for each window; and the window lengths that occur."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    short = [r["n"] for r in items.filter(F.size("words") < WINDOW).select(F.size("words").alias("n")).distinct().collect()]
    lengths = [WINDOW, *sorted(short)]
    found = fingerprints(items, lengths)
    window = lambda n: lambda i: F.struct(F.lit(n).alias("n"), F.get(f"fp_{n}", i).alias("fp"), F.array_join(F.slice("words", i + 1, F.lit(n)), " ").alias("said"))
    of_length = [F.when((F.size("words") == n) if n < WINDOW else (F.size("words") >= n), F.transform(places(n), window(n))) for n in lengths]
    return found.select("item_id", F.explode(F.coalesce(*of_length)).alias("w")).select("item_id", "w.n", "w.fp", "w.said"), lengths


def bitmap(entries: DataFrame, n: int) -> DataFrame:
    """One row: an array of 64-bit numbers with a bit for each of n 64-bit entries (fp), some of which may share one."""
    size = min(MOST_WORDS, 1 << max(10, (n * BITS_EACH // 64).bit_length()))
    place = F.col("fp").bitwiseAND(F.lit(64 * size - 1))
    some = entries.groupBy(F.shiftright(place, 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(fp & 63 as int))")).alias("bits"))
    every = entries.sparkSession.range(size).join(some, "id", "left")
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("bitmap")).first()
    return entries.sparkSession.createDataFrame([(row["bitmap"],)], "bitmap array<bigint>")


def has_bit(entry: Column) -> Column:
    """Is the entry's bit set in column ``bitmap``."""
    word = F.shiftright(entry, 6).bitwiseAND((F.size("bitmap") - 1).cast("long")).cast("int")
    return F.getbit(F.get("bitmap", word), entry.bitwiseAND(F.lit(63)).cast("int")) == 1


def postings(n: int) -> Column:
    """For windows of n words: n, i (the first of the posting's windows), fp, and the words of it and of those up to the next multiple of POSTING."""
    fp = lambda i: F.get(f"fp_{n}", i)
    heads = F.filter(places(n), lambda i: has_bit(fp(i)) & ((i % POSTING == 0) | (fp(i) != fp(i - 1))))
    return F.transform(heads, lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), fp(i).alias("fp"), F.slice("words", i + 1, F.lit(n + POSTING - 1) - i % POSTING).alias("said")))


KEYS = ["doc_id", "text_hash"]


def window_hits(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, hits). docs: doc_id, text_hash, n_words. hits: doc_id, text_hash, i (the first word of a window hit), n, said."""
    windows, lengths = benchmark_windows(benchmark)
    windows = stored(windows, "benchmark-windows")
    prints = windows.select("n", "fp").distinct()
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    docs = fingerprints(docs, lengths).withColumn("bitmap", bitmap(windows, windows.count()).scalar())
    docs = stored(docs.select(*KEYS, F.size("words").alias("n_words"), F.concat(*(postings(n) for n in lengths)).alias("postings")), "postings")
    some = docs.filter(F.size("postings") > 0).select(*KEYS, F.explode("postings").alias("p")).select(*KEYS, "p.*")
    same = some.join(prints, ["n", "fp"], "left_semi")
    each = same.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("said") - F.col("n"))))
    each = each.select(*KEYS, (F.col("i") + F.col("k")).alias("i"), "n", F.array_join(F.slice("said", F.col("k") + 1, F.col("n")), " ").alias("said"))
    return docs.drop("postings"), each.join(windows.select("item_id", "n", "said").distinct(), ["n", "said"]).select(*KEYS, "i", "n", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    docs, hits = window_hits(documents, benchmark)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    grown = lambda have, x: F.struct(F.greatest(have["end"], x["i"] + x["n"]).alias("end"), (have["n"] + F.greatest(x["i"] + x["n"] - F.greatest(have["end"], x["i"]), F.lit(0))).alias("n"))
    rows = docs.unionByName(hits, allowMissingColumns=True)
    spans = F.array_sort(F.collect_set(F.when(F.col("n").isNotNull(), F.struct("i", "n")))).alias("spans")
    found = rows.groupBy(*KEYS).agg(F.max("n_words").cast("long").alias("n_words"), spans, F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.withColumn("n_hit", F.aggregate("spans", start, grown, lambda x: x["n"]).cast("long"))
    return found.select(
        *KEYS,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(documents, benchmark).drop("text_hash")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated; columns as they are."""
    bad = contamination(documents, benchmark).filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    names = [f"c{i}" for i in range(len(documents.columns))]
    docs = documents.toDF(*names)
    same = docs[names[documents.columns.index("doc_id")]].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[names[documents.columns.index("text")]]) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti").toDF(*documents.columns)

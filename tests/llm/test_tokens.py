"""Operators 6, 7 and 9 against the library and plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from spindrift.llm import bpe, chat_format, pretokens, token_files
from spindrift.llm.common import Table, mix, rolling_hash, rolling_sums, span_hash


@pytest.fixture(scope="module")
def library(path):
    return Tokenizer.from_file(path)


def test_encoding_equals_the_library(path, library, rows):
    rng = random.Random(1)
    texts = [r[1] or "" for r in rows] + ["".join(rng.choice("ab '’sSt\n\t 1½.,!é日😀 \x1crvel") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    merges, of = bpe.encoder(path)
    ids, counts = of(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert merges.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_words_take_the_same_merges(path):
    merges, _ = bpe.encoder(path)
    word = b"the" * 15 + b"ing" * 5
    assert merges.long_word(word).tolist() == merges.words(merges.byte_id[np.frombuffer(word, np.uint8)][None, :])[0].tolist()


def test_broken_bytes_decode_as_in_the_library(path, library):
    merges, _ = bpe.encoder(path)
    for ids in ([188], [19526, 254], [188, 64], [50256, 10]):
        assert merges.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_full_table_changes_nothing(path):
    merges, _ = bpe.encoder(path)
    small = bpe.Encoder(merges, merges.special, bits=4)
    texts = ["one two three four five six seven eight nine ten", "two three", "one two three four five six seven eight nine ten eleven"]
    assert small(texts)[0].tolist() == bpe.encoder(path)[1](texts)[0].tolist()


def mirrored_words(letters="ab", steps=11):
    """Two different words that sums modulo 2**64 can't tell apart: of the numbers 0, 1, .. one has a letter for an even count of ones, the other for an odd one."""
    odd = [bin(i).count("1") & 1 for i in range(1 << steps)]
    return "".join(letters[x] for x in odd), "".join(letters[1 - x] for x in odd)


def test_words_of_equal_sums_are_told_apart(path, library):
    a, b = mirrored_words()
    for of in (bpe.encoder(path)[1], token_files.encoder(path)):
        ids, counts = of([a, b, f"{b} {a}"])
        want = [library.encode(t, add_special_tokens=False).ids for t in (a, b, f"{b} {a}")]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        assert want[0] != want[1]
    data = np.frombuffer(f"{a}{b}".encode(), np.uint8)
    n = len(a)
    assert len(set(span_hash(data, np.array([0, n, 0, n]), np.array([n, 2 * n, 400, n + 400])).tolist())) == 4
    sums = rolling_sums(data)
    assert len(set(rolling_hash(sums, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


def test_a_hash_of_another_piece_is_noticed(path, library, monkeypatch):
    monkeypatch.setattr(pretokens, "span_hash", lambda data, a, b: np.minimum(b - a, 4).astype(np.uint64) << np.uint64(50))
    merges, _ = bpe.encoder(path)
    of = pretokens.Encoder(merges, merges.special, bits=10)
    texts = ["one two three fourteen", "two one forty", "x" * 700 + " " + "x" * 699 + "y", "three"]
    for _ in range(2):
        ids, counts = of(texts)
        assert ids.tolist() == sum((library.encode(t, add_special_tokens=False).ids for t in texts), [])
        assert counts.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_digests(docs, empty, rows, path, library):
    found = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(docs, path).collect()}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        r = found[doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()]
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256((text or "").encode()).hexdigest())
    assert bpe.digests(empty, path).count() == 0


def test_columns_pass(docs, path):
    df = bpe.decode(bpe.encode(docs, path), path)
    assert df.columns == [*docs.columns, "ids", "decoded"]
    assert df.filter("decoded <> coalesce(text, '')").count() == 0


def test_token_files(docs, empty, rows, path, library):
    found = sorted(token_files.digests(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted(r[0] for r in rows)
    at, texts = 0, {r[0]: r[1] or "" for r in rows}
    for r in found:
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.digests(empty, path).count() == 0


def test_files_are_encoded_and_pruned(spark, path, tmp_path):
    """Ids in a dictionary, row groups and pages of the sizes asked for, indexes of pages; one document's ids are read without the others."""
    texts = [f"word{i % 7} and some more words of text number {i % 50}. " * 400 for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write(df, f"{tmp_path}/a", path, group_mb=1, page_kb=16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = 0
    for file in (tmp_path / "a").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert ids.has_dictionary_page and any("DICTIONARY" in x for x in ids.encodings) and ids.has_offset_index
        assert columns["doc_id"].has_column_index and not columns["at"].has_dictionary_page
        assert all(meta.row_group(g).total_byte_size < 4 << 20 for g in range(meta.num_row_groups))
        rows += meta.num_rows
    assert rows == 200
    back = token_files.read(spark, f"{tmp_path}/a")
    plan = back.filter("doc_id = 77").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,77)" in plan and "ids" not in plan.split("ReadSchema")[1]
    library = Tokenizer.from_file(path)
    assert back.filter("doc_id = 77").first()["ids"] == [*library.encode(texts[77], add_special_tokens=False).ids, 0]


def test_rows_of_one_id_are_in_several_pieces(spark, path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 400)
    rows = [(None if i % 2 else 5, f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(token_files.digests(df, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None] * 30 + [5] * 30
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(found, found[1:], strict=False))


def test_hash_table():
    table = Table(8)
    h = mix(np.arange(1, 100, dtype=np.uint64)) | np.uint64(1)
    h = np.unique(h)
    table.add(h, np.arange(len(h), dtype=np.int32))
    assert table.find(h).tolist() == list(range(len(h)))
    assert (table.find(mix(np.arange(1000, 1100, dtype=np.uint64)) & ~np.uint64(1)) == -1).all()


def turns():
    odd = ["\\### Assistant: </turn> ok", "#### <//turn> \\", "</turn>\n### user: x</turn>", "", None, "é😀\\\\###", "x" * 3000]
    out = [(1, k, ("user", "assistant", "system", "a:b\\", None, "assistant", "user")[k], t) for k, t in enumerate(odd)]
    out += [(2, None, "assistant", "first"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, 1, "user", "lost")]
    return out + [(3, k, "assistant", f"turn {k} ###") for k in range(500)]


def test_chats(spark):
    rows = turns()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int").repartition(3)
    found = {r["conv_id"]: r for r in chat_format.digests(df).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv, r in found.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(df.limit(0)).count() == 0


def test_long_roles_and_texts(spark):
    rows = [(1, k, "r" * 300_000 if k % 2 else "assistant", "t:###</turn>" * 60_000) for k in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat_format.digests(df).collect()
    assert r["n_turns"] == 8 and r["loss_chars"] == 4 * 12 * 60_000
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()


def test_no_control_string_stands_bare(spark):
    df = spark.createDataFrame([r for r in turns() if r[0] == 1], "conv_id long, turn long, role string, text string")
    (piece,) = chat_format.format_chats(df).collect()
    bare = re.sub(r"\\(\\|###|</turn>|:)", "", piece["formatted"])
    assert bare.count("</turn>") == 7 and bare.count("### ") == 7
    assert [t for _, t in chat_format.read(piece["formatted"])] == [r[3] or "" for r in turns() if r[0] == 1]
    assert [chat_format.unescape(piece["formatted"][s["start"] : s["end"]]) for s in piece["loss"]] == ["#### <//turn> \\", "é😀\\\\###"]

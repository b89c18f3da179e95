import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bitplane
from quillon.llm.bitplane import END, Encoder, cut_units, documents_in, encode_shard, fetch, from_planes, seek, to_planes, token_files, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = Encoder(PATH)


def brute(rows):
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("bits", [False, True])
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300))
@settings(max_examples=30, deadline=None)
def test_planes_round_trip(bits, ids):
    block = np.array(ids, "<u4")
    assert from_planes(to_planes(block, bits), len(block)).tolist() == ids
    cuts = [None if len(ids) % 3 else 7, 9]
    lengths = [len(ids) // 2, len(ids) - len(ids) // 2]
    data = encode_shard(block, cuts, lengths, (1, 2), bits, chunk_ids=16) + END
    got = list(documents_in(data + data))
    assert [g[1] for g in got] == cuts * 2 and np.concatenate([g[3] for g in got]).tolist() == ids * 2


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x1c", " ", "a", "B.", "it's", "12", "é", "😀", "!?", "　", "word"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_units_give_the_librarys_ids(text):
    assert np.frombuffer(OWN.encode_batch([text])[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_memo_of_two_generations(monkeypatch):
    monkeypatch.setattr(Encoder, "MOST_UNITS", 3)
    own = Encoder(PATH)
    texts = ["a bb  c", "dd bb\nc ee ", "a bb c dd", "<|endoftext|> x", "ff bb <|endoftext|> y\n\n", "", "é 😀 ü bb"]
    for _ in range(3):
        for t in texts:
            assert np.frombuffer(own.encode_batch([t])[0], "<u4").tolist() == LIBRARY.encode(t, add_special_tokens=False).ids or "<|" in t
    assert len(own.later) <= 12


def test_any_document_is_found_by_the_indexes():
    draw = np.random.default_rng(3)
    docs = [draw.integers(0, 50000, n).astype("<u4") for n in (0, 5, 16, 1, 40, 0, 33, 16)]
    for bits in (False, True):
        data = encode_shard(np.concatenate(docs), list(range(8)), [len(d) for d in docs], bits=bits, chunk_ids=16) + END
        data += encode_shard(docs[4], [4], [40], (0, 1), bits, 16) + END
        for k, d in enumerate(docs):
            assert [x.tolist() for x in seek(data, k)] == [d.tolist()] * (2 if k == 4 else 1)
        assert list(seek(data, 99)) == []


def test_fetch(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 50)) for i in range(200)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), PATH, shard_ids=500)
    got = {r.doc_id: r.ids for r in fetch(spark, str(tmp_path / "t"), [3, 149, 1000]).collect()}
    assert got == {i: [*LIBRARY.encode(rows[i][1], add_special_tokens=False).ids, 0] for i in (3, 149)}


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    assert sorted(map(tuple, token_files(spark.read.parquet(path), PATH).collect())) == sorted(brute(rows))


def test_edges(spark):
    rows = [(3, "b"), (1, None), (2, ""), (3, "a"), (3, "b"), (9, "x " * 50000), (5, "!" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    for bits in (False, True):
        assert sorted(map(tuple, token_files(df, PATH, bits=bits).collect())) == sorted(brute(rows))
    null = spark.createDataFrame([(None, "a"), (0, "b")], df.select("doc_id", "text").schema)
    assert {tuple(r)[:3] for r in token_files(null, PATH).collect()} == {(None, 0, 2), (0, 2, 2)}
    assert token_files(df.limit(0), PATH).count() == 0


def test_units_of_a_batch_are_cut_as_bytes():
    texts = ["left out", None, "", "a bb\ncc  dd ", "bb  cc  dd ᠎ x", "\n\n a", "é 😀\n—x\x85 y", " ", "a bb\ncc"]
    for kind in (pa.string(), pa.large_string()):
        got = OWN.encode_batch(pa.array(texts, kind).slice(1))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    raw, starts, units = cut_units(pa.array(texts[3:5]))
    assert [bytes(raw[a:b]).decode() for a, b in zip(units, units[1:])] == ["a", " bb", "\ncc  dd ", "bb  cc  dd ᠎ x"] and starts.tolist() == [0, 12, len(raw)]


def test_slices_by_bytes_hold_every_text(monkeypatch):
    monkeypatch.setattr(bitplane, "ENCODED_BYTES", 10)
    texts = ["x" * 4, None, "x" * 6, "", "x" * 50, "x", "x" * 10, "x"]
    parts = [b.column(0).to_pylist() for b in bitplane._in_bytes(pa.RecordBatch.from_arrays([pa.array(texts)], ["t"]), 0)]
    assert sum(parts, []) == texts and [sum(len(t or "") for t in p) for p in parts] == [10, 50, 1, 10, 1]

import zlib

import duckdb
import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import pieces as P

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = P.load(MODEL)
TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "aa", "aaa", "the", "ing", "tion", "é", "ñ", "😀", "漢", "1", "!?", P.BLANK, "word", "Xq", "\x00", "="]), max_size=14).map("".join)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_words_give_the_librarys_ids(text):
    assert np.frombuffer(OWN.encode_batch([text])[0], "<u4").tolist() == LIBRARY.encode(text)


def scanned(text, chunk):
    cut = [P.Chunk(OWN, *c[1:]) for c in P.chunks_of(text, OWN.longest, chunk)]
    states = P.resolve([c.matrix() for c in cut])
    return [x for c, i, j in zip(cut, states, states[1:], strict=False) for x in c.ids(i, j)]


@given(TEXT.filter(bool), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_scan_gives_the_librarys_ids(text, chunk):
    assert scanned(text, chunk) == LIBRARY.encode(text)


def test_scan_of_documents(spark):
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where length(text) between 1 and 3000 order by doc_id limit 25").fetchall():
        want = LIBRARY.encode(text)
        for chunk in (7, 64, 1000):
            assert scanned(text, chunk) == want
        bare = text.replace(" ", "")[:400]
        if bare:
            assert scanned(bare, 50) == LIBRARY.encode(bare)


def row(doc, text):
    ids = None if text is None else LIBRARY.encode(text)
    return doc, 0 if ids is None else len(ids), None if ids is None else zlib.crc32(np.array(ids, "<u4").tobytes()), None if ids is None else True


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_pieces", "ids_crc32", "round_trip").collect()), key=repr)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    want = sorted((row(*r) for r in duckdb.sql(f"select doc_id, text from '{path}'").fetchall()), key=repr)
    assert result(P.encode(docs, MODEL)) == want
    encoded = P.encode(docs, MODEL, giant=3000, chunk=1000)
    assert result(encoded) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a\n\n b"), (4, "a\n\n b"), (5, "z" * 5000), (6, "long words " * 700), (6, "long words " * 700), (None, "x"), (7, "\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("a", F.lit(1))
    assert result(P.encode(df, MODEL, giant=1000, chunk=300)) == sorted((row(*r) for r in rows), key=repr)
    back = P.decode(P.encode(df, MODEL, giant=1000, chunk=300), MODEL)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    assert P.encode(df.limit(0), MODEL).count() == 0

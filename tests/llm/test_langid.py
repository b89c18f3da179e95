import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillon.llm import langid as L

PATH = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy_and_brute_force(spark):
    docs = spark.read.parquet(PATH)
    model = L.fit(docs)
    rows = {r.doc_id: r for r in L.identify(docs, model).collect()}
    truth = duckdb.sql(f"select doc_id, text, lang from '{PATH}'").fetchall()
    held = [(d, lang) for d, _, lang in truth if zlib.crc32(str(d).encode()) % 4 == 2 and lang]
    assert {d for d, r in rows.items() if r.held_out} == {d for d, _, _ in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(rows[d].lang_pred == lang for d, lang in held) / len(held) > 0.95
    assert sum(r.rejected for r in rows.values()) < 0.02 * len(rows)
    # the same scores from the definition: average embeddings of n-grams one by one, then the softmax
    for d, text, _ in truth[:20]:
        data = b" " + b" ".join(bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode()).split()) + b" "
        vectors = []
        for n in L.SIZES:
            for i in range(len(data) - n + 1):
                h = data[i] + 1
                for b in data[i + 1 : i + n]:
                    h = (h * 0x01000193 + b + 1) % 2**32
                h = (h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) % 2**32
                vectors.append(model.embeddings[h >> (32 - L.BUCKET_BITS)])
        logits = (model.weights @ np.mean(vectors, axis=0) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        assert abs(p.max() / p.sum() - rows[d].score) < 1e-4
    kept = L.identify(docs, model, drop=True)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in rows.items() if not r.rejected}


def test_the_driver_holds_narrow_counts(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(L, "train", rows.extend)
    L.fit(spark.read.parquet(PATH))
    held = sum(a.nbytes for g, _ in rows for a in vars(g).values())
    assert len(rows) > 300 and held <= 4 * sum(len(g.buckets) for g, _ in rows)


def test_packed_counts_are_the_same():
    for text in ("a", "the house " * 40, "la " * 70000):
        g = L.Grams.of(text)
        p = L.Grams.packed(memoryview(g.buckets.tobytes()), memoryview(g.counts.tobytes()))
        whole = np.bincount(np.concatenate(list(L.ngrams(text))), minlength=1 << L.BUCKET_BITS)
        assert np.array_equal(p.buckets, np.flatnonzero(whole)) and np.array_equal(p.counts, whole[whole > 0])


def test_slices_change_nothing(monkeypatch):
    text = "Ein längerer Satz über ñandú, été and so on. " * 50
    whole = np.sort(np.concatenate(list(L.ngrams(text))))
    monkeypatch.setattr(L, "SLICE", 37)
    assert np.array_equal(np.sort(np.concatenate(list(L.ngrams(text)))), whole)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the house and the garden", "en"), (5, "das haus und der garten", "de"), (6, "a", None), (None, "the house", "en"), (7, "la " * 100000, "es")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = L.identify(df, L.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert all(r.lang_pred in ("en", "de", "es", "und") and 0 <= r.score <= 1 for r in got)
    assert L.identify(df.limit(0), L.fit(df.limit(0))).count() == 0
    none = L.identify(df, L.fit(df.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, False)}

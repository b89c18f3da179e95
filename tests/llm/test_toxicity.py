import itertools
import math
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import toxicity as X

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    return docs, X.fit(docs, labels)


def test_held_out_labels(spark, fitted):
    docs, model = fitted
    rows = {r.doc_id: r for r in X.score(docs, model).collect()}
    labels = [(d, y) for d, y in duckdb.sql(f"select doc_id, toxic from '{D}/labels.parquet'").fetchall() if zlib.crc32(str(d).encode()) % 4 == 2 and d in rows]
    bad = np.array([rows[d].score for d, y in labels if y == 1])
    good = np.array([rows[d].score for d, y in labels if y == 0])
    auc = ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2).item()
    recall, false = np.mean(bad >= 0.3), np.mean(good >= 0.3)
    print(auc, recall, false)
    assert auc > 0.93 and recall > 0.8 and false < 0.03
    assert all(rows[d].predicted == int(rows[d].score >= 0.3) and rows[d].held_out for d, _ in labels)


def test_disguised_words_are_restored(fitted):
    _, model = fitted
    for written, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("$cum", "scum"), ("tr@sh", "trash"), ("p4th3t1c", "pathetic"), ("d!sgust!ng", "disgusting")):
        assert plain.encode() in model.tokens(f"that is a {written} thing"), written
        assert model.score(f"that is a {written} thing") == pytest.approx(model.score(f"that is a {plain} thing"), abs=0.05)


def all_readings(written):
    for chosen in itertools.product(*X.lattice(written)):
        yield "".join(c for c, _ in chosen), sum(p for _, p in chosen)


@given(st.text("a1!0 iio", min_size=1, max_size=7))
@settings(max_examples=100, deadline=None)
def test_viterbi_against_all_readings(written):
    costs = X.CharacterModel(X.trigram_counts(["oil aioli ilia in a bio"])).costs

    def total(text, channel):
        codes = [0, 0, *map(X._code, text), 0]
        return channel + sum(costs[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    best = min(total(*r) for r in all_readings(written))
    got = X.viterbi(written, costs)
    assert min(total(t, p) for t, p in all_readings(written) if t == got) == pytest.approx(best)


def test_trigrams_grow_with_the_corpus(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id long, text string")
    one = X.corpus_trigrams(docs)
    assert np.array_equal(one, X.trigram_counts(["abc"])) or one.sum() >= X.trigram_counts(["abc"]).sum()
    assert X.corpus_trigrams(docs.union(docs)).sum() == 2 * one.sum()
    assert X.corpus_trigrams(docs.limit(0)).sum() == 0


def test_edges(spark):
    text = [(1, "you idiot"), (2, "nice day"), (3, None), (4, ""), (4, ""), (5, "x " * 200000), (6, "1" * 5000), (None, "a")]
    docs = spark.createDataFrame(text * 3, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (99, 1), (None, 1), (4, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = X.score(docs, X.fit(docs, labels)).collect()
    assert len(got) == 24 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    nothing = X.score(docs, X.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in nothing} == {0.0}
    assert X.score(docs.limit(0), X.fit(docs.limit(0), labels)).count() == 0
    assert math.isfinite(sum(r.score for r in got))


def test_letters_set_apart(fitted):
    _, model = fitted
    assert b"idiot" in model.tokens("the i d i o t there") and b"loser" in model.tokens("the l.o.s.e.r there")

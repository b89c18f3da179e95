import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann


def brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], np.float64)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        for rank, at in enumerate(sorted((x for x in range(len(ids)) if x != q), key=lambda x: (d[x], ids[x]))[:k], 1):
            yield int(ids[q]), rank, int(ids[at]), d[at]


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_on_whole_table(spark, size):
    path = f"/root/testdata/{size}/embeddings.parquet"
    rows = duckdb.sql(f"select vec_id, embedding from '{path}'").fetchall()
    got = ann.search(spark.read.parquet(path), F.col("id") % 100 == 0).collect()
    want = list(brute(rows))
    assert len(got) == len(want)
    found, true = {(r[0], r[2]) for r in got}, {(q, x) for q, _, x, _ in want}
    recall = len(found & true) / len(true)
    print(size, recall)
    assert recall >= 0.95
    by = dict(rows)
    for q, _, x, score in got[:200]:
        assert score == pytest.approx(np.linalg.norm(np.array(by[q]) - np.array(by[x])), abs=1e-12)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(2)
    good = [(i, draw.normal(size=8).tolist()) for i in range(100, 140)]
    same = [(i, [1.0] * 8) for i in [0, *range(200, 240), 300]]
    bad = [(400, None), (500, []), (600, [0.0] * 8), (700, [nan] + [1.0] * 7), (1, [inf] + [1.0] * 7), (2, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows = good + same
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("list", F.lit(2))
    got = sorted(map(tuple, ann.search(df, F.col("id") % 100 == 0, probed=1.0).collect()))
    want = sorted(brute(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    short = [(i, [float(i), 1.0, 2.0]) for i in range(900, 1004)]
    both = sorted(map(tuple, ann.search(spark.createDataFrame([*rows, *short], df.select("vec_id", "embedding").schema), F.col("id") % 100 == 0, probed=1.0).collect()))
    assert [g[:3] for g in both] == [w[:3] for w in sorted([*brute(rows), *brute(short)])]
    few = spark.createDataFrame(good[:4], df.select("vec_id", "embedding").schema)
    assert sorted(tuple(r)[:3] for r in ann.search(few, F.col("id") % 100 == 0).collect()) == sorted(w[:3] for w in brute(good[:4]))
    assert ann.search(few.limit(1), F.col("id") % 100 == 0).count() == 0
    assert ann.search(few.limit(0), F.col("id") % 100 == 0).count() == 0
    # lists and probes too few for k: every list is searched
    narrow = ann.search(df, F.col("id") % 100 == 0, probed=0.01, least_probed=1)
    assert narrow.groupBy("query_id").count().where("count < 10").count() == 0


def test_scan_abandons_but_keeps_the_nearest():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(20000, 64))
    rotate = ann.rotation(64)
    assert np.allclose(rotate @ rotate.T, np.eye(64))
    block, order, hit = ann.Block(x, rotate), np.arange(len(x)), 0
    for q in x[:40] + 0.1:
        got = {row for _, row in block.search(q, (q @ rotate).astype(np.float32), order, 10)}
        hit += len(got & set(((x - q) ** 2).sum(axis=1).argsort()[:10].tolist()))
    assert hit / 400 > 0.97

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    ids |= found
        yield doc, (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))


def test_against_brute_force_on_whole_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{d}/benchmark.parquet'").fetchall()
    got = decontaminate(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect()
    assert {r[0]: tuple(r[1:6]) for r in got} == dict(brute(docs, items))
    assert any(r.contaminated for r in got)


def test_edges(spark):
    items = [(1, "one two"), (2, "Two THREE"), (3, None), (4, "..."), (None, "four"), (5, " ".join(f"w{i}" for i in range(12))), (6, "été")]
    docs = [(1, None), (2, ""), (3, "..."), (4, "x ONE-two\n three y"), (4, "x ONE-two\n three y"), (5, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 z"), (6, "a été b"), (7, "four"), (8, "one two " * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")).withColumn("spans", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(df, bench).collect()
    want = brute(docs, [x for x in items if x[0] is not None])
    assert sorted((r[0], *r[1:6]) for r in got) == sorted((k, *v) for k, v in want)
    assert {r.spans for r in got if r.doc_id == 4} == {"2:16"}
    kept = decontaminate(df, bench, drop=True)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7]
    assert decontaminate(df.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(df, bench.limit(0)).collect())


@pytest.mark.parametrize("most", [400, 3000])
def test_items_for_several_automata(spark, most):
    """A benchmark beyond the bound of one automaton: the same hits, by several passes."""
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").limit(20)
    want = sorted(map(tuple, decontaminate(docs, items).collect()))
    assert sorted(map(tuple, decontaminate(docs, items, most_item_bytes=most).collect())) == want
    kept = {r.doc_id for r in decontaminate(docs, items, drop=True, most_item_bytes=most).collect()}
    assert kept == {r[0] for r in want if not r[5]}

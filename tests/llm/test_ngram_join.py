import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import common
from quillon.llm import ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(own):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for members in by.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    inner = len(own[a] & own[b])
                    if 100 * inner >= 75 * (len(own[a]) + len(own[b]) - inner):
                        root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids[r] = min(ids.get(r, d), d)
    return sorted((d, len(own[i]), ids[find(i)]) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted(map(tuple, df.collect()))


@given(st.lists(st.sampled_from(["a", "B", "c", " ", "\t", "\n", "\x1c", " ", "é", "xx "]), max_size=40).map("".join), st.integers(3, 9))
@settings(max_examples=200, deadline=None)
def test_shingles_are_those_of_the_definition(text, size):
    old, J.SLICE = J.SLICE, size
    try:
        cut = J.shingles(text)
    finally:
        J.SLICE = old
    assert len(cut) == len(sets(text)) and np.array_equal(cut, J.shingles(text))


@given(st.integers(3, 400), st.randoms(use_true_random=False), st.booleans())
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_key_unless_one_is_short_of_keys(size, draw, single):
    a = set(draw.sample(range(10**6), size))
    b = set(a)
    for _ in range(draw.randrange(size // 4 + 2)):
        if draw.random() < 0.5 and len(b) > 1:
            b.discard(draw.choice(sorted(b)))
        else:
            b.add(draw.randrange(10**6))
    x, y = (J.mix(np.array(sorted(s), np.uint64)) for s in (a, b))
    x.sort(), y.sort()
    assert J.linked(x, y) == (100 * len(a & b) >= 75 * len(a | b))
    if J.linked(x, y) and a != b:
        of = J.single_keys if single else J.sketch_keys
        short = any(len(k) < need for s in (x, y) for _, need, k in of(s))
        keys = [{int(v) for _, _, k in of(s) for v in k} for s in (x, y)]
        assert short or keys[0] & keys[1]


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    want = brute(rows)
    assert result(J.near_duplicates(spark.read.parquet(path))) == want
    assert any(c != d for d, _, c in want)


def copies(draw, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("heavy", [3, 16])
def test_large_groups_and_common_passages(spark, heavy, monkeypatch):
    """Groups of near copies, of which not all pairs are linked, and a passage in texts that aren't alike."""
    monkeypatch.setattr(J, "HEAVY", heavy)
    draw = random.Random(heavy)
    word = lambda: f"w{draw.randrange(5000)}"
    texts = []
    for n, edits in ((60, 3), (40, 8), (5, 2), (2, 1)):
        texts += copies(draw, [word() for _ in range(draw.choice([60, 150]))], n, edits)
    passage = [word() for _ in range(60)]
    for own in (10, 30, 40, 120):
        texts += [" ".join([*passage, *[word() for _ in range(own)]]) for _ in range(30)]
    texts += [" ".join(word() for _ in range(n)) for n in range(12) for _ in range(3)] + ["a b c", "a b c d", "A  b\tc"]
    texts += texts[:20] * 3
    draw.shuffle(texts)
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(J.near_duplicates(df)) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (5, "X"), (5, "X"), (6, "x y"), (7, "word " * 100000), (8, "word " * 50000), (4, "other words of one id and more of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit(1))
    assert result(J.near_duplicates(df)) == brute(rows)
    assert J.near_duplicates(df.limit(0)).count() == 0
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 6, 7]
    null = spark.createDataFrame([(None, "same text"), (3, "same text"), (None, "alone")], df.select("doc_id", "text").schema)
    assert {tuple(r) for r in J.near_duplicates(null).collect()} == {(None, 1, 3), (3, 1, 3), (None, 1, None)}
    assert J.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    import itertools

    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in set(itertools.chain(*edges)) if find(x) != x}
    got = J.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == want


def altered(draw, base, low, high):
    """A copy with some words replaced, dropped, added, or its end cut off."""
    w = list(base)
    for _ in range(draw.randrange(low, high + 1)):
        kind, j = draw.random(), draw.randrange(len(w))
        if kind < 0.5:
            w[j] = f"e{draw.randrange(10**6)}"
        elif kind < 0.65:
            del w[j : j + draw.randrange(1, 5)]
        elif kind < 0.8:
            w[j:j] = [f"i{draw.randrange(10**6)}" for _ in range(draw.randrange(1, 5))]
        elif kind < 0.9:
            w[j] = draw.choice(["aa", "bb"])
        else:
            w = w[: max(10, len(w) - draw.randrange(len(w) // 3 + 1))]
    return " ".join(w)


@pytest.mark.parametrize("seed", [2])
def test_families_that_share_a_passage(spark, seed, monkeypatch):
    """Copies altered in several ways, in families of which some share a passage, and none of which need hold its original."""
    draw = random.Random(seed)
    monkeypatch.setattr(J, "HEAVY", draw.choice([2, 4]))
    word = lambda: f"w{draw.randrange(3000)}"
    passage, texts = [word() for _ in range(60)], []
    for i in range(5):
        base = [word() for _ in range(draw.choice([20, 40, 80, 150]))]
        base = base[: len(base) // 2] + passage + base[len(base) // 2 :] if i % 2 else base
        low = draw.randrange(3)
        texts += [altered(draw, base, low, low + 4) for _ in range(draw.randrange(10, 50))]
        texts += [" ".join([*passage, *[word() for _ in range(draw.randrange(1, 30))]]) for _ in range(10)]
    draw.shuffle(texts)
    rows = list(enumerate(texts, 5))
    assert result(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_large_groups_do_not_make_all_their_pairs(spark, monkeypatch):
    """Near copies of one text, three times as many of them: what is compared grows in proportion."""
    compared = {}
    agreeing, sifted = J._agreeing, J._sifted
    monkeypatch.setattr(J, "_agreeing", lambda pairs, parts, name: compared.__setitem__(name, pairs.count()) or agreeing(pairs, parts, name))
    monkeypatch.setattr(J, "_sifted", lambda pairs, nodes, name: compared.__setitem__(name, pairs.count()) or sifted(pairs, nodes, name))
    made = []
    for n in (400, 1200):
        draw = random.Random(3)
        texts = list(copies(draw, [f"w{draw.randrange(5000)}" for _ in range(80)], n, 3))
        found = J.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
        groups = found.groupBy("component_id").count().orderBy(F.desc("count")).first()
        assert groups["count"] > 0.6 * n
        made.append(sum(compared.values()))
        compared.clear()
    assert made[0] < 6 * 400 and made[1] < 4 * made[0]


def test_one_of_each_group_stays(spark):
    """Rows go by their id and text: other texts of an id, and rows without an id, are told apart."""
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(4, near), (5, near + " x"), (5, "something else that is not alike"), (None, near), (None, "alone"), (5, near + " x"), (None, "alone"), (7, None), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__d_0", F.lit(1)).repartition(3)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(4, near), (5, "something else that is not alike"), (None, "alone"), (7, None), (7, None), (8, "")], key=str)


def test_what_is_written_between_steps_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(common._local_dirs, spark.sparkContext.applicationId, str(tmp_path))
    rows = [(i, " ".join(f"w{j}" for j in range(40) if j % 11 != i)) for i in range(30)]
    J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {p.name.rpartition("-")[0] for p in tmp_path.iterdir()} <= {"document-classes", "documents-that-stay"}

import collections
import hashlib
import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from quillon.llm import secrets as S

PATTERNS = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in collections.Counter(s).values())


def brute(text):
    text = text or ""
    base = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m))
    more = []
    for m in re.finditer(S.CANDIDATE, text):
        if re.search(S.ALLOWED, m[0]) or any(a < m.end() and b > m.start() for a, _, b in base):
            continue
        kind = 3 if re.fullmatch("[0-9a-fA-F]+", m[0]) else 4
        s = m[0].lower() if kind == 3 else m[0]
        best = max(entropy(s[i : i + S.WINDOW]) for i in range(len(s) - S.WINDOW + 1))
        if best >= S.LEAST_BITS[S.KINDS[kind]] - 1e-9:
            more.append((m.start(), kind, m.end()))
    say = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + more)), len(more))


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = duckdb.sql(f"select doc_id, text from '{path}'").fetchall()
    got = {r[0]: tuple(r[1:]) for r in S.scan(spark.read.parquet(path)).collect()}
    assert got == {d: brute(t) for d, t in rows}
    assert sum(v[0] + v[1] + v[2] for v in got.values()) > 5


def test_edges(spark):
    draw = random.Random(1)
    pick = lambda a, n: "".join(draw.choices(a, k=n))
    rows = [
        None, "", "token=token : abcdefgh", "PASSWORD: 'abc123'", "é😀 api_key=\"Zz09+/_.=-\" AKIA" + "A" * 15, "AKIA" + "B7" * 8, "xAKIAAKIA" + "C" * 16,
        "secret==abcdef token:= abcdefg", "deadbeef" * 3, "f" * 23, "ſecret=abcdefg", "toKen=abcdefg", "a\nb " + pick(S.BASE64, 44) + " c " + pick(S.BASE64, 30),
        "id " + "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "EXAMPLE" + pick(S.BASE64, 30), "DEADbeef01" * 3, pick("0123456789ABCDEF", 40),
        " ".join(f"token={pick('abcdef', 8)}é" for _ in range(2000)), pick(S.BASE64, 3000), "password=abcdefdeadbeefdeadbeefdeadbeefdead",
    ]
    rows = [(i, t) for i, t in enumerate(rows)] + [(3, "PASSWORD: 'abc123'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit(1)).withColumn("spans", F.lit("clash"))
    got = sorted(tuple(r) for r in S.scan(df).collect())
    assert got == sorted((d, *brute(t)) for d, t in rows)
    assert S.scan(df.limit(0)).count() == 0

import duckdb
from pyspark.sql import functions as F

from quillon.llm.line_dedup import oracle, without_boilerplate

D = "/root/testdata/sf0.01"


def result(df):
    return sorted(map(tuple, df.select("page.doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)


def test_against_sql_on_whole_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for ratio, least in ((0.05, 10), (0.02, 3)):
        want = duckdb.sql(oracle(f"'{D}/documents.parquet'", ratio, least)).fetchall()
        got = result(without_boilerplate(docs, ratio=ratio, min_pages=least))
        assert got == sorted(want, key=repr)
        assert any(r[2] for r in got) == (least == 3 or any(r[2] for r in want))


def test_edges(spark):
    long = "\n".join(f"line {i}" for i in range(5000))
    rows = [(1, "h", None), (2, "h", ""), (3, "h", "a\nb\n a \n\nc"), (3, "h", "a\nb\n a \n\nc"), (4, "h", "x\na\t"), (5, None, "a"), (6, "", "a\nq"), (7, "g", long), (8, "h", "a")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("page", F.lit("clash")).withColumn("lines", F.array(F.lit(1)))
    df = df.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    view = "(SELECT * FROM (VALUES " + ",".join(f"({d}, {'NULL' if s is None else repr(s)}, {'NULL' if t is None else chr(39) + t + chr(39)})" for d, s, t in rows) + ") v(doc_id, source, text))"
    got = result(without_boilerplate(df, ratio=0.5, min_pages=2))
    assert got == sorted(duckdb.sql(oracle(view, 0.5, 2)).fetchall(), key=repr)
    assert (3, 5, 2, "b\n\nc") in got and (8, 1, 1, "") in got and (1, 0, 0, None) in got
    assert without_boilerplate(df.limit(0)).count() == 0

import pyarrow as pa
from pyspark.sql import functions as F

from quillon.llm.common import ARROW_ROWS, BATCH_ROWS, materialized, sliced
from quillon.llm.ngram_join import _signed


def test_texts_go_to_python_in_short_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows] * batch.num_rows, pa.int64()), batch.column(0)], ["d", "t"])

    before = spark.conf.get(ARROW_ROWS)
    texts = spark.range(3000).coalesce(1).select(F.concat(F.lit("some words of text number "), "id").alias("t")).mapInArrow(sizes, "d long, t string")
    signed = _signed(texts)
    assert signed.count() == 3000 and signed.agg(F.max("d")).first()[0] <= BATCH_ROWS
    assert materialized(texts, "long-batches").agg(F.max("d")).first()[0] == 3000
    assert spark.conf.get(ARROW_ROWS) == before


def test_slices_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * BATCH_ROWS + 1))], ["x"])
    parts = list(sliced(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert [p.num_rows for p in parts] == [BATCH_ROWS, BATCH_ROWS, 1, 1]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(2 * BATCH_ROWS + 1), 5]

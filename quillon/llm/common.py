"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole texts go to Python and come back so many at a time, as both sides hold several batches of each task.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Of each application in local mode.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only in local mode, where
    there is one machine, a temporary folder takes its place; elsewhere its
    absence is an error, as executors would write where nobody else can read.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set; {master} needs a folder that all its machines share")
        path = _local_dirs.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="quillon-")
        _local_dirs[spark.sparkContext.applicationId] = path
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _with_settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles_freed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends: for queries whose rows are written and read again."""
    return _with_settings(spark, {SHUFFLE_CLEANUP: "true"})


def short_batches(spark: SparkSession, most: int = BATCH_ROWS):
    """Within it, a query that is planned sends ``most`` rows to Python at a time, or as many as the session says if those are fewer."""
    rows = int(spark.conf.get(ARROW_ROWS))
    return _with_settings(spark, {ARROW_ROWS: str(min(rows, most) if rows > 0 else most)})


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``BATCH_ROWS`` at a time, whatever the session's batches hold."""
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def materialized(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts lineage in a way that survives the loss of executors, and keeps an
    expensive Python stage from running once per consumer.  ``discard`` deletes
    the folder once nothing reads it any more.  ``texts``: whole texts go to Python.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_freed(spark), short_batches(spark) if texts else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``materialized`` wrote for these frames."""
    for frame in frames:
        if path := frame.__dict__.pop("_written_at", None):
            context = frame.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(id_column: str = "doc_id"):
    """True for the fold whose labels are never learned from: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over Arrow batches; Spark bounds a batch by rows and by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def bounded_sample(df: DataFrame, key: str, most: int, rows: int | None = None) -> DataFrame:
    """At most about ``most`` rows, picked by a hash of ``key``: the same rows at any partitioning.

    A hash threshold thins the rows where they lie, so that the final ordered
    limit handles little more than ``most`` rows.
    """
    rows = df.count() if rows is None else rows
    picked = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_003))
    if rows > most:
        share = min(1.0, 1.2 * most / rows + 50 / rows)
        df = df.where(picked < F.lit(int(share * 1_000_003) + 1))
    return df.orderBy(picked, F.col(key)).limit(most)

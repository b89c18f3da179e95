"""Approximate nearest neighbours by an adaptive dimension scan.

An inverted-file index: centroids are fitted on a bounded sample, every vector
is assigned to its nearest, and a query probes the lists of the nearest
centroids.  Within a list the vectors lie, rotated by a random orthogonal
matrix, in blocks of columns.  After each block the distance over the columns
seen so far is a sample of the whole one, and a hypothesis test abandons the
candidates whose distance can hardly be below the query's k-th best; for what
is left the distance of the original vectors is computed in double precision.

Scale: equal vectors are one entry with their k + 1 smallest ids (a window
whose group limit works before the shuffle), so that a vector that a third of
the rows share is scanned once.  Lists are cut into blocks of bounded size, and
so are the queries of a list; a task sees one block of each.

Defined results: vectors that are null, empty, zero, or hold a null or a
component that isn't finite take no part; vectors of different lengths have no
distance, so each length is searched by itself; rows that repeat an id count
once, with the smallest vector; a query
with fewer neighbours in its lists than asked for searches all lists; fewer
candidates than k are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, materialized

#: Centroids are fitted on at most so many vectors, and there are at most so many.
MOST_FITTED, MOST_LISTS = 20_000, 4096
#: A query probes as many lists as hold this share of the true neighbours of ``MOST_TRIED`` vectors within the sample, and the least number.
COVERED, MOST_TRIED, LEAST_PROBED = 0.985, 200, 8
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4096
COLUMNS = 16
#: Standard errors that a partial distance may be off before a candidate is abandoned.
EPSILON = 2.1
CHUNK = 2048


def _usable(v: Column) -> Column:
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(column, pa.Array):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def rotation(dimensions: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, seed: int = 5, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    out = []
    for part in range(0, len(vectors), 4096):
        d = (centroids**2).sum(axis=1) - 2 * vectors[part : part + 4096] @ centroids.T
        if n == 1:
            out.append(d.argmin(axis=1)[:, None])
        else:
            some = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
            out.append(np.take_along_axis(some, np.take_along_axis(d, some, axis=1).argsort(axis=1), axis=1))
    return np.concatenate(out) if out else np.zeros((0, n), np.int64)


def lists_to_probe(sample: np.ndarray, centroids: np.ndarray, k: int, covered: float = COVERED) -> int:
    """How many nearest lists hold the share ``covered`` of the k nearest others, for vectors of the sample.

    The sample is thinner than the whole, so its neighbours lie farther apart: the number is on the safe side.
    """
    own = _nearest(sample, centroids, 1)[:, 0]
    tried = np.linspace(0, len(sample) - 1, min(MOST_TRIED, len(sample))).astype(int)
    places = np.argsort(_nearest(sample[tried], centroids, len(centroids)), axis=1)
    ranks = []
    for i, at in enumerate(tried):
        d = ((sample - sample[at]) ** 2).sum(axis=1)
        d[at] = np.inf
        near = np.argsort(d)[: min(k, len(sample) - 1)]
        ranks += places[i, own[near]].tolist()
    return 1 + int(np.quantile(ranks, covered, method="higher")) if ranks else 1


class Block:
    """Vectors of one list, rotated and laid out in blocks of columns."""

    def __init__(self, vectors: np.ndarray, rotate: np.ndarray, columns: int = COLUMNS):
        self.vectors = vectors
        turned = (vectors @ rotate).astype(np.float32)
        self.cuts = list(range(0, vectors.shape[1], columns))
        self.columns = [np.ascontiguousarray(turned[:, c : c + columns]) for c in self.cuts]

    def search(self, query: np.ndarray, turned: np.ndarray, order: np.ndarray, k: int, epsilon: float = EPSILON) -> list[tuple[float, int]]:
        """The k nearest rows of the block as (squared distance, row); ``order`` decides ties."""
        size = self.vectors.shape[1]
        best: list[tuple[float, int, int]] = []
        for first in range(0, len(self.vectors), CHUNK):
            alive = np.arange(first, min(first + CHUNK, len(self.vectors)))
            if len(best) == k:
                bound, seen = best[-1][0], 0
                partial = np.zeros(len(alive), np.float32)
                for cut, block in zip(self.cuts, self.columns, strict=True):
                    gap = block[alive] - turned[cut : cut + block.shape[1]]
                    partial += np.einsum("ij,ij->i", gap, gap)
                    seen += block.shape[1]
                    # The test that the whole distance exceeds the bound; the last block keeps a margin for single precision.
                    allowed = bound * (seen / size) * (1 + epsilon / math.sqrt(seen)) ** 2 if seen < size else bound * 1.0001 + 1e-6
                    keep = partial <= allowed
                    alive, partial = alive[keep], partial[keep]
                    if not len(alive):
                        break
            if len(alive):
                exact = ((self.vectors[alive] - query) ** 2).sum(axis=1)
                if len(alive) > k:
                    some = np.flatnonzero(exact <= np.partition(exact, k - 1)[k - 1])
                    alive, exact = alive[some], exact[some]
                best = sorted([*best, *zip(exact.tolist(), order[alive].tolist(), alive.tolist(), strict=True)])[:k]
        return [(d, row) for d, _, row in best]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    probed: float | None = None,
    least_probed: int = LEAST_PROBED,
    most_lists: int = MOST_LISTS,
) -> DataFrame:
    """The ``k`` nearest other rows of each row where ``is_query`` (a condition on column ``id``).

    Returns query_id, rank (from 1), ``id_col``, score (Euclidean distance).
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"))
    sizes = [r.n for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    for i, size in enumerate(sizes):
        of_size = rows.where(F.size("v") == size) if len(sizes) > 1 else rows
        one = _search(of_size, size, is_query, k, id_col, probed, least_probed, most_lists)
        found = found.unionByName(one) if i else one
    return found


def _search(rows: DataFrame, size: int, is_query: Column, k: int, id_col: str, probed: float | None, least_probed: int, most_lists: int) -> DataFrame:
    """The same among rows (id, v) of vectors of one length."""
    spark = rows.sparkSession
    rows = materialized(rows.select("id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit("v"), "v").alias("b")), "vectors")
    by_id = Window.partitionBy("a", "b").orderBy("id")
    entries = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries = entries.groupBy("a", "b").agg(F.min("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))

    total = rows.count()
    lists = max(1, min(most_lists, round(math.sqrt(total))))
    sample = _matrix(pa.array([r.v for r in bounded_sample(rows.select("id", "v"), "id", MOST_FITTED, total).collect()]))
    centroids = fit_centroids(sample, lists)
    lists = len(centroids)
    shared = spark.sparkContext.broadcast((centroids, rotation(size)))
    wanted = lists_to_probe(sample, centroids, k) if probed is None else math.ceil(probed * lists)
    n_probed = min(lists, max(least_probed, wanted))

    def assign(n: int, keep: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _nearest(_matrix(batch.column("v")), shared.value[0], n)
                    lists = pa.array(near.tolist(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], [*keep, "lists"])

        return run

    entries = entries.mapInArrow(assign(1, ["a", "b", "v", "ids"]), "a long, b long, v array<double>, ids array<long>, lists array<int>")
    entries = materialized(entries.select("a", "b", "v", "ids", F.col("lists")[0].alias("list")), "ann-index")
    n_blocks = entries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = materialized(rows.where(is_query).select(F.col("id").alias("query_id"), "a", "b", "v"), "ann-queries")
    distinct = asked.groupBy("a", "b").agg(F.min("v").alias("v"))

    def scan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            block = Block(_matrix(left.v), shared.value[1])
            order = np.array([ids[0] for ids in left.ids])
            queries = _matrix(right.v)
            turned = (queries @ shared.value[1]).astype(np.float32)
            for i, (qa, qb) in enumerate(zip(right.a, right.b, strict=True)):
                near = [(d, x) for d, row in block.search(queries[i], turned[i], order, k + 1) for x in left.ids[row]]
                found += [(qa, qb, x, math.sqrt(d)) for d, x in sorted(near)[: k + 1]]
        return pd.DataFrame(found, columns=["a", "b", "id", "score"])

    def probe(queries: DataFrame, n: int) -> DataFrame:
        picked = queries.mapInArrow(assign(n, ["a", "b", "v"]), "a long, b long, v array<double>, lists array<int>")
        picked = picked.select("a", "b", "v", F.explode("lists").alias("list"))
        sizes = picked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
        grid = F.broadcast(n_blocks.join(sizes, "list"))  # a row a list: at most MOST_LISTS
        part = lambda n: F.pmod(F.xxhash64("a", "b"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = entries.join(grid, "list").select("a", "b", "v", "ids", "list", part("blocks").alias("block"), every("parts").alias("part"))
        right = picked.join(grid, "list").select("a", "b", "v", "list", every("blocks").alias("block"), part("parts").alias("part"))
        keys = ["list", "block", "part"]
        found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(scan, "a long, b long, id long, score double")
        best = Window.partitionBy("a", "b").orderBy("score", "id")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")

    near = materialized(probe(distinct, n_probed), "ann-near")
    if n_probed < lists:
        need = min(k + 1, total)
        got = near.groupBy("a", "b").count()
        short = materialized(distinct.join(got, ["a", "b"], "left").where(F.coalesce("count", F.lit(0)) < need).select("a", "b", "v"), "ann-short")
        if not short.isEmpty():
            near = near.join(short, ["a", "b"], "left_anti").unionByName(probe(short, lists))
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    pairs = asked.select("query_id", "a", "b").join(near, ["a", "b"]).where(F.col("id") != F.col("query_id"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", F.col("id").alias(id_col), "score")

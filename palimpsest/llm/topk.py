"""Exact top-k inner-product search over norm-sorted vectors.

Queries go in blocks against all candidates. The longest vectors of the table are searched first; a query's k-th
score among them is a floor that every task starts from. Each task takes its candidates by descending length, piece by
piece. A query is through with a task once its length times the piece's greatest length is below its floor or its
k-th score there; else a candidate is bounded by the inner product of the leading SVD-rotated components plus, by
Cauchy-Schwarz, the product of the lengths of the rest. Queries and candidates of a piece that reach no bound aren't
multiplied out, and tasks return only scores that reach the floor.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship, task
from .vectors import matrix, usable

#: Queries of one block, candidates of one piece, leading components of a partial sum, vectors that give the floor.
BLOCK, PIECE, HEAD, LONGEST = 8192, 512, 16, 4096
_LEAST = np.iinfo(np.int64).min


class BlockSearch:
    """The k best candidates for a block of integer queries, over any number of batches."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.turn = np.linalg.svd(queries, full_matrices=False)[2].T if len(queries) >= queries.shape[1] else np.linalg.svd(queries, full_matrices=True)[2].T
        turned = queries @ self.turn
        self.head, self.rest = turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1)
        self.length = np.linalg.norm(queries, axis=1)
        self.best = np.full((len(ids), k), _LEAST)
        self.of = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), _LEAST)
        self.products = 0

    def start_over(self) -> None:
        """Forget the candidates, but keep each query's k-th score as a floor for all others to come."""
        self.floor = np.maximum(self.floor, self.best[:, -1])
        self.best[:], self.of[:] = _LEAST, np.iinfo(np.int64).max

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(-np.linalg.norm(vectors, axis=1), kind="stable")
        for i in range(0, len(order), PIECE):
            take = order[i : i + PIECE]
            self._piece(ids[take], vectors[take])

    def _piece(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        turned = vectors @ self.turn
        length = np.linalg.norm(vectors, axis=1)
        rest = np.linalg.norm(turned[:, HEAD:], axis=1)
        slack = 1e-9 * length[0] * self.length + 1e-6
        least = np.maximum(self.best[:, -1], self.floor)
        going = np.flatnonzero(self.length * length[0] + slack >= least)
        for j in range(0, len(going), 1024):
            q = going[j : j + 1024]
            bound = self.head[q] @ turned[:, :HEAD].T + self.rest[q, None] * rest + slack[q, None]
            may = (bound >= least[q, None]) & (ids != self.ids[q, None])
            hit, there = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
            if not len(hit):
                continue
            q, may = q[hit], may[np.ix_(hit, there)]
            # whole products of 64-bit floats are exact below 2**53; beyond, Python's integers
            exact = self.queries[q] @ vectors[there].T if self.length[q].max() * length[0] < 2**52 else self._long(q, vectors[there])
            self.products += int(may.sum())
            score = np.where(may, exact, float(_LEAST)).astype(np.int64) if exact.dtype != object else np.where(may, exact, _LEAST).astype(np.int64)
            score = np.concatenate([self.best[q], score], axis=1)
            of = np.concatenate([self.of[q], np.where(may, ids[there], np.iinfo(np.int64).max)], axis=1)
            top = np.lexsort((of, -np.maximum(score, -np.iinfo(np.int64).max)), axis=1)[:, : self.k]
            self.best[q], self.of[q] = np.take_along_axis(score, top, 1), np.take_along_axis(of, top, 1)

    def _long(self, q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        exact = np.array([[int(x) for x in r] for r in self.queries[q]], object) @ np.array([[int(x) for x in r] for r in vectors], object).T
        return np.clip(exact, _LEAST + 1, np.iinfo(np.int64).max)

    def rows(self) -> pa.RecordBatch:
        there = (self.best != _LEAST) & (self.best >= self.floor[:, None])
        query = np.broadcast_to(self.ids[:, None], there.shape)
        return pa.RecordBatch.from_arrays([pa.array(query[there]), pa.array(self.of[there]), pa.array(self.best[there])], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column | str, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` greatest inner products of floor(scale * x), ties to smaller ids.

    Rows that ``is_query`` holds for are searched against every row with another vec_id. Vectors that are null, empty
    or hold null or non-finite components, and rows without an id, take no part; vectors of different sizes count
    as filled up with zeros. Repeated rows are repeated candidates and, as queries, one query. Scores beyond a long
    are held at its ends. Columns other than vec_id and embedding are ignored. Only one block of queries and the LONGEST
    vectors are on the driver at a time; a block is one scan of the candidates.
    """
    spark = vectors.sparkSession
    ship(spark)
    fine = usable(vectors).select(F.col("vec_id").cast("long"), "embedding")
    scratch = Scratch(spark)
    queries = scratch.save(fine.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    blocks = max(1, -(-queries.count() // block))
    # longest first: within a task for its bounds, over the table for the floor
    size = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    longest = fine.orderBy(size.desc(), "vec_id").limit(LONGEST).toArrow().combine_chunks()
    fine = fine.withColumn("size", size).sortWithinPartitions(F.desc("size")).drop("size")
    parts = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = rows.column("vec_id").to_numpy()
        if not len(ids):
            continue
        ints = np.floor(matrix(rows.column("embedding").combine_chunks()) * scale)
        first = BlockSearch(ids, ints, k)
        first.add(longest.column("vec_id").to_numpy(), np.floor(matrix(longest.column("embedding").combine_chunks(), ints.shape[1]) * scale))
        first.start_over()
        held = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = None
            for batch in batches:
                if batch.num_rows:
                    search = search or copy.deepcopy(held.value)
                    search.add(batch.column("vec_id").to_numpy(), np.floor(matrix(batch.column("embedding"), search.queries.shape[1]) * scale))
            if search:
                yield search.rows()

        found = fine.mapInArrow(task(run), "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks == 1:
            return best
        parts.append(scratch.save(best, f"block-{b}"))
        held.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return parts[0] if len(parts) == 1 else parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[f"{scratch.root}/block-{b}" for b in range(blocks)])

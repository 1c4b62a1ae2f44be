"""Exact top-k search by inner product: tiled matrix products, selection in each tile, and merges in a tree.

Query vectors are written to the shared folder in tiles of bounded size. Candidates are not shuffled: each task gathers
its candidates to tiles, maps one query tile after another, takes their matrix product, and emits each query's k best of
the candidate tile. Lists are then merged in a tree: each level merges up to `fan` lists of a query, until one is left.
Memory is bounded by the tile sizes, whatever the number of queries; no task holds all queries.

Components are floor(scale * x), so products are integers. They are exact: as products of doubles as long as no sum can
reach 2^53 (a bound is checked for each tile), with Python's integers beyond; scores beyond 64 bits are
clipped to them, and rank as clipped.

Ties go to smaller ids. Defined results: rows with a null id take no part, nor do vectors that are null, empty, or hold
null or non-finite components. A query is compared with vectors of its own length. Candidates that have the query's id
are its own row, however often it repeats; a repeated query row is answered once for each different vector. Empty
tables, or no queries, give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulespark.llm.common import map_file, shared_folder, write_file

#: A sum of products below this is exact in doubles, also after the column number is packed in.
EXACT = 2**53


def _matrix(batch: pa.RecordBatch, dim: int, scale: int) -> np.ndarray:
    return np.floor(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim) * scale)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best among vectors, whose ids ascend. Vectors of the query's id are left out."""
    n = len(ids)
    largest = (np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
    k = min(k, n)
    if float(largest[0]) * float(largest[1]) * queries.shape[1] * 2 * (n + 1) < EXACT:
        packed = (-queries) @ vectors.T  # column - score * n: one number that ranks by score, then by id
        packed *= n
        packed += np.arange(n)
        left, right = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
        for i in np.flatnonzero(left < right).tolist():
            packed[i, left[i] : right[i]] = np.inf
        at = np.argpartition(packed, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), packed.shape)
        found = np.take_along_axis(packed, at, axis=1)
        row, col = np.nonzero(found < np.inf)
        at = at[row, col]
        return row, ids[at], ((at - found[row, col]) / n).astype(np.int64)
    rows, cols, scores = [], [], []
    exact = [[int(x) for x in v] for v in vectors.tolist()]
    for i, q in enumerate(queries.tolist()):
        q = [int(x) for x in q]
        clipped = (max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))) for v in exact)
        own = sorted((-s, j) for j, s in enumerate(clipped) if ids[j] != query_ids[i])[:k]
        rows += [i] * len(own)
        cols += [j for _, j in own]
        scores += [-s for s, _ in own]
    return np.array(rows, np.int64), ids[np.array(cols, np.int64)], np.array(scores, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_tile: int = 256, tile: int = 16_384, fan: int = 16) -> DataFrame:
    """query_id, rank (from 1), id_col and score of the k best vectors for each row of queries."""
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        lean = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return lean.where(F.col("id").isNotNull() & (F.size("v") > 0) & whole)

    folder = shared_folder(spark, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, held = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0, {}

        def flush(dim: int) -> None:
            nonlocal number
            rows = held.pop(dim)
            write_file(f"{folder}/{own}-{number:06d}.ids", iter([np.concatenate([r[0] for r in rows]).astype("<i8").tobytes()]))
            write_file(f"{folder}/{own}-{number:06d}.vec", iter([np.concatenate([r[1] for r in rows]).astype("<f8").tobytes()]))
            number += 1

        for dim, ids, matrix in _runs(batches, scale, query_tile):
            held.setdefault(dim, []).append((ids, matrix))
            if sum(len(r[0]) for r in held[dim]) >= query_tile:
                flush(dim)
        for dim in list(held):
            flush(dim)
        yield pa.RecordBatch.from_pylist([{"own": own, "tiles": number}], schema=pa.schema([("own", pa.string()), ("tiles", pa.int64())]))

    # The tiles that count are those of the attempts that ended well: a line for each task.
    tasks = sorted((r.own, r.tiles) for r in valid(queries).distinct().mapInArrow(write, "own string, tiles long").collect())
    return _search(valid(vectors), folder, tasks, k, id_col, scale, tile, fan)


def _runs(batches: Iterator[pa.RecordBatch], scale: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of at most so many vectors of one length."""
    for batch in batches:
        dims = np.asarray(batch.column(1).value_lengths())
        for dim in np.unique(dims).tolist():
            rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
            matrix, ids = _matrix(rows, dim, scale), np.asarray(rows.column(0))
            for start in range(0, len(ids), most):
                yield dim, ids[start : start + most], matrix[start : start + most]


def _search(candidates: DataFrame, folder: str, tasks: list[tuple[str, int]], k: int, id_col: str, scale: int, tile: int, fan: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("tile", pa.int64()), ("asked", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, {}

        def flush(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = held.pop(dim)
            ids, vectors = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
            order = np.argsort(ids, kind="stable")
            ids, vectors, own = ids[order], vectors[order], part * 1_000_003 + number
            number += 1
            names = (f"{folder}/{task}-{i:06d}" for task, tiles in tasks for i in range(tiles))
            for t, name in enumerate(names):
                asked = np.asarray(map_file(f"{name}.ids", "<i8"))
                wanted = map_file(f"{name}.vec", "<f8").reshape(len(asked), -1)
                if wanted.shape[1] != dim:
                    continue
                q, found, scores = best(np.asarray(wanted), asked, vectors, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(np.full(len(q), own)), pa.array(t * 1_000_003 + q), pa.array(found), pa.array(scores)], schema=schema)

        for dim, ids, matrix in _runs(batches, scale, tile):
            held.setdefault(dim, []).append((ids, matrix))
            if sum(len(r[0]) for r in held[dim]) >= tile:
                yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    lists = candidates.mapInArrow(run, "query_id long, tile long, asked long, id long, score long")
    parts = candidates.rdd.getNumPartitions()
    order = [F.col("score").desc(), F.col("id").asc()]
    groups = parts
    while True:  # a level of the tree: lists of fan tiles become one, then one list is left
        groups = -(-groups // fan)
        key = ["query_id", "asked"] if groups <= 1 else ["query_id", "asked", "tile"]
        lists = lists.withColumn("tile", F.pmod(F.xxhash64("tile"), F.lit(groups)))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
        if groups <= 1:
            return lists.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        lists = lists.drop("rank")

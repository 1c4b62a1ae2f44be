"""Connected components of a graph of ids, by forests of blocks of edges and rounds of contraction.

Each block of edges is first replaced by stars: each of its ids with the least that it reaches there. So of many edges
between few ids only a forest is left, and nothing grows. Once so few edges are left that one task holds them, it solves
them. Else every node moves to the neighbour of least pseudo-random priority, or stays if its own is less; edges move
along, and loops and repeated edges go. The expected number of nodes with edges falls by a constant factor in each round
whatever the graph's shape, so rounds grow with the logarithm of the number of nodes, for chains as well. Priorities
change by round. Then the moves are composed backwards, and each component is named by its least id.

A hot node has one row for each of its edges; minima are combined before the shuffle, and joins on it can be split by
adaptive execution. Nothing but counts comes to the driver, unless local_edges allows so many edges there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Edges of a block that a task replaces by stars: 16 MB, and some hundred MB while it does.
BLOCK_EDGES = 1_000_000
#: Edges that one task solves at the end; more are contracted.
TASK_EDGES = 2_000_000


def union_find(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Least id of the component, of each id in edges."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def least_ids(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in edges a-b, ascending, and the least id of the component of each."""
    ids, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := root[root], root):
            root = further


def stars(batches: Iterable[pa.RecordBatch], block: int | None) -> Iterator[pa.RecordBatch]:
    """Each id in a block of edges with the least that it reaches there, without the least ones themselves. A block is
    taken on while it shrinks by half; without a size, it is all edges, and the least ids come as well."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve() -> tuple[np.ndarray, np.ndarray]:
        ids, roots = least_ids(*map(np.concatenate, zip(*held, strict=True)))
        keep = (ids != roots) | (block is None)
        return ids[keep], roots[keep]

    def send(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        if block is not None and sum(len(x) for x, _ in held) >= block:
            held = [solve()]
            if 2 * len(held[0][0]) > block:
                yield from send(*held[0])
                held = []
    if held:
        yield from send(*solve())


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of the same components as edges a-b: a forest for each block of them, without loops. No shuffle."""
    block = BLOCK_EDGES
    return edges.select("a", "b").mapInArrow(lambda batches: stars(batches, block), "a long, b long")


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None, local_edges: int = 0) -> DataFrame:
    """(id, root) of every id in edges, a DataFrame of two columns of ids; root is the least id of the component.

    cut: ends a DataFrame's lineage, DataFrame.checkpoint by default. Edges with a null end are left out, loops give
    their id as its own root, and no edges give no rows.
    """
    cut = cut or DataFrame.checkpoint
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna()
    if local_edges:
        some = edges.limit(local_edges + 1).collect()
        if len(some) <= local_edges:
            return edges.sparkSession.createDataFrame(list(union_find([(x.a, x.b) for x in some]).items()), "id long, root long")
    nodes = cut(edges.where("a = b").select(F.col("a").alias("id")).distinct())  # loops
    moves: list[DataFrame] = []
    left = cut(forest(edges.where("a <> b")))
    least = False  # whether the last moves are to least ids of components
    while n := left.count():
        if n <= TASK_EDGES:
            solved = left.coalesce(1).mapInArrow(lambda batches: stars(batches, None), "a long, b long")
            moves.append(cut(solved.select(F.col("a").alias("id"), F.col("b").alias("to"))))
            least = len(moves) == 1
            break
        salt = F.lit(len(moves))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = F.min(F.struct(F.xxhash64("b", salt).alias("p"), F.col("b").alias("to")))
        move = both.groupBy("a").agg(best.alias("m")).select(F.col("a").alias("id"), F.least("m", F.struct(F.xxhash64("a", salt).alias("p"), F.col("a").alias("to")))["to"].alias("to"))
        move = cut(move)
        moves.append(move)
        ends = left.join(move.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = cut(forest(ends.where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    if not moves:
        return nodes.select("id", F.col("id").alias("root"))
    found = moves.pop()
    while moves:
        later = found.select(F.col("id").alias("to"), F.col("to").alias("root"))
        found = moves.pop().join(later, "to", "left").select("id", F.coalesce("root", "to").alias("to"))
    # Loops of ids that have other edges are no news.
    if not nodes.isEmpty():
        found = found.unionByName(nodes.join(found, "id", "left_anti").select("id", F.col("id").alias("to")))
    if least:
        return found.select("id", F.col("to").alias("root"))
    found = cut(found)
    least_of = found.groupBy("to").agg(F.min("id").alias("root"))
    return found.join(least_of, "to").select("id", "root")

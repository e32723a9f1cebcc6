"""Nearest neighbours by inner product: a k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hinterland.llm.sampling import hashed_sample
from hinterland.llm.scratch import Scratch

#: Rows that the tree is fitted on and calibrated with at most, by the order of a hash of their ids.
SAMPLE = 8192
BRANCH, LEAF, ROUNDS = 8, 96, 8
#: Mean recall that the number of visited leaves is widened to, on queries of the sample.
RECALL, CALIBRATION = 0.97, 256
#: Rows and queries of a leaf that meet in one task at most.
BLOCK = 4096


@dataclass
class Tree:
    """Inner node i has ``centres[i]`` and ``children[i]``; a child c < 0 is leaf ``-c - 1``."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1

    def leaf_order(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a priority queue of branches opens them."""
        if not self.centres:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -node - 1
                continue
            near = self.centres[node] @ query
            for value, child in zip(near, self.children[node]):
                heapq.heappush(queue, (-float(value), child))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre, level by level."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))] if self.centres else []
        while todo:
            node, own = todo.pop()
            pick = _nearest(rows[own], self.centres[node])
            for i, child in enumerate(self.children[node]):
                part = own[pick == i]
                if child < 0:
                    out[part] = -child - 1
                elif len(part):
                    todo.append((child, part))
        return out


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def _split(rows: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """k-means; None when the rows don't fall into two clusters or more."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) < 2:
        return None
    centres = distinct[random.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)]
    for _ in range(ROUNDS):
        pick = _nearest(rows, centres)
        centres = np.stack([rows[pick == i].mean(0) for i in range(len(centres)) if (pick == i).any()])
    pick = _nearest(rows, centres)
    return (centres, pick) if len(np.unique(pick)) > 1 else None


def fit_tree(sample: np.ndarray, k: int, recall: float = RECALL) -> Tree:
    """Fit on the sample, then widen ``visits`` until its own queries reach ``recall``."""
    tree, random = Tree(), np.random.default_rng(7)
    todo = [(sample, None, 0)]
    while todo:
        rows, parent, place = todo.pop(0)
        found = _split(rows, random) if len(rows) > LEAF else None
        if found is None:
            name = -tree.leaves - 1
            tree.leaves += 1
        else:
            name = len(tree.centres)
            tree.centres.append(found[0])
            tree.children.append([0] * len(found[0]))
            todo += [(rows[found[1] == i], name, i) for i in range(len(found[0]))]
        if parent is not None:
            tree.children[parent][place] = name
    if not tree.centres:
        tree.leaves = 1
        return tree
    leaf = tree.assign(sample)
    step = max(1, len(sample) // CALIBRATION)
    reached = np.zeros(tree.leaves)
    queries = range(0, len(sample), step)
    for q in queries:
        score = sample @ sample[q]
        score[q] = -np.inf
        best = np.argsort(-score)[:k]
        rank = np.empty(tree.leaves, int)
        rank[list(tree.leaf_order(sample[q]))] = np.arange(tree.leaves)
        reached += np.cumsum(np.bincount(rank[leaf[best]], minlength=tree.leaves)) / len(best)
    tree.visits = int(np.argmax(reached / len(queries) >= recall)) + 1
    return tree


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Double sums over the components in their order, so equal vectors have equal scores."""
    total = np.zeros((len(queries), len(rows)))
    for d in range(queries.shape[1]):
        total += queries[:, d, None] * rows[None, :, d]
    return total


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def nearest_neighbours(
    vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each
    row whose id is divisible by ``every``.

    Every row lies in one leaf. A query opens leaves by a priority queue, as many as the
    calibration found necessary, and more until they hold k others. Leaves are cut into
    blocks of rows and of queries, so a leaf with most of the rows is many tasks; blocks return
    their best, which are ranked again, ties to the smaller id.

    Vectors that are NULL, zero, hold NULL or non-finite components or are not of the most
    frequent length take no part, nor do rows without an id. A query's own row is any with its id;
    rows that repeat an id are candidates of their own, and of queries the smallest vector
    counts. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & sound & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width = lengths["d"] if lengths else 1
    rows = rows.where(F.size("vector") == width)
    hashed = rows.select(F.xxhash64("vec_id").alias("h"), "vector")
    picked = hashed_sample(hashed, "h", lengths["count"] if lengths else 0, SAMPLE).select("vector").toArrow()
    tree = fit_tree(_matrix(picked.column(0), width), k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], ["vec_id", "vector", "leaf"])

    placed = scratch.keep(rows.mapInArrow(place, "vec_id long, vector array<double>, leaf int"), "placed")
    # One number for each leaf; the sample bounds how many there are.
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    held = np.array([sizes.get(i, 0) for i in range(tree.leaves)])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaves = [], []
            for i, query in enumerate(_matrix(batch.column(1), width)):
                met = 0
                for n, leaf in enumerate(tree.leaf_order(query)):
                    if n >= tree.visits and met > k:
                        break
                    if held[leaf]:
                        met += held[leaf]
                        ids.append(i)
                        leaves.append(leaf)
            take = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int32())],
                ["query_id", "query", "leaf"])

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(
        F.min("vector").alias("vector"))
    visits = scratch.keep(
        queries.mapInArrow(visit, "query_id long, query array<double>, leaf int"), "visits")
    asked = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
    cuts = [(i, -(-int(held[i]) // BLOCK), -(-asked[i] // BLOCK)) for i in asked]
    blocks = F.broadcast(spark.createDataFrame(cuts, "leaf int, row_blocks int, query_blocks int"))

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = placed.join(blocks, "leaf").select(
        "leaf", "vec_id", "vector", F.pmod(F.xxhash64("vec_id", "vector"), "row_blocks").cast("int").alias("r"),
        spread("query_blocks").alias("q"))
    right = visits.join(blocks, "leaf").select(
        "leaf", "query_id", "query", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int").alias("q"),
        spread("row_blocks").alias("r"))

    def best(some: pa.Table, queries: pa.Table) -> pa.Table:
        ids = some.column("vec_id").to_numpy()
        mine = queries.column("query_id").to_numpy()
        x = _matrix(some.column("vector"), width) if len(ids) else np.zeros((0, width))
        y = _matrix(queries.column("query"), width) if len(mine) else np.zeros((0, width))
        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(mine), 256):
            score = inner_products(y[at:at + 256], x)
            for i, line in enumerate(score):
                other = np.flatnonzero(ids != mine[at + i])
                top = other[_top(line[other], ids[other], k)]
                out[0].append(np.full(len(top), mine[at + i]))
                out[1].append(ids[top])
                out[2].append(line[top])
        join = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(join[0].astype(np.int64)),
                         "vec_id": pa.array(join[1].astype(np.int64)), "score": pa.array(join[2])})

    keys = ["leaf", "r", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

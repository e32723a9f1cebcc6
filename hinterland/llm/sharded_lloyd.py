"""Lloyd's k-means with the dimensions dealt to shards.

A shard holds some columns of all vectors. With its slice of the centroids it knows an exact
part of every squared distance; adding the parts of all shards by rows gives the distances, and
the nearest centroid of each row goes back to the shards, each of which updates its own slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch

WIDTH = 64
SCALE = 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
#: Columns of a shard, and rows whose columns travel as one record.
COLUMNS, ROWS = 32, 1024
#: Records that are turned into distances at once.
_RECORDS = 32
#: Larger components could overflow the 64 bits of a squared distance.
LARGEST = 2**27

_SHARD = "block int, part long, n int, ids array<long>, x binary"
_PART = "part long, n int, size int, d binary"


def _whole(x: np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(scale * x)
    if np.abs(x).max(initial=0) >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale:.0f} or more are too large")
    return x.astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    """Row-wise whole numbers in the fewest bytes that hold them all, least byte first."""
    most = int(np.abs(x).max(initial=0))
    size = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return np.ascontiguousarray(x, f"<i{size}").tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    size = len(data) // max(n * width, 1) or 8
    return np.frombuffer(data, f"<i{size}").reshape(n, width).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, _RECORDS):
            yield batch.slice(a, _RECORDS)


def kept_vectors(vectors: DataFrame, width: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows with exactly ``width`` components, all of them finite."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where((F.size("vector") == width) & sound)


def column_blocks(rows: DataFrame, width: int, scale: int, columns: int) -> DataFrame:
    """``block, part, n, ids, x``: for each run of up to ``ROWS`` rows a record of each block of
    columns, without a shuffle. The ids lie in the first block only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = _whole(x, scale)
            for a in range(0, len(x), ROWS):
                some = x[a:a + ROWS]
                part, ids = batch.column("row")[a].as_py(), batch.column("vec_id").slice(a, len(some)).to_pylist()
                starts = range(0, width, columns)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b // columns for b in starts], pa.int32()),
                    pa.array([part] * len(starts), pa.int64()),
                    pa.array([len(some)] * len(starts), pa.int32()),
                    pa.array([None if b else ids for b in starts], pa.list_(pa.int64())),
                    pa.array([_packed(some[:, b:b + columns]) for b in starts], pa.binary()),
                ], ["block", "part", "n", "ids", "x"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, _SHARD)


def _partial_distances(shards: DataFrame, centres: np.ndarray, columns: int) -> DataFrame:
    """``part, n, size, d``: each shard's exact part of the squared distances of its rows."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for block, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "x"))):
                own = centres[:, block * columns:(block + 1) * columns]
                x = _unpacked(data, n, own.shape[1])
                d = np.zeros((n, k), np.int64)
                for j in range(own.shape[1]):
                    gap = x[:, j, None] - own[None, :, j]
                    gap *= gap
                    d += gap
                out.append(_packed(d))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("n"), pa.array([k] * len(out), pa.int32()),
                 pa.array(out, pa.binary())], ["part", "n", "size", "d"])

    return shards.select("block", "part", "n", "x").mapInArrow(run, _PART)


def _nearest(parts: DataFrame) -> DataFrame:
    """``part, cluster, distance``: the parts of a run of rows added up, then the nearest centroid
    of each row, ties to the smaller number. A run has one record for each block of columns."""

    def add(table: pa.Table) -> pa.Table:
        n, k = table.column("n")[0].as_py(), table.column("size")[0].as_py()
        total = np.zeros((n, k), np.int64)
        for data in table.column("d").to_pylist():
            total += _unpacked(data, n, k)
        near = total.argmin(axis=1)
        return pa.table({
            "part": pa.array([table.column("part")[0].as_py()], pa.int64()),
            "cluster": pa.array([near.astype(np.int32)], pa.list_(pa.int32())),
            "distance": pa.array([total[np.arange(n), near]], pa.list_(pa.int64()))})

    return parts.groupBy("part").applyInArrow(
        add, "part long, cluster array<int>, distance array<long>")


def _slice_sums(shards: DataFrame, near: DataFrame, k: int, width: int, columns: int) -> DataFrame:
    """``cluster, dim, total, n``: sums of each shard's columns by cluster. A task adds up its own
    rows and sends at most a row for each cluster and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in _slices(batches):
            for i, (block, n, data) in enumerate(
                    zip(*(batch.column(c).to_pylist() for c in ("block", "n", "x")))):
                wide = min(columns, width - block * columns)
                cluster = batch.column("cluster")[i].values.to_numpy(zero_copy_only=False)
                total = sums.setdefault(block, np.zeros((k, wide), np.int64))
                np.add.at(total, cluster, _unpacked(data, n, wide))
                counts.setdefault(block, np.zeros(k, np.int64))
                counts[block] += np.bincount(cluster, minlength=k)
        for block, total in sums.items():
            held = np.flatnonzero(counts[block])
            wide = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(held, wide).astype(np.int32)),
                 pa.array(np.tile(np.arange(wide) + block * columns, len(held)).astype(np.int32)),
                 pa.array(total[held].ravel()), pa.array(np.repeat(counts[block][held], wide))],
                ["cluster", "dim", "total", "n"])

    joined = shards.select("block", "part", "n", "x").join(near.select("part", "cluster"), "part")
    return joined.select("block", "n", "x", "cluster").mapInArrow(
        run, "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"))


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    width: int = WIDTH,
    scale: int = SCALE,
    columns: int = COLUMNS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each kept vector.

    Kept are vectors of exactly ``width`` finite components, each of which becomes the whole
    number floor(``scale`` * component); all sums are exact. The first centroids are the vectors
    with the smallest SHA-256 of ``seed:vec_id``, in that order. Each round assigns every vector
    to the nearest centroid, ties to the smaller number, and moves each centroid that has vectors
    to the floored mean of its own. Vectors are assigned once more at the end.

    A row without an id takes part, with an empty text for its id; rows that repeat an id are
    vectors of their own, and among them the smaller vector comes first. With fewer kept vectors
    than ``clusters`` each starts a centroid; without any, as in an empty table, the result is
    empty. NULL vectors and those of another length or with a NULL or non-finite component are
    left out; one with a component of 2**27 / ``scale`` or more raises, as its distances may not fit
    64 bits. Other columns are ignored.

    The driver holds the centroids only: ``clusters`` times ``width`` numbers.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = kept_vectors(vectors, width, id_col, vector_col)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(name, 256), "vector").limit(clusters).select("vector").collect()
    if not first:
        return rows.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
            F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
            F.lit("").alias("centroid_sha256")).where(F.lit(False))
    centres = _whole(np.array([r["vector"] for r in first]), scale)

    shards = scratch.keep(column_blocks(rows, width, scale, columns), "shards")
    for _ in range(rounds):
        near = _nearest(_partial_distances(shards, centres, columns))
        sums = _slice_sums(shards, near, len(centres), width, columns)
        centres = centres.copy()
        for r in sums.collect():
            centres[r["cluster"], r["dim"]] = r["total"] // r["n"]

    near = _nearest(_partial_distances(shards, centres, columns))
    ids = shards.where("block = 0").select("part", "ids")
    found = scratch.keep(
        near.join(ids, "part").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("v"))
        .select(F.col("v.ids").alias("vec_id"), "v.cluster", "v.distance"), "found")
    sums = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    # One row a centroid.
    table = spark.createDataFrame(
        [(i, sums.get(i, 0), total, d) for i, d in enumerate(digests)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The same in DuckDB, a common table expression for each half of a round."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
    SELECT row, min(struct_pack(d := d, k := k)) AS best FROM (
        SELECT row, k, sum((x - c) * (x - c))::BIGINT AS d FROM items JOIN c{i} USING (dim)
        GROUP BY row, k) GROUP BY row)""")
        if i < ROUNDS:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
    SELECT k, dim, coalesce(m, c) AS c FROM c{i} LEFT JOIN (
        SELECT best.k AS k, dim,
            ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
        FROM items JOIN a{i} USING (row) GROUP BY ALL) USING (k, dim))""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS row,
        vec_id, embedding FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
items AS MATERIALIZED (
    SELECT row, dim, floor({SCALE} * embedding[dim]::DOUBLE)::BIGINT AS x
    FROM kept, range(1, {WIDTH + 1}) d(dim)),
c0 AS (SELECT row AS k, dim, x AS c FROM items WHERE row < {CLUSTERS}),
{",".join(steps)},
centres AS (
    SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, best.k::INT AS cluster, best.d AS distance,
    (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
    (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row) JOIN centres ON centres.k = best.k"""

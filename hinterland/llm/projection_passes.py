"""Near-duplicate vectors by sorted projection passes.

A pass gives each vector a string of random hashes, the sides of random planes on which it lies,
and sorts by it. Near vectors agree in a long prefix in some of the passes and then lie near each
other, so each is compared with a bounded window of those that follow. Verified pairs of all
passes are united, and the links inside the components found are counted in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.components import components
from hinterland.llm.scratch import Scratch

COSINE = 0.93
#: Rows that follow a row in a pass and are compared with it.
WINDOW = 128
HASHES, SEED = 64, 1300
#: Chance that a pair of the least cosine meets in no pass.
MISS = 0.001
#: Passes sorted in one job.
AT_ONCE = 4
#: A component of n rows is dealt into sqrt(n / 64) blocks, so that both the copies of a row and the
#: rows of a block grow with the root of it, and into more where a block would exceed this.
BLOCK = 65_536

_EDGES = "u long, v long, border int, late boolean, i int, node long, label string, x binary"


def passes_needed(rows: int, cosine: float = COSINE, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes after which a pair of the least cosine was apart in all with probability ``miss``.

    ``rows`` unrelated rows are cut into windows by log2(rows / window) planes; a pair of cosine c
    lies on one side of a plane with probability 1 - acos(c) / pi.
    """
    planes = max(0.0, math.log2(max(rows, 1) / window))
    meet = (1 - math.acos(cosine) / math.pi) ** planes
    return max(2, math.ceil(math.log(miss) / math.log1p(-min(meet, 1 - 1e-9))))


def _keys(x: np.ndarray, number: int) -> np.ndarray:
    """Sides of the planes of a pass, the first plane in the highest bit."""
    planes = np.random.default_rng([SEED, number, x.shape[1]]).standard_normal((x.shape[1], HASHES))
    sides = (x @ planes) > 0
    return np.packbits(sides, axis=1).view(">u8").ravel().astype(np.uint64)


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of the pairs that join two groups which earlier pairs leave apart."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for k, (a, b) in enumerate(zip(u.tolist(), v.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


def _pack(x: np.ndarray) -> bytes:
    """Components in 32 bits where that is exact; the first byte tells."""
    short = x.astype(np.float32)
    return b"f" + short.tobytes() if (short == x).all() else b"d" + x.tobytes()


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float32 if b[:1] == b"f" else np.float64, offset=1) for b in column.to_pylist()]


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length one."""
    x = np.stack([v.astype(np.float64) for v in _vectors(column)])
    # By the largest component first, so that squares of very large or small ones stay finite.
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _following(
    x: np.ndarray, window: int, cosine: float, first: int, last: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with i < ``last``, ``first`` <= j and i < j <= i + ``window`` that reach the cosine."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(max(0, first - window), last, window):
        own, behind = x[a:min(a + window, last)], x[a:a + 2 * window]
        i, j = np.nonzero(own @ behind.T >= cosine)
        hit = (i < j) & (j - i <= window) & (j + a >= first)
        left.append(i[hit] + a)
        right.append(j[hit] + a)
    return np.concatenate(left), np.concatenate(right)


def _runs(labels: list[str]) -> Iterator[tuple[int, int]]:
    a = 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[a]:
            yield a, i
            a = i


def sorted_pass(nodes: DataFrame, numbers: list[int], scratch: Scratch, cosine: float, window: int) -> DataFrame:
    """``u, v``: a forest of the links met in the passes ``numbers`` over ``nodes(node, label, x)``.

    Rows are dealt by ranges of (pass and label, key), so a label with most rows covers many
    tasks. A task compares its rows with those that follow in its own range. The last rows of a
    range go on with the first rows of the ranges behind it, which a second step brings together.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(v) for v in _vectors(batch.column("x"))])
            for size in np.unique(sizes):
                some = batch.filter(pa.array(sizes == size))
                x = _unit(some.column("x"))
                for number in numbers:
                    # Signed numbers in the order of the unsigned ones.
                    key = (_keys(x, number) ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("node"), some.column("x"), pa.array(key),
                         pa.array([f"{number}:{label}" for label in some.column("label").to_pylist()])],
                        ["node", "x", "key", "label"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads, seen = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            # The first rows of the range, for the ranges before it.
            if heads < window:
                yield _border(rows.slice(0, window - heads), False, heads)
                heads = min(window, heads + len(rows))
            seen += len(rows)
            old = len(held) if held is not None else 0
            rows = pa.concat_tables([held, rows]).combine_chunks() if old else rows
            yield _links(rows, old)
            held = rows.slice(max(0, len(rows) - window))
        if held is not None:
            yield _border(held, True, seen - len(held))

    def _links(rows: pa.Table, old: int) -> pa.RecordBatch:
        node = rows.column("node").to_numpy()
        pairs: tuple[list, list] = ([], [])
        for a, b in _runs(rows.column("label").to_pylist()):
            x = _unit(rows.column("x").slice(a, b - a))
            u, v = _following(x, window, cosine, old - a, b - a)
            pairs[0].append(u + a)
            pairs[1].append(v + a)
        u, v = np.concatenate(pairs[0]), np.concatenate(pairs[1])
        kept = _forest(u, v, len(node))
        return _edge_rows(node[u[kept]], node[v[kept]])

    def _edge_rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays(
            [pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())],
            ["u", "v", "border", "late", "i", "node", "label", "x"])

    def _border(rows: pa.Table, late: bool, first: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        n, part = len(rows), TaskContext.get().partitionId()
        rows = rows.combine_chunks()
        place = np.arange(n) + (0 if late else first)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, part, np.int32)),
             pa.array([late] * n, pa.bool_()), pa.array(place.astype(np.int32)),
             *[rows.column(c).combine_chunks().cast(t) for c, t in (
                 ("node", pa.int64()), ("label", pa.string()), ("x", pa.binary()))]],
            ["u", "v", "border", "late", "i", "node", "label", "x"])

    sorted_rows = (
        nodes.mapInArrow(keys, "node long, x binary, key long, label string")
        .repartitionByRange("label", "key", "node").sortWithinPartitions("label", "key", "node"))
    met = scratch.keep(sorted_rows.mapInArrow(compare, _EDGES), "met")

    # Where each range's first rows are needed: by the ranges before it whose last rows still have
    # places left in their windows. Ranges and not rows are counted here.
    heads = {r["border"]: r["n"] for r in met.where("NOT late").groupBy("border").agg(
        F.count("*").alias("n")).collect()}
    order, wanted = sorted(heads), []
    for a, part in enumerate(order):
        before = 0
        for other in order[a + 1:]:
            if before >= window:
                break
            wanted.append((other, part, before))
            before += heads[other]

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([("late", "descending"), ("i", "ascending")]).combine_chunks()
        node = table.column("node").to_numpy()
        tails = int(np.count_nonzero(np.array(table.column("late").to_pylist())))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _runs(table.column("label").to_pylist()):
            if a < tails < b:
                x = _unit(table.column("x").slice(a, b - a))
                u, v = _following(x, window, cosine, tails - a, tails - a)
                us.append(u + a)
                vs.append(v + a)
        u, v = np.concatenate(us), np.concatenate(vs)
        kept = _forest(u, v, len(node))
        return pa.table({"u": pa.array(node[u[kept]], pa.int64()), "v": pa.array(node[v[kept]], pa.int64())})

    edges = met.where("u IS NOT NULL").select("u", "v")
    table = nodes.sparkSession.createDataFrame(wanted, "border int, at int, before int")
    late = met.where("late").select(F.col("border").alias("at"), "late", "i", "node", "label", "x")
    early = met.where("NOT late").join(F.broadcast(table), "border").select(
        "at", "late", (F.col("i") + F.col("before")).alias("i"), "node", "label", "x")
    edges = edges.unionByName(
        late.unionByName(early).groupBy("at").applyInArrow(across, "u long, v long"))
    edges = scratch.keep(edges.distinct(), "edges")
    scratch.drop(met)
    return edges


def _counted_links(members: DataFrame, cosine: float) -> DataFrame:
    """``node, n``: for each of ``members(component, node, copies, x)`` the rows it is linked with.

    A component is dealt into blocks by row numbers; each pair of blocks is compared in one task,
    which returns a sum for each of its rows and never a pair.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.greatest(F.ceil(F.sqrt(F.col("size") / 64)), F.ceil(F.col("size") / BLOCK)).cast("int").alias("blocks")
    sized = members.join(sizes.select("component", blocks), "component").withColumn(
        "b", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sized.withColumn("o", other).select(
        "component", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "node", "copies", "x")

    def count(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        b, lo, hi = (table.column(c).to_numpy() for c in ("b", "lo", "hi"))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = _unit(table.column("x"))
        left, right = np.flatnonzero(b == lo[0]), np.flatnonzero(b == hi[0])
        n = np.zeros(len(node), np.int64)
        for a in range(0, len(left), 512):
            some = left[a:a + 512]
            near = x[some] @ x[right].T >= cosine
            n[some] += near @ copies[right]
            if lo[0] != hi[0]:
                n[right] += copies[some] @ near
            else:
                # A row always reaches itself; the caller counts it among its copies.
                own = np.searchsorted(right, some)
                n[some] -= np.where(near[np.arange(len(some)), own], copies[some], 0)
        return pa.table({"node": pa.array(node, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("component", "lo", "hi").applyInArrow(count, "node long, n long").groupBy(
        "node").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    window: int = WINDOW,
    miss: float = MISS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Vectors of one label and length are linked when their cosine is at least ``cosine``, in
    double precision. Equal vectors are compared once: all copies are linked with each other and
    with the same others. ``component_id`` is the smallest id that links reach, ``n_links`` the
    number of other rows linked directly, ``kept`` whether the row has its component's id.

    A pair of the least cosine is met with probability 1 - ``miss`` among unrelated rows; the
    number of passes grows with the largest label for that. All links between vectors of one
    component are counted, whether a pass met them or not; links are lost only where two
    components meet in no pass at all.

    Vectors that are NULL, empty, zero or hold a NULL or non-finite component, and those without a
    label, link with nothing. Rows without an id take part and get the smallest id they reach,
    NULL if there is none; they are kept only then. Repeated rows get a row each. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.col(label_col).cast("string").alias("label"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce(F.col("label").isNotNull() & sound & F.exists("vector", lambda x: x != 0), F.lit(False))
    # Zeros of either sign are equal.
    digest = F.md5(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))))
    keyed = rows.withColumn("able", able).withColumn("digest", F.when(F.col("able"), digest))
    grouped = keyed.where("able").groupBy("label", "digest").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_pack(v.values.to_numpy(zero_copy_only=False)) for v in batch.column("vector")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "digest", "first", "copies")), pa.array(x, pa.binary())],
                ["node", "label", "digest", "first", "copies", "x"])

    # Vectors of different length have nothing to do with each other.
    kind = F.concat(F.size("vector").cast("string"), F.lit(":"), F.col("label")).alias("label")
    numbered = grouped.select(
        F.monotonically_increasing_id().alias("node"), kind, "digest", "first", "copies", "vector")
    nodes = scratch.keep(
        numbered.mapInArrow(
            pack, "node long, label string, digest string, first long, copies long, x binary"), "nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    count = passes_needed(largest, cosine, window, miss)
    edges = None
    for a in range(0, count, AT_ONCE):
        numbers = list(range(a, min(count, a + AT_ONCE)))
        found = sorted_pass(nodes.select("node", "label", "x"), numbers, scratch, cosine, window)
        edges = found if edges is None else edges.unionByName(found)
    labels = scratch.keep(components(edges, scratch), "labels")
    linked = scratch.keep(
        nodes.join(labels, "node").select("node", "digest", "label", "component", "first", "copies", "x"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    counted = _counted_links(linked, cosine)
    named = linked.join(smallest, "component").join(counted, "node").select("node", "component_id", "n")
    classes = scratch.keep(
        nodes.join(named, "node", "left").select(
            "label", "digest", F.when(F.col("n").isNull(), F.col("first")).otherwise(F.col("component_id"))
            .alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    with_class = keyed.where("able").select("vec_id", "digest", kind).join(
        classes, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    without = keyed.where("NOT able").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_class.unionByName(without).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Every pair of a label; the rows are few enough for SQL where it is run.
ORACLE = f"""
WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (
    SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM sound),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM unit a JOIN unit b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_inner_product(a.v, b.v) >= {COSINE}),
reach(vec_id, low) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT l.v, r.low FROM reach r JOIN links l ON l.u = r.vec_id WHERE r.low < l.v),
least_id AS (SELECT vec_id, min(low) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least_id LEFT JOIN counted USING (vec_id)"""

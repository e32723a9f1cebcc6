"""Sums of a smooth kernel over all points of a group, without meeting each point.

Points lie in quadtrees over the six faces of a cube around the sphere. A cell with few points keeps
them; one with many is also kept as charges on a Chebyshev grid, which give the same sums as its points
at any place three radii away, to about 1e-11 of the kernel. A block of places then needs the points
near it and a number of grids that grows with the logarithm of all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinterland.functions.geo import EARTH_RADIUS_M
from hinterland.sources.checkpoint import stored

DEPTH = 20  # levels of a face's quadtree
GRID = 14  # nodes of a grid along one side
SEPARATION = 3.0  # radii of a cell between it and places that use its grid
WIDEST = 0.25  # a cell wider than this is never seen as one
TREE_POINTS = 65_536  # points of one tree that a task builds
STEP = 4  # levels of a tree above the lowest ones
_COUNTED = 12
_XYZ = ("x", "y", "z")
_BOX = [f"{side}_{a}" for a in _XYZ for side in ("lo", "hi")]
_NODES = np.cos((2 * np.arange(GRID) + 1) * np.pi / (2 * GRID))
_SCALE = (-1.0) ** np.arange(GRID) * np.sin((2 * np.arange(GRID) + 1) * np.pi / (2 * GRID))


def _spread(bits: Column) -> Column:
    """The low 20 bits with a zero after each."""
    for by, mask in ((16, 0xFFFF0000FFFF), (8, 0xFF00FF00FF00FF), (4, 0xF0F0F0F0F0F0F0F),
                     (2, 0x3333333333333333), (1, 0x5555555555555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, by)).bitwiseAND(F.lit(mask))
    return bits


def face_code(x: Column, y: Column, z: Column) -> Column:
    """Face of the cube, then the place in its quadtree."""
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), ay >= az
    face = F.when(on_x, F.when(x >= 0, 0).otherwise(1)).when(on_y, F.when(y >= 0, 2).otherwise(3)).otherwise(
        F.when(z >= 0, 4).otherwise(5))
    top = F.greatest(ax, ay, az)

    def side(c: Column) -> Column:
        place = F.floor((F.atan(c / top) * (4 / np.pi) + 1.0) * 2.0 ** (DEPTH - 1)).cast("long")
        return _spread(F.greatest(F.lit(0).cast("long"), F.least(F.lit(2**DEPTH - 1).cast("long"), place)))

    first, second = F.when(on_x, y).otherwise(x), F.when(on_x | on_y, z).otherwise(y)
    return F.shiftleft(face.cast("long"), 2 * DEPTH).bitwiseOR(side(first)).bitwiseOR(F.shiftleft(side(second), 1))


def _basis(t: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of the Chebyshev nodes at ``t``, one row each."""
    gap = t[:, None] - _NODES
    hit = np.abs(gap) < 1e-14
    gap[hit] = 1.0
    out = _SCALE / gap
    out /= out.sum(axis=1, keepdims=True)
    rows = hit.any(axis=1)
    out[rows] = hit[rows]
    return out


def on_grid(points: np.ndarray) -> np.ndarray:
    """Charges (columns after the unit vector) moved to a grid over the points, in the plane that
    touches the sphere amid them."""
    xyz, charges = points[:, :3], points[:, 3:]
    centre = (xyz.min(axis=0) + xyz.max(axis=0)) / 2
    centre /= np.linalg.norm(centre)
    one = np.cross(centre, np.eye(3)[np.abs(centre).argmin()])
    one /= np.linalg.norm(one)
    two = np.cross(centre, one)
    height = xyz @ centre
    flat, bases = [], []
    for axis in (one, two):
        t = xyz @ axis / height
        mid, half = (t.min() + t.max()) / 2, max((t.max() - t.min()) / 2, 1e-12)
        bases.append(_basis((t - mid) / half))
        flat.append(mid + half * _NODES)
    u, v = np.repeat(flat[0], GRID), np.tile(flat[1], GRID)
    grid = centre + u[:, None] * one + v[:, None] * two
    out = np.empty((GRID * GRID, points.shape[1]))
    out[:, :3] = grid / np.linalg.norm(grid, axis=1, keepdims=True)
    for i in range(charges.shape[1]):
        out[:, 3 + i] = (bases[0].T @ (bases[1] * charges[:, i, None])).ravel()
    return out


def _tree(codes, points, whole, bottom: int, top: int, few: int) -> list[dict]:
    """Nodes of the tree of one cell, parents first. ``codes`` are sorted cells of level ``bottom``;
    ``whole`` is set where a row is a point itself. Rows of one code above the last level are a
    cell with a tree of its own, which a stub stands for."""
    nodes: list[dict] = []

    def add(level: int, lo: int, hi: int, parent: int, depth: int) -> np.ndarray:
        own, exact = points[lo:hi], bool(whole[lo:hi].all()) and hi - lo <= few
        cuts = [lo, hi]
        while not exact and level < bottom:
            # Levels at which all rows stay together make no node.
            level += 1
            keys = codes[lo:hi] >> (2 * (bottom - level))
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(keys))), hi]
            if len(cuts) > 2:
                break
        stub = not exact and len(cuts) == 2 and bottom < DEPTH
        me = len(nodes)
        node = {"parent": parent, "depth": depth, "stub": int(codes[lo]) if stub else None,
                "exact": exact or (len(cuts) == 2 and not stub)}
        nodes.append(node)
        if len(cuts) > 2:
            own = np.concatenate([add(level, a, b, me, depth + 1) for a, b in zip(cuts, cuts[1:])])
        node["lo"], node["hi"] = own[:, :3].min(axis=0), own[:, :3].max(axis=0)
        node["points"] = own if node["exact"] or stub else on_grid(own)
        return node["points"]

    add(top, 0, len(codes), -1, 0)
    return nodes


_NODE = "node int, parent int, depth int, stub long, exact boolean, " + ", ".join(f"{c} double" for c in _BOX)


def _trees(rows: DataFrame, by: Sequence[str], width: int, bottom: int, top: int, few: int) -> DataFrame:
    """One row a node: ``(*by, root, node, parent, ..., whole, data)``, from rows ``(*by, cell, whole, data)``
    with cells of level ``bottom``, grouped by the cell of level ``top``."""
    grouped = rows.groupBy(*by, F.shiftright("cell", 2 * (bottom - top)).alias("root")).agg(
        F.collect_list(F.struct("cell", "whole", "data")).alias("rows"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("root", T.LongType()),
                           *T._parse_datatype_string(_NODE).fields, T.StructField("data", T.ArrayType(T.DoubleType()))])
    names = schema.fieldNames()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items = batch.column("rows")[k].values
                data = items.field("data")
                sizes = data.value_lengths().to_numpy() // width
                codes = np.repeat(items.field("cell").to_numpy(), sizes)
                whole = np.repeat(items.field("whole").to_numpy(zero_copy_only=False), sizes)
                points = data.flatten().to_numpy().reshape(-1, width)
                order = np.argsort(codes, kind="stable")
                nodes = _tree(codes[order], points[order], whole[order], bottom, top, few)
                own = pa.array(np.full(len(nodes), k))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(own) for c in by], batch.column("root").take(own),
                    pa.array(range(len(nodes)), pa.int32()), pa.array([n["parent"] for n in nodes], pa.int32()),
                    pa.array([n["depth"] for n in nodes], pa.int32()), pa.array([n["stub"] for n in nodes], pa.int64()),
                    pa.array([n["exact"] for n in nodes], pa.bool_()),
                    *[pa.array([n[side][i] for n in nodes], pa.float64()) for i in range(3) for side in ("lo", "hi")],
                    # A stub's points are those of its own tree; a root's go up to the next tree.
                    pa.array([[] if n["stub"] is not None and n["parent"] >= 0 else n["points"].ravel() for n in nodes],
                             pa.list_(pa.float64())),
                ], names)

    return grouped.mapInArrow(build, schema)


def _lowest(points: DataFrame, by: Sequence[str]) -> int:
    """The first level at which no cell has more points than a tree may have."""
    counted = F.shiftright("cell", 2 * (DEPTH - _COUNTED)).alias("cell")
    counts = points.groupBy(*by, counted).agg(F.count("*").alias("n"))
    levels = counts.select(*by, "n", "cell", F.explode(F.sequence(F.lit(0), F.lit(_COUNTED))).alias("level"))
    most = (
        levels.groupBy(*by, "level", F.expr(f"shiftright(cell, 2 * ({_COUNTED} - level))").alias("cell"))
        .agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n")))
    found = {r["level"]: r["n"] for r in most.collect()}
    fits = [level for level, n in found.items() if n <= TREE_POINTS]
    return min(fits, default=_COUNTED if found else 0)


def kernel_sums(
    blocks: DataFrame, points: DataFrame, by: Sequence[str], charges: Sequence[str], id_field: T.StructField,
    kernel: Callable[[np.ndarray, np.ndarray, float], np.ndarray], near: float, few: int, partitions: int,
) -> DataFrame:
    """``(*by, id, charges)``: for each place the sums of ``kernel * charge`` over all points of its
    group. ``kernel(chord, out, most)`` writes the kernel of squared chords of at most ``most`` to ``out``.

    ``blocks`` are leaves of ``cells`` whose points hold the id; ``points`` has ``_ux, _uy, _uz`` and
    the charges. Cells of at most ``few`` points are met point by point. ``kernel`` must be smooth
    beyond ``near`` metres and short of the other end of the globe. Returns partial sums, one row a place.
    """
    by, charges = list(by), list(charges)
    width = 3 + len(charges)
    rows = stored(points.select(
        *by, face_code(F.col("_ux"), F.col("_uy"), F.col("_uz")).alias("cell"), F.lit(True).alias("whole"),
        F.array("_ux", "_uy", "_uz", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in charges]).alias("data")))
    bottom, top = DEPTH, _lowest(rows, by)
    tiers = []
    while True:
        tree = stored(_trees(rows, by, width, bottom, top, few))
        tiers.append(tree)
        if top == 0:
            break
        rows = tree.where("node = 0").select(*by, F.col("root").alias("cell"), F.col("exact").alias("whole"), "data")
        bottom, top = top, max(0, top - STEP)

    reach = F.struct("node", "parent", "depth", "stub", "exact", *_BOX)
    found = T.StructType([*[blocks.schema[c] for c in by], T.StructField("block", T.LongType()),
                          T.StructField("root", T.LongType()), T.StructField("node", T.IntegerType()),
                          T.StructField("stub", T.LongType())])
    found_names = found.fieldNames()

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = {c: batch.column(c).to_numpy() for c in _BOX}
            for k in range(batch.num_rows):
                tree = batch.column("tree")[k].values
                order = np.argsort(tree.field("node").to_numpy())
                parent, depth = (tree.field(c).to_numpy()[order] for c in ("parent", "depth"))
                exact = tree.field("exact").to_numpy(zero_copy_only=False)[order]
                stub = tree.field("stub").take(pa.array(order))
                is_stub = stub.is_valid().to_numpy(zero_copy_only=False)
                gap = other = radius = 0.0
                for a in _XYZ:
                    lo, hi = (tree.field(f"{s}_{a}").to_numpy()[order] for s in ("lo", "hi"))
                    blo, bhi = boxes[f"lo_{a}"][k], boxes[f"hi_{a}"][k]
                    gap = gap + np.maximum(np.maximum(lo - bhi, blo - hi), 0.0) ** 2
                    other = other + np.maximum(np.maximum(-hi - bhi, blo + lo), 0.0) ** 2
                    radius = radius + ((hi - lo) / 2) ** 2
                least = SEPARATION**2 * radius
                far = ((gap >= least) & (other >= least) & (radius <= WIDEST**2)
                       & (gap >= (1.01 * near / EARTH_RADIUS_M) ** 2))
                opened = ~far & ~exact & ~is_stub
                met = parent < 0
                for d in range(1, int(depth.max()) + 1):
                    here = np.flatnonzero(depth == d)
                    met[here] = met[parent[here]] & opened[parent[here]]
                use = np.flatnonzero(met & ~opened)
                own, use_array = pa.array(np.full(len(use), k)), pa.array(use)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).take(own) for c in by], batch.column("block").take(own),
                    batch.column("root").take(own), pa.array(use, pa.int32()), stub.take(use_array)], found_names)

    boxed = blocks.select(*by, F.col("cell").alias("block"), *_BOX)
    asked = boxed.select(*by, "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("root"))
    seen = None
    for tree in reversed(tiers):
        skeleton = tree.groupBy(*by, "root").agg(F.collect_list(reach).alias("tree"))
        hits = stored(asked.join(boxed, [*by, "block"]).join(skeleton, [*by, "root"]).mapInArrow(descend, found))
        part = hits.where("stub IS NULL").join(tree.select(*by, "root", "node", "data"), [*by, "root", "node"]).select(
            *by, "block", "data")
        seen = part if seen is None else seen.unionByName(part)
        asked = hits.where("stub IS NOT NULL").select(*by, "block", F.col("stub").alias("root"))

    schema = T.StructType([*[blocks.schema[c] for c in by], id_field,
                           *[T.StructField(c, T.DoubleType()) for c in charges]])
    out_names = schema.fieldNames()
    scratch = 65_536  # pairs computed at once, so that temporaries stay in cache

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        places = left.column("points").combine_chunks().flatten()
        xyz = np.column_stack([places.field(a).to_numpy() for a in _XYZ]) if len(places) else np.empty((0, 3))
        total = np.zeros((len(xyz), len(charges)))
        if len(xyz):
            rest = right.column("data").combine_chunks().flatten().to_numpy().reshape(-1, width)
            # Points of like distance come together, so that near ones take few terms of the kernel.
            centre = (xyz.min(axis=0) + xyz.max(axis=0)) / 2
            reach = np.sqrt(((xyz - centre) ** 2).sum(axis=1).max())
            away = np.sqrt(((rest[:, :3] - centre) ** 2).sum(axis=1))
            order = np.argsort(away)
            for j in range(0, len(rest), 8192):
                some = order[j : j + 8192]
                axes, parts = np.ascontiguousarray(rest[some, :3].T), rest[some, 3:]
                most = float(away[some[-1]] + reach) ** 2
                step = max(1, scratch // len(parts))
                gap, w = np.empty((step, len(parts))), np.empty((step, len(parts)))
                for i in range(0, len(xyz), step):
                    here = xyz[i : i + step]
                    g, c = gap[: len(here)], w[: len(here)]
                    np.subtract(here[:, 0, None], axes[0], out=c)
                    np.multiply(c, c, out=c)
                    for axis in (1, 2):
                        np.subtract(here[:, axis, None], axes[axis], out=g)
                        np.multiply(g, g, out=g)
                        np.add(c, g, out=c)
                    total[i : i + step] += kernel(c, g, most) @ parts
        ids = places.field(id_field.name)
        first = pa.array(np.zeros(len(xyz), np.int64))
        return pa.Table.from_arrays([
            *[left.column(c).combine_chunks().take(first) for c in by], ids,
            *[pa.array(total[:, i]) for i in range(len(charges))]], names=out_names)

    key = [*by, "block"]
    # An explicit count keeps AQE from merging blocks that are small in bytes but long to run.
    places = blocks.select(*by, F.col("cell").alias("block"), "points").repartition(partitions, *key)
    seen = seen.repartition(partitions, *key)
    return places.groupBy(*key).cogroup(seen.groupBy(*key)).applyInArrow(add_up, schema)

"""Polygons of a plane in a quadtree whose cells hold a bounded number of edges.

Whether a point lies inside follows from its own cell alone. The cell knows on which side of each
of its polygons its lower right corner lies; on the way from there up its right border to the
point's height and then left to the point only edges of the cell can be crossed. Cells without
edges are inside or outside as a whole and test nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.sources.checkpoint import materialise

EDGES = 32  # edges of a cell at most
STEP = 4  # levels of a step: a cell is split into 16 x 16
#: Cells are not split below this level, where many edges end in one point: their width is the
#: tree's by 2**28. Their numbers fit 64 bits.
LAST = 28

_FAN = 2**STEP
_AT = "(e.x1 + ({y} - e.y1) / nullif(e.y2 - e.y1, 0D) * (e.x2 - e.x1))"
_SPANS = "((e.y1 <= {y}) <> (e.y2 <= {y}))"


def _passed(y: str, right: str) -> str:
    """1 where the edge crosses the upright line ``right`` at or below ``y``."""
    rising = f"(CASE WHEN e.x1 > {right} THEN e.y1 > e.y2 ELSE e.y2 > e.y1 END)"
    return (f"CASE WHEN {_SPANS.format(y=y)} THEN CAST({rising} = ({_AT.format(y=y)} > {right}) AS INT) "
            f"WHEN {y} >= greatest(e.y1, e.y2) THEN 1 ELSE 0 END")


def _upward(y: str, right: str, low: str) -> str:
    """Crossings between the heights ``low`` and ``y`` of the line ``right``, up to an even number."""
    return (f"CASE WHEN (e.x1 > {right}) <> (e.x2 > {right}) "
            f"THEN {_passed(y, right)} + {_passed(low, right)} ELSE 0 END")


def _crossings(x: str, y: str, right: str, low: str) -> str:
    """Crossings from (right, low) up to (right, y) and left to (x, y)."""
    at = _AT.format(y=y)
    level = f"CASE WHEN {_SPANS.format(y=y)} AND {x} < {at} AND {at} <= {right} THEN 1 ELSE 0 END"
    return f"({level} + {_upward(y, right, low)})"


@dataclass(frozen=True)
class Quadtree:
    """``levels``: for each level that has cells, ``(code, right, low, split, inside)``. ``inside``
    lists the polygons of a cell with their edges there, ``split`` cells go on a step below."""

    x: float
    y: float
    size: float
    columns: list[str]
    levels: list[tuple[int, DataFrame]] = field(repr=False)

    def width(self, level: int) -> float:
        return self.size / 2**level

    def code(self, level: int, x: Column, y: Column) -> Column:
        """Number of the cell around a point, NULL outside the tree."""
        n = 2**level
        cx = F.floor((x - F.lit(self.x)) / F.lit(self.width(level)))
        cy = F.floor((y - F.lit(self.y)) / F.lit(self.width(level)))
        return F.when((cx >= 0) & (cx < n) & (cy >= 0) & (cy < n), cx * n + cy)


def build_tree(edges: DataFrame, polygon: str, names: DataFrame | None = None, most: int = EDGES) -> Quadtree | None:
    """Split the square around all ``edges(polygon, x1, y1, x2, y2)`` until no cell has more than
    ``most`` edges. Edges have to form closed rings, horizontal ones included.

    Edges are counted by cell and children take theirs by arithmetic, so a polygon with most of
    all edges is no larger a task than another. Columns of ``names`` go with their polygon.
    """
    box = edges.agg(
        F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
        F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1")).first()
    if box["x0"] is None:
        return None
    x0, y0 = math.floor(box["x0"]), math.floor(box["y0"])
    extent = max(box["x1"] - x0, box["y1"] - y0)
    size = 2.0 ** (math.floor(math.log2(extent)) + 1) if extent > 0 else 1.0
    # Cells take edges that pass them within this, so that rounding of borders does no harm.
    slack = 4e-14 * (abs(x0) + abs(y0) + size)
    tree = Quadtree(float(x0), float(y0), size, [c for c in names.columns if c != polygon] if names is not None else [], [])

    poly = F.col(polygon).alias("poly")
    zero = F.lit(0).cast("long")
    nodes = edges.select(zero.alias("cx"), zero.alias("cy"), poly, F.struct("x1", "y1", "x2", "y2").alias("e"))
    inside = nodes.select("cx", "cy", "poly").where(F.lit(False))
    level = 0
    while True:
        big = nodes.groupBy("cx", "cy").count().where(F.col("count") > most).select("cx", "cy")
        big = materialise(big if level < LAST else big.where(F.lit(False)))
        leaf_edges, leaf_inside = (f.join(big, ["cx", "cy"], "left_anti") for f in (nodes, inside))
        held = (
            leaf_edges.select("cx", "cy", "poly", "e", F.lit(0).alias("par"))
            .unionByName(leaf_inside.select("cx", "cy", "poly", F.lit(1).alias("par")), allowMissingColumns=True)
            .groupBy("cx", "cy", "poly").agg(F.max("par").alias("par"), F.collect_list("e").alias("edges")))
        if names is not None:
            held = held.join(names.withColumnRenamed(polygon, "poly"), "poly", "left")
        cell = F.col("cx") * 2**level + F.col("cy")
        width = tree.width(level)
        table = held.groupBy("cx", "cy").agg(
            F.collect_list(F.struct("poly", "par", "edges", *tree.columns)).alias("inside")
        ).select("cx", "cy", "inside", F.lit(False).alias("split")).unionByName(
            big.withColumn("split", F.lit(True)), allowMissingColumns=True)
        tree.levels.append((level, materialise(table.select(
            cell.alias("code"), (F.lit(tree.x) + (F.col("cx") + 1) * width).alias("right"),
            (F.lit(tree.y) + F.col("cy") * width).alias("low"), "split", "inside"))))
        if big.isEmpty():
            return tree
        nodes, inside = (materialise(f) for f in _split(
            tree, level, nodes.join(big, ["cx", "cy"], "left_semi"), inside.join(big, ["cx", "cy"], "left_semi"), slack))
        level += STEP


def _split(tree: Quadtree, level: int, nodes: DataFrame, inside: DataFrame, slack: float) -> tuple[DataFrame, DataFrame]:
    """Edges of the children of all given cells, and the children that lie inside a polygon at
    their lower right corner."""
    w = tree.width(level + STEP)
    near = slack + 1e-6 * w
    left, low = f"({tree.x}D + cx * {w * _FAN}D)", f"({tree.y}D + cy * {w * _FAN}D)"
    right = f"({tree.x}D + (cx + 1) * {w * _FAN}D)"
    wide = nodes.select(
        "cx", "cy", "poly", "e", F.expr(left).alias("left"), F.expr(low).alias("low"), F.expr(right).alias("right"),
        F.expr("least(e.y1, e.y2)").alias("lo"), F.expr("greatest(e.y1, e.y2)").alias("hi"))

    def rows(first: str, last: str) -> Column:
        return F.expr(f"explode(filter(sequence(0, {_FAN - 1}), i -> i >= {first} AND i <= {last}))")

    # Bands of children that the edge runs through, and in each the children between its ends.
    bands = wide.withColumn(
        "j", rows(f"floor((lo - {near}D - low) / {w}D)", f"floor((hi + {near}D - low) / {w}D)"))
    bands = bands.withColumns({
        "a": F.expr(f"greatest(lo, least(hi, low + j * {w}D - {near}D))"),
        "b": F.expr(f"greatest(lo, least(hi, low + (j + 1) * {w}D + {near}D))")})
    flat = "e.y1 = e.y2"
    bands = bands.withColumns({
        "xa": F.expr(f"CASE WHEN {flat} THEN e.x1 ELSE {_AT.format(y='a')} END"),
        "xb": F.expr(f"CASE WHEN {flat} THEN e.x2 ELSE {_AT.format(y='b')} END")})
    children = bands.withColumn("i", rows(
        f"floor((least(xa, xb) - {near}D - left) / {w}D)", f"floor((greatest(xa, xb) + {near}D - left) / {w}D)"))
    children = children.select(
        F.expr(f"cx * {_FAN} + i").alias("cx"), F.expr(f"cy * {_FAN} + j").alias("cy"), "poly", "e")

    # Crossings between the parent's corner and the lower right corners of a row of children.
    sums = [f"t{i}" for i in range(_FAN)]
    last = (f"CASE WHEN (e.x1 > right) <> (e.x2 > right) THEN {_FAN - 1} "
            f"ELSE floor((hi - low) / {w}D) + 1 END")
    met = wide.withColumn("j", rows(f"floor((lo - low) / {w}D)", last)).withColumn(
        "y", F.expr(f"{tree.y}D + (cy * {_FAN} + j) * {w}D"))
    met = met.select(
        "cx", "cy", "poly", "j", F.expr(_upward("y", "right", "low")).alias("up"),
        F.expr(f"CASE WHEN {_SPANS.format(y='y')} AND {_AT.format(y='y')} <= right THEN {_AT.format(y='y')} END").alias("at"))
    met = met.select("cx", "cy", "poly", "j", *[
        F.expr(f"up + CASE WHEN {tree.x}D + (cx * {_FAN} + {i + 1}) * {w}D < at THEN 1 ELSE 0 END").alias(t)
        for i, t in enumerate(sums)])
    whole = inside.select(
        "cx", "cy", "poly", F.explode(F.sequence(F.lit(0), F.lit(_FAN - 1))).alias("j"),
        *[F.lit(1).alias(t) for t in sums])
    corners = met.unionByName(whole).groupBy("cx", "cy", "poly", "j").agg(*[F.sum(t).alias(t) for t in sums])
    odd = F.explode(F.filter(
        F.array(*[F.when(F.col(t) % 2 == 1, F.lit(i)) for i, t in enumerate(sums)]), lambda i: i.isNotNull())).alias("i")
    corners = corners.select("cx", "cy", "poly", "j", odd)
    return children, corners.select(
        F.expr(f"cx * {_FAN} + i").alias("cx"), F.expr(f"cy * {_FAN} + j").alias("cy"), "poly")


def locate(points: DataFrame, tree: Quadtree, lon: str, lat: str) -> tuple[DataFrame, Column]:
    """``points`` with helper columns that begin with ``_q``, and the array of polygons around each.

    A point meets one cell a step, by its number, from the top until the cell is not split. The
    joins keep every row; points that need not go on have numbers of their own, spread out.
    """
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    out = points.withColumns({"_qx": x, "_qy": y, "_qgo": F.lit(True)})
    apart = -1 - F.pmod(F.xxhash64("_qx", "_qy"), F.lit(4096))
    found = []
    for level, table in tree.levels:
        mine = [f"_q{c}{level}" for c in ("right", "low", "split", "inside")]
        cells = table.select(F.col("code").alias("_qkey"), *[
            F.col(c).alias(n) for c, n in zip(("right", "low", "split", "inside"), mine)])
        key = F.when(F.col("_qgo"), tree.code(level, F.col("_qx"), F.col("_qy")))
        out = out.withColumn("_qkey", F.coalesce(key, apart)).join(cells, "_qkey", "left").drop("_qkey")
        out = out.withColumn("_qgo", F.coalesce(F.col(mine[2]), F.lit(False)))
        crossed = _crossings("_qx", "_qy", mine[0], mine[1])
        found.append(F.expr(
            f"filter({mine[3]}, p -> (p.par + aggregate(p.edges, 0, (n, e) -> n + {crossed})) % 2 = 1)"))
    return out, F.coalesce(*found)

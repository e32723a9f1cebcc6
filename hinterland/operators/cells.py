"""Points of the unit sphere in cells of bounded size, and walks over pairs of cells.

Points are sorted in the order of a k-d tree that takes the axes in turn, and the order is cut by
rank: no cell holds more than a set number of points, however dense they lie. Runs of cells
make the nodes above, so a table of cells is a balanced tree without pointers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinterland.functions.geo import unit_vector
from hinterland.sources.checkpoint import materialise

POINTS = 256  # points of a cell at most
FAN = 4  # bits of a step: a node has up to 16 children
_AXIS_BITS = 20

_AXES = ("x", "y", "z")
_BOX = [f"{side}_{a}" for a in _AXES for side in ("lo", "hi")]


def _spread(bits: Column) -> Column:
    """The low 20 bits with two zeros after each, so that three axes can be interleaved."""
    for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F),
                     (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        bits = bits.bitwiseOR(F.shiftleft(bits, by)).bitwiseAND(F.lit(mask))
    return bits


def kd_code(axes: Sequence[Column]) -> Column:
    """Place of a point of the unit cube [-1, 1]^3 in the order of the halving k-d tree."""
    top = 2**_AXIS_BITS - 1
    code = F.lit(0).cast("long")
    for i, c in enumerate(axes):
        slice_ = F.greatest(F.lit(0), F.least(F.lit(top), F.floor((c + 1.0) * (2.0**_AXIS_BITS / 2))))
        code = code.bitwiseOR(F.shiftleft(_spread(slice_.cast("long")), i))
    return code


@dataclass(frozen=True)
class Cells:
    """``leaves``: one row a cell with its points as an array and the box around them; ``top`` is
    the level at which each group is one node. A node of level l is ``cell >> (FAN * l)``."""

    by: list[str]
    leaves: DataFrame = field(repr=False)
    top: int = 0

    def level(self, level: int) -> DataFrame:
        """``(*by, node, parent, box)`` of a level."""
        node = F.shiftright("cell", FAN * level).alias("node")
        boxes = [getattr(F, "min" if c.startswith("lo") else "max")(c).alias(c) for c in _BOX]
        return self.leaves.groupBy(*self.by, node).agg(*boxes).withColumn(
            "parent", F.shiftright("node", FAN))


def cells(
    points: DataFrame, by: Sequence[str], keep: Sequence[str], lon: str, lat: str, size: int = POINTS,
) -> Cells:
    """Deal ``points`` into cells of at most ``size`` points of one ``by`` group.

    Rows are dealt by ranges of (by, place) and written before they are numbered; only the size
    of each range reaches the driver. Rows whose group is NULL are left out.
    """
    by = list(by)
    axes = unit_vector(lon, lat)
    rows = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in by)) if by else points
    rows = rows.select(*by, *keep, *[c.alias(a) for a, c in zip(_AXES, axes)])
    order = [*by, "_code", *_AXES]
    ranged = materialise(
        rows.withColumn("_code", kd_code([F.col(a) for a in _AXES]))
        .repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    starts, total = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("_slice").count().collect())):
        starts.append((part, total))
        total += n
    offsets = points.sparkSession.createDataFrame(starts, "_slice int, _before long")
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    # A run of ranks that two groups share is a cell of each.
    leaves = (
        ranged.withColumn("_rank", rank).join(F.broadcast(offsets), "_slice")
        .withColumn("cell", F.expr(f"(_rank + _before) div {size}"))
        .groupBy(*by, "cell").agg(
            F.collect_list(F.struct(*keep, *_AXES)).alias("points"),
            *[getattr(F, side)(a).alias(f"{short}_{a}") for a in _AXES
              for side, short in (("min", "lo"), ("max", "hi"))])
    )
    count = max(0, total - 1) // size + 1
    top = 0
    while (count - 1) >> (FAN * top):
        top += 1
    return Cells(by, materialise(leaves), top)


def _gap(c: str, far: bool) -> Column:
    """Along one axis, the least or the largest distance of two points of two boxes."""
    apart = [F.col(f"s_lo_{c}") - F.col(f"e_hi_{c}"), F.col(f"e_lo_{c}") - F.col(f"s_hi_{c}")]
    if far:
        return F.greatest(*[F.abs(F.col(f"s_{a}_{c}") - F.col(f"e_{b}_{c}")) for a, b in (("lo", "hi"), ("hi", "lo"))])
    return F.greatest(*apart, F.lit(0.0))


def _squared(far: bool) -> Column:
    total = F.lit(0.0)
    for a in _AXES:
        total = total + _gap(a, far) * _gap(a, far)
    return total


def near_cells(starts: Cells, ends: Cells) -> DataFrame:
    """``(*by, s, e, bound)``: for each cell of starts the cells of ends that can hold the nearest
    end of one of its points, and the squared chord within which each of its points has one.

    Both trees are walked down together. A pair of nodes goes when its boxes are farther apart
    than some other end node reaches in any case; its points are never looked at.
    """
    by = starts.by
    depth = max(starts.top, ends.top)

    def nodes(side: Cells, prefix: str, level: int) -> DataFrame:
        return side.level(level).select(
            *by, F.col("node").alias(prefix), F.col("parent").alias(f"{prefix}_up"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in _BOX])

    def kept(pairs: DataFrame) -> DataFrame:
        # The slack covers rounding of the squared chords.
        bound = F.min(_squared(far=True)).over(Window.partitionBy(*by, "s"))
        return (
            pairs.withColumn("bound", bound).withColumn("near", _squared(far=False))
            .where(F.col("near") <= F.col("bound") * (1 + 1e-9) + 1e-15)
            .select(*by, "s", "e", "bound"))

    # A group has one node at the top level of a tree, with the number 0.
    s, e = nodes(starts, "s", depth), nodes(ends, "e", depth)
    pairs = kept(s.join(e, [*[s[c] == e[c] for c in by], s["s"] == e["e"]]).select(
        *[s[c] for c in by], *[s[c] for c in s.columns if c not in by], *[e[c] for c in e.columns if c not in by]))
    for level in range(depth - 1, -1, -1):
        s, e = nodes(starts, "_s", level), nodes(ends, "_e", level)
        s = s.withColumnsRenamed({"_s": "s2", "_s_up": "s", **{f"_s_{c}": f"s_{c}" for c in _BOX}})
        e = e.withColumnsRenamed({"_e": "e2", "_e_up": "e", **{f"_e_{c}": f"e_{c}" for c in _BOX}})
        pairs = kept(
            pairs.select(*by, "s", "e").join(s, [*by, "s"]).join(e, [*by, "e"])
            .drop("s", "e").withColumnsRenamed({"s2": "s", "e2": "e"}))
    return pairs


def nearest_points(
    starts: Cells, ends: Cells, start_cols: Sequence[T.StructField], end_cols: Sequence[T.StructField],
) -> DataFrame:
    """``(*by, start columns, end columns)``: for each start its nearest ends.

    A task holds the arrays of one cell of starts and meets the cells of ends near it one after the
    other, so starts are shuffled once and no row holds a pair of cells. Ends that differ in the
    last digits of the chord are all returned, so that a more exact distance can decide.
    """
    by, spark = starts.by, starts.leaves.sparkSession
    near = near_cells(starts, ends).select(*by, "s", "e").join(
        ends.leaves.select(*by, F.col("cell").alias("e"), F.col("points").alias("ends")), [*by, "e"]).drop("e")
    own = starts.leaves.select(*by, F.col("cell").alias("s"), F.col("points").alias("starts"))
    schema = T.StructType([*[own.schema[c] for c in by], *start_cols, *end_cols])
    names = schema.fieldNames()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        s = left.column("starts").combine_chunks().flatten()
        cells_of_ends = [c[k].values for c in right.column("ends").chunks for k in range(len(c))] if len(s) else []
        best, found = np.full(len(s), np.inf), []
        for m, e in enumerate(cells_of_ends):
            gap = np.zeros((len(s), len(e)))
            for a in _AXES:
                d = np.subtract.outer(s.field(a).to_numpy(), e.field(a).to_numpy())
                gap += d * d
            best = np.minimum(best, gap.min(axis=1))
            i, j = np.nonzero(gap <= (best * (1 + 1e-9) + 1e-15)[:, None])
            found.append((m, i, j, gap[i, j]))
        taken = []
        for m, i, j, gap in found:
            last = gap <= best[i] * (1 + 1e-9) + 1e-15
            if last.any():
                i, j, e = pa.array(i[last]), pa.array(j[last]), cells_of_ends[m]
                group = pa.array(np.zeros(len(i), np.int64))
                taken.append(pa.Table.from_arrays(
                    [*[left.column(c).combine_chunks().take(group) for c in by],
                     *[s.field(f.name).take(i) for f in start_cols],
                     *[e.field(f.name).take(j) for f in end_cols]], names))
        return pa.concat_tables(taken) if taken else pa.Table.from_arrays(
            [pa.array([], left.schema.field(c).type) for c in by]
            + [pa.array([], own_type(left, "starts", f.name)) for f in start_cols]
            + [pa.array([], own_type(right, "ends", f.name)) for f in end_cols], names)

    def own_type(table: pa.Table, column: str, name: str) -> pa.DataType:
        return table.schema.field(column).type.value_type.field(name).type

    key = [*by, "s"]
    # An explicit count keeps AQE from merging cells that are small in bytes but long to compare.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Fresh aliases keep the two sides apart, which share the cells of starts.
    own, near = (side.select([F.col(c).alias(c) for c in side.columns]).repartition(n, *key) for side in (own, near))
    return own.groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(compare, schema)

"""Hilbert-curve ordering: rows near in several dimensions come to lie in the same files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hinterland.llm.scratch import Scratch

BITS = 8


def curve_table(n: int) -> list[int]:
    """Steps of the curve through the 2**n corners of an n-cube, by Gray code and rotation.

    Entry ``state * 2**n + corner`` is ``next state * 2**n + rank of the corner``. A state is the
    corner where the curve enters, times n, plus the axis along which it leaves.
    """
    size = 1 << n

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & (size - 1)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}

    def axis(i: int) -> int:
        """Axis along which the curve moves inside the i-th corner."""
        if i == 0:
            return 0
        i = i - 1 if i % 2 == 0 else i
        return ((~i & (i + 1)).bit_length() - 1) % n

    table = []
    for enter in range(size):
        for leave in range(n):
            for corner in range(size):
                w = rank[turn(corner ^ enter, -(leave + 1))]
                first = gray(2 * ((w - 1) // 2)) if w else 0
                into = enter ^ turn(first, leave + 1)
                table.append((into * n + (leave + axis(w) + 1) % n) * size + w)
    return table


def curve_index(dims: Sequence[str], bits: int = BITS) -> Column:
    """Place on the curve of columns that hold whole numbers from 0 to 2**bits - 1."""
    n = len(dims)
    size = 1 << n
    table = ",".join(map(str, curve_table(n)))
    table = f"cast(split('{table}', ',') AS array<int>)"
    corner = " | ".join(f"((shiftright({d}, k) & 1) * {1 << j})" for j, d in enumerate(dims))
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('h', 0L, 's', 0), (a, k) -> "
        f"transform(array({table}[a.s * {size} + ({corner})]), e -> "
        f"named_struct('h', a.h * {size} + (e & {size - 1}), 's', shiftright(e, {n})))[0], a -> a.h)")


def document_dims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Four dimensions of 8 bits: source, language, size in steps of 128 bytes, id within its range.

    Names are hashed evenly; sizes above the last step share it. The id spreads out rows
    that agree in all else. NULLs count as empty names, and as the lowest size and id.
    """
    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    low, width = low or 0, (high or 0) - (low or 0) + 1

    def name(col: str) -> Column:
        return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, 2), 16, 10)

    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    place = F.floor((F.coalesce(F.col(id_col).cast("long"), F.lit(low)) - low).cast("double") * 256 / width)
    return [name("source").cast("int"), name("lang").cast("int"),
            F.least(F.shiftright(size, 7), F.lit(255)).cast("int"),
            F.least(place, F.lit(255)).cast("int")]


def hilbert_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Cut the curve into ``shards`` runs whose row counts are at most one apart.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_index``; slots run
    along the curve. ``size`` is the UTF-8 bytes of the text plus one, a NULL text counts as
    empty (size 1, crc 0). Ties on the curve go by id, then crc and size, and rows equal in all
    of these are interchangeable. Other columns than the id, text, source and lang are ignored.

    Rows are dealt by ranges of (curve, id), so no range depends on how often one source or text
    occurs, and written before they are numbered: a repeated task finds the same ranges.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    dims = document_dims(docs, id_col, text_col)
    names = [f"d{i}" for i in range(len(dims))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *[d.alias(n) for d, n in zip(dims, names)])
    rows = rows.withColumn("curve_index", curve_index(names)).drop(*names)
    order = ["curve_index", "doc_id", "text_crc32", "size"]
    ranged = scratch.keep(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    counts = sorted(map(tuple, ranged.groupBy("part").count().collect()))
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    # One row for each range, so its size is set by the number of partitions.
    starts = docs.sparkSession.createDataFrame(offsets, "part int, start long")
    rank = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).cast("long")
    placed = ranged.withColumn("rank", rank).join(F.broadcast(starts), "part")
    rank = F.col("rank") + F.col("start")
    shard = F.expr(f"(rank + start) * {shards}L div {max(total, 1)}L")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (rank - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def write_curve(docs: DataFrame, path: str, dims: Sequence[Column], bits: int = BITS) -> None:
    """Write ``docs`` as Parquet files that each hold one run of the curve, sorted along it, so
    that a filter on any of the dimensions skips most files by their footers."""
    names = [f"_dim{i}" for i in range(len(dims))]
    rows = docs.select("*", *[d.alias(n) for d, n in zip(dims, names)])
    rows = rows.withColumn("_curve", curve_index(names, bits)).drop(*names)
    rows.repartitionByRange("_curve", F.xxhash64(*docs.columns)).sortWithinPartitions(
        "_curve").drop("_curve").write.parquet(path)


def oracle(shards: int = 8) -> str:
    table = ",".join(map(str, curve_table(4)))
    step = "SELECT *, 0::BIGINT AS h, 0 AS s FROM dims"
    for k in range(BITS - 1, -1, -1):
        corner = " + ".join(f"((d{j} >> {k}) & 1) * {1 << j}" for j in range(4))
        step = (f"SELECT * EXCLUDE (h, s, e), h * 16 + (e & 15) AS h, e >> 4 AS s FROM "
                f"(SELECT *, (SELECT t FROM curve)[s * 16 + {corner} + 1] AS e FROM ({step}))")
    return f"""
WITH RECURSIVE curve AS (SELECT [{table}] AS t),
crc AS (
    SELECT i, 0 AS k, i AS c FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
sized AS (
    SELECT *, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
        min(doc_id) OVER () AS low, max(doc_id) OVER () AS high FROM documents),
bytes AS (
    SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: ('0x' || x)::BIGINT) AS b FROM sized),
dims AS (
    SELECT doc_id, size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, b),
            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)
            AS text_crc32,
        ('0x' || md5(coalesce(source, ''))[1:2])::INT AS d0, ('0x' || md5(coalesce(lang, ''))[1:2])::INT AS d1,
        least(size >> 7, 255)::INT AS d2,
        least(floor((coalesce(doc_id, low) - low)::DOUBLE * 256 / (high - low + 1)), 255)::INT AS d3
    FROM bytes, crc_table),
placed AS (
    SELECT doc_id, size, text_crc32, h AS curve_index, count(*) OVER () AS n,
        row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank FROM ({step}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (rank * {shards} // n)::INT AS shard,
    rank - ((rank * {shards} // n) * n + {shards - 1}) // {shards} AS slot,
    NULL::INT AS grown_shard, curve_index
FROM placed"""

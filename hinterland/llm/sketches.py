"""Arrow passes that turn texts into unit sketches and, for candidates only, unit sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.llm.words import (
    MinHash, blocks, set_digest, shingle_set, shingle_sets, unit_spans, units, word_hashes, word_spans,
)

from hinterland.llm.worker import give_back


@dataclass(frozen=True)
class Units:
    """What is compared: whole texts, or lines of at least ``least`` words; ``k`` word shingles.

    ``plans`` are (count, rows, seed) of MinHash collections kept for each unit.
    """

    k: int
    by_line: bool = False
    least: int = 1
    plans: tuple[tuple[int, int, int], ...] = ()


_SKETCH = "row_id long, row_key long, unit int, n int, digest binary, sketch array<array<long>>"
_SET = "digest binary, items array<long>"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text and a key of both; other columns, whatever they are called, are left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("row_id"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"),
        F.col(text_col).cast("string").alias("text"))


def _nested(values: list[np.ndarray], held: np.ndarray) -> pa.Array:
    """Collections of each unit that has any, as an array of arrays; the rest are empty."""
    counts = [v.shape[1] for v in values]
    flat = np.hstack(values).ravel() if values else np.zeros(0, np.int64)
    inner = np.r_[0, np.cumsum(np.tile(counts, int(held.sum())))].astype(np.int32)
    outer = np.r_[0, np.cumsum(np.where(held, len(values), 0))].astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(flat.astype(np.int64))))


def unit_sketches(docs: DataFrame, what: Units, id_col: str, text_col: str) -> DataFrame:
    """One row a unit: its set's size, 128-bit digest and MinHash collections.

    A text without words is no unit when units are lines; as a whole text it has n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [MinHash(*plan) for plan in what.plans]
        for batch in batches:
            ids, keys = batch.column("row_id"), batch.column("row_key")
            for first, data, at in blocks(batch.column("text")):
                start, end = word_spans(data, at)
                words = word_hashes(data, start, end)
                row, unit, a, b = unit_spans(data, at, start, what.by_line, what.least)
                values, n = shingle_sets(words, a, b, what.k)
                starts = np.cumsum(n) - n
                some = np.flatnonzero(n)
                digests = [set_digest(values[i:i + m]) for i, m in zip(starts.tolist(), n.tolist())]
                take = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), keys.take(take), pa.array(unit.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(digests, pa.binary()),
                     _nested([h.of_sets(values, starts[some]) for h in hashes], n > 0)],
                    ["row_id", "row_key", "unit", "n", "digest", "sketch"])
        give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, _SKETCH)


def unit_sets(docs: DataFrame, what: Units, id_col: str, text_col: str) -> DataFrame:
    """Digest and full set of every unit that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, items, held = [], [], 0
            for _, _, words in units(batch.column("text"), what.by_line, what.least):
                found = shingle_set(words, what.k)
                if len(found):
                    digests.append(set_digest(found))
                    items.append(found.view("int64"))
                    held += len(found)
                if held > 1 << 20:
                    yield _sets(digests, items)
                    digests, items, held = [], [], 0
            if digests:
                yield _sets(digests, items)
        give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, _SET)


def _sets(digests: list[bytes], items: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(digests, pa.binary()), pa.array(items, pa.list_(pa.int64()))],
        ["digest", "items"])


def place() -> Column:
    """A unit's place in the order of ids, then of lines; rows without an id come last."""
    return F.struct(F.col("row_id").isNull().alias("nameless"), "row_id", "unit", "row_key")


def distinct_nodes(sketches: DataFrame) -> DataFrame:
    """Equal sets become one node with a number, its size, sketch and first place.

    The number is only stable once the table is written.
    """
    return (
        sketches.where("n > 0").groupBy("digest")
        .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"),
             F.min(place()).alias("place"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )


def set_source(
    docs: DataFrame, nodes: DataFrame, what: Units, id_col: str, text_col: str,
) -> Callable[[DataFrame], DataFrame]:
    """How ``link_sets`` gets the sets of its candidates: from the texts that hold them first."""

    def fetch(wanted: DataFrame) -> DataFrame:
        known = nodes.join(wanted, "node", "left_semi").select(
            "node", "digest", F.col("place.row_id").alias("doc"))
        ids = known.select("doc").distinct()
        texts = docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids["doc"]), "left_semi")
        sets = unit_sets(texts, what, id_col, text_col)
        return sets.join(known, "digest").dropDuplicates(["node"]).select("node", "items")

    return fetch

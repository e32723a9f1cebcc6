"""Exact repeats of passages anywhere in a text, over line breaks and inside lines.

A passage is a window of ``WINDOW`` running words. Comparing every window would shuffle several
times the text, so a window is first known by the smallest of its ``SHINGLE``-word hashes, which
neighbouring windows mostly share. Equal windows have equal smallest hashes: where one occurs at a
single place its windows do so too, and only the windows of the others are compared, in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch
from hinterland.llm.words import blocks, run_hashes, word_hashes, word_spans
from hinterland.llm.worker import give_back

#: Passages of over 50 words are repeats.
WINDOW = 51
SHINGLE = 25

_WINDOWS = "number long, pos int, h1 long, h2 long"
_CUT = "text string, passages array<struct<first_word:int,n_words:int,kept_doc_id:bigint,kept_word:int>>"


def _lowest(values: np.ndarray, width: int, last: bool) -> np.ndarray:
    """Index of the smallest of each ``width`` running values, the first or last of equal ones."""
    at = np.arange(len(values))

    def pair(at: np.ndarray, step: int) -> np.ndarray:
        a, b = at[:len(at) - step], at[step:]
        later = values[b] <= values[a] if last else values[b] < values[a]
        return np.where(later, b, a)

    held = 1
    while held * 2 <= width:
        at, held = pair(at, held), held * 2
    return pair(at, width - held) if held < width else at


def _windows(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """For each block: a window's row and first word, the smallest shingle's first and last place
    and value, and the block's word hashes with each window's index in them."""
    for first, data, at in blocks(texts):
        start, end = word_spans(data, at)
        words = word_hashes(data, start, end)
        if len(words) < WINDOW:
            continue
        base = np.searchsorted(start, at)
        row = np.searchsorted(at, start, "right") - 1
        shingles = run_hashes(words, SHINGLE)
        width = WINDOW - SHINGLE + 1
        low, high = _lowest(shingles, width, False), _lowest(shingles, width, True)
        whole = np.flatnonzero(row[:len(low)] == row[WINDOW - 1:])
        low, high, row = low[whole], high[whole], row[whole]
        yield first + row, (whole - base[row]).astype(np.int32), low, high, shingles, words, whole


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("number")
        for row, _, low, high, shingles, _, _ in _windows(batch.column("text")):
            # A place is counted once, however many windows it is the smallest of.
            places, index = np.unique(np.concatenate([low, high]), return_index=True)
            held = np.concatenate([row, row])[index]
            yield pa.RecordBatch.from_arrays(
                [numbers.take(pa.array(held)), pa.array(shingles[places].view(np.int64))],
                ["number", "mark"])
    give_back()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, marks = batch.column("number"), batch.column("marks")
        for row, pos, low, _, shingles, words, whole in _windows(batch.column("text")):
            value = shingles[low].view(np.int64)
            hit = np.zeros(len(row), bool)
            edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                hit[a:b] = np.isin(value[a:b], marks[int(row[a])].values.to_numpy(zero_copy_only=False))
            found = whole[hit]
            yield pa.RecordBatch.from_arrays(
                [numbers.take(pa.array(row[hit])), pa.array(pos[hit]),
                 pa.array(run_hashes(words, WINDOW)[found].view(np.int64)),
                 pa.array(run_hashes(words, WINDOW, second=True)[found].view(np.int64))],
                ["number", "pos", "h1", "h2"])
    give_back()


def _take_out(text: str | None, cuts: list | None) -> tuple[str | None, list] | None:
    """The text without the windows of ``cuts(pos, kept_id, kept_pos, own)``.

    Where a window's first place is in the same text the two can overlap: the first stays whole.
    Of the white space on both sides of a passage the one with a line break stays.
    """
    if text is None or not cuts:
        return None
    runs: list[list] = []
    for pos, kept_id, kept_pos, own in sorted(cuts, key=lambda c: c[0]):
        a, b = max(pos, kept_pos + WINDOW) if own else pos, pos + WINDOW
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, kept_id, kept_pos + a - pos])
    raw = text.encode()
    start, end = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, done = [], 0
    for a, b, _, _ in runs:
        before = int(end[a - 1]) if a else 0
        after = int(start[b]) if b < len(start) else len(raw)
        lead, trail = raw[before:int(start[a])], raw[int(end[b - 1]):after]
        out += [raw[done:before], trail if b"\n" in trail and b"\n" not in lead else lead]
        done = after
    out.append(raw[done:])
    return b"".join(out).decode(), [(a, b - a, i, k) for a, b, i, k in runs]


def repeated_windows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Windows that an earlier place holds too, by row: ``number, cuts``.

    ``docs(number, row_id, text)`` has unique numbers. Places are in the order of ids, then of
    the texts' hashes, numbers and words; rows without an id come last.
    """
    texts = docs.select("number", "text")
    marks = scratch.keep(texts.mapInArrow(_marks, "number long, mark long"), "marks")
    common = scratch.keep(
        marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "common")
    rows = scratch.keep(
        marks.join(common, "mark").groupBy("number").agg(F.collect_set("mark").alias("marks")), "rows")
    names = docs.select("number", "row_id", F.xxhash64("text").alias("text_key"))
    windows = scratch.keep(
        texts.join(rows, "number").mapInArrow(_candidates, _WINDOWS)
        .join(names.join(rows.select("number"), "number", "left_semi"), "number"), "windows")
    scratch.drop(marks, common, rows)
    place = F.struct(F.col("row_id").isNull().alias("nameless"), "row_id", "text_key", "number", "pos")
    first = scratch.keep(
        windows.groupBy("h1", "h2").agg(F.min(place).alias("kept"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "first_windows")
    cuts = scratch.keep(
        windows.join(first, ["h1", "h2"])
        .where("number <> kept.number OR pos <> kept.pos")
        .groupBy("number").agg(F.collect_list(F.struct(
            "pos", F.col("kept.row_id").alias("kept_id"), F.col("kept.pos").alias("kept_pos"),
            (F.col("number") == F.col("kept.number")).alias("own"))).alias("cuts")), "cuts")
    scratch.drop(windows, first)
    return cuts


def take_out(text: Column, cuts: Column) -> Column:
    """``text`` and ``passages``: what is left and what was taken out; NULL where nothing was."""
    return F.udf(_take_out, _CUT, useArrow=False)(text, cuts)

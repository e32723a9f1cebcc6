"""Importance resampling towards a target set, over hashed runs of words."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.prefix_crc import run_crcs
from hinterland.llm.ranks import global_rank
from hinterland.llm.scratch import Scratch

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``side, bucket, n`` of ``texts(side, text)``: how often runs of words fall into each bucket.

    A task adds up its own texts and sends at most ``buckets`` rows a side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            for side in np.unique(sides):
                total = totals.setdefault(int(side), np.zeros(buckets, np.int64))
                for _, _, found in run_crcs(batch.column("text").filter(pa.array(sides == side)), longest):
                    for crc, _ in found:
                        total += np.bincount(crc % buckets, minlength=buckets)
        for side, total in totals.items():
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), side, np.int32)), pa.array(held.astype(np.int32)),
                 pa.array(total[held])], ["side", "bucket", "n"])

    return texts.mapInArrow(run, "side int, bucket int, n long").groupBy("side", "bucket").agg(
        F.sum("n").alias("n"))


def bucket_gains(counts: list[tuple[int, int, int]], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of target to raw share of each bucket, smoothed by one, floored."""
    held = np.zeros((2, buckets))
    for side, bucket, n in counts:
        held[side, bucket] = n
    raw, target = held.sum(axis=1)
    return np.array([
        math.floor(1000 * math.log((t + 1) * (raw + buckets) / ((s + 1) * (target + buckets))))
        for s, t in held.T], np.int64)


def _noise(name: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(
    docs: DataFrame, gains: np.ndarray, longest: int, seed: int, id_col: str, text_col: str,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``: mean gain of a text's runs plus Gumbel noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            names = ["" if i is None else str(i) for i in ids.to_pylist()]
            for first, words, found in run_crcs(batch.column("text"), longest):
                n = np.zeros(len(words), np.int64)
                total = np.zeros(len(words), np.int64)
                for crc, runs in found:
                    upto = np.concatenate([[0], np.cumsum(gains[crc % len(gains)])])
                    last = np.cumsum(runs)
                    total += upto[last] - upto[last - runs]
                    n += runs
                weight = total // np.maximum(n, 1)
                noise = [_noise(names[first + i], seed) for i in range(len(words))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(words)), pa.array(words.astype(np.int64)), pa.array(n),
                     pa.array(weight), pa.array(weight + np.array(noise, np.int64))],
                    ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_features, weight, score, rank``.

    Features are all runs of 1 to ``longest`` words, repeats counted; a feature's bucket is its
    CRC-32 modulo ``buckets``, got from two prefix CRCs of its text. A document's weight is the
    floored mean of its features' gains, 0 without features. Of the N documents with at least
    ``least_words`` words the ``N * percent`` / 100 highest scores are drawn and ranked from 1,
    ties to the smaller id; ``rank`` is NULL for all others.

    NULL, empty and wordless texts have no features. A row without an id takes part as if its id
    were the empty text and comes last among ties; repeated rows are documents of their own, and
    any of them may come first. Other columns are ignored. Without a target all shares of the
    target are equal; an empty table gives an empty result.

    The counts of the buckets, and the counts of the scores that find the lowest score drawn,
    reach the driver. Both tables are bounded: gains lie within 1000 times the log of the larger
    count, the noise between -3200 and 23000.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def side(rows: DataFrame, number: int) -> DataFrame:
        return rows.select(F.lit(number).alias("side"), F.col(text_col).cast("string").alias("text"))

    both = side(docs, 0).unionByName(side(target, 1))
    gains = bucket_gains([tuple(r) for r in bucket_counts(both, buckets, longest).collect()], buckets)

    scored = importance_scores(docs, gains, longest, seed, id_col, text_col)
    rows = scratch.keep(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    by_score = sorted(map(tuple, able.groupBy("score").count().collect()), reverse=True)
    quota = sum(n for _, n in by_score) * percent // 100
    cutoff, met = None, 0
    for value, n in by_score:
        if met >= quota:
            break
        cutoff, met = value, met + n
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return rows.select(*columns, none)
    near = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    order = {"_low": -F.col("score"), "_nameless": F.col("doc_id").isNull()}
    ranked = global_rank(rows.where(near).withColumns(order), [*order, "doc_id", "_row"], "rank", scratch)
    drawn = F.when(F.col("rank") <= quota, F.col("rank")).alias("rank")
    return ranked.select(*columns, drawn).unionByName(rows.where(~near).select(*columns, none))


#: ``documents`` and ``benchmark``, runs of one word.
ORACLE = rf"""
WITH RECURSIVE crc AS (
    SELECT i, 0 AS k, i AS c FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
    FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
texts AS (
    SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
split AS (
    SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS (SELECT side, row, unnest(w) AS word FROM split),
buckets AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
    FROM (SELECT DISTINCT word FROM words), crc_table),
held AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
    FROM words JOIN buckets USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE
        / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM held),
sums AS (
    SELECT row, count(*) AS n, sum(gain)::BIGINT AS total
    FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
weighed AS (
    SELECT doc_id, coalesce(n, 0) AS n_words,
        coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
        ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
    FROM split LEFT JOIN sums USING (row) WHERE side = 0),
scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS}
            ORDER BY score DESC, doc_id NULLS LAST) AS place,
        count(*) FILTER (n_words >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS quota
    FROM scored)
SELECT doc_id, n_words AS n_features, weight, score,
    CASE WHEN n_words >= {LEAST_WORDS} AND place <= quota THEN place END AS rank
FROM ranked"""

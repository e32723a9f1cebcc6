"""One query for each operator, over its whole table, and the oracle text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hinterland.llm import (
    hilbert, importance, projection_passes, sharded_lloyd, url_templates, warc, weak_quality,
)
from hinterland.llm.bpe_duckdb import encode_decode
from hinterland.llm.hilbert import hilbert_shards
from hinterland.llm.importance import resample
from hinterland.llm.kmeans_tree import nearest_neighbours
from hinterland.llm.main_text import extract_main_text
from hinterland.llm.near_dedup import near_duplicates
from hinterland.llm.packing import pack_pieces
from hinterland.llm.paragraph_dedup import dedup_paragraphs
from hinterland.llm.projection_passes import near_vectors
from hinterland.llm.sharded_lloyd import cluster_vectors
from hinterland.llm.url_templates import filter_urls
from hinterland.llm.warc import archived_pages
from hinterland.llm.weak_quality import judge_quality

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_hilbert(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards(_table(spark, folder, "documents"))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(_table(spark, folder, "pages"))


def op3_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op4_tensored_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"), shingle=2)


def op5_power_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_pieces(_table(spark, folder, "documents"),
                       public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op6_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_paragraphs(_table(spark, folder, "documents")).select(
        "doc_id", "text", "n_removed", "removed", "passages")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(_table(spark, folder, "pages"))


def op8_bpe_duckdb(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, with_outputs=False)


def op9_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_table(spark, folder, "embeddings"))


def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(_table(spark, folder, "pages"))


def op11_prefix_crc(spark: SparkSession, folder: str) -> DataFrame:
    return resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


def op12_sharded_lloyd(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(_table(spark, folder, "embeddings"))


def op13_projection_passes(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_hilbert, op2_warc, op3_weak_quality, op4_tensored_minhash, op5_power_packing,
    op6_paragraph_dedup, op7_main_text, op8_bpe_duckdb, op9_kmeans_tree, op10_url_templates,
    op11_prefix_crc, op12_sharded_lloyd, op13_projection_passes)}

#: Links of near duplicates, exactly: sets that share a shingle are compared in full.
_NEAR = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(w, lambda x: x)
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
    FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
seen AS (SELECT x, count(*) AS n FROM items GROUP BY x),
prefix AS (
    SELECT i.doc_id, i.x, len(s.s) AS size,
        row_number() OVER (PARTITION BY i.doc_id ORDER BY seen.n, i.x) AS k
    FROM items i JOIN seen USING (x) JOIN sets s USING (doc_id)
    QUALIFY k <= size - (size * 80 + 99) // 100 + 1),
candidates AS (
    SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM prefix a JOIN prefix b USING (x)
    WHERE a.doc_id < b.doc_id AND least(a.size, b.size) * 100 >= greatest(a.size, b.size) * 80),
links AS (
    SELECT u, v FROM (
        SELECT u, v, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS t
        FROM candidates JOIN sets a ON a.doc_id = u JOIN sets b ON b.doc_id = v)
    WHERE 100 * c >= 80 * (t - c)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, low) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT b.v, r.low FROM reach r JOIN both_ways b ON b.u = r.doc_id WHERE r.low < b.v),
least_id AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_id USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op1_hilbert": hilbert.oracle(),
    "op2_warc": warc.ORACLE,
    "op3_weak_quality": weak_quality.oracle(),
    "op4_tensored_minhash": _NEAR,
    "op10_url_templates": url_templates.oracle(),
    "op11_prefix_crc": importance.ORACLE,
    "op12_sharded_lloyd": sharded_lloyd.oracle(),
    "op13_projection_passes": projection_passes.ORACLE,
}

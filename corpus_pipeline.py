"""A training corpus from ``documents``: quality, near duplicates, repeated paragraphs, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinterland.llm.near_dedup import near_duplicates
from hinterland.llm.packing import pack_pieces
from hinterland.llm.paragraph_dedup import dedup_paragraphs
from hinterland.llm.scratch import WATCHERS, Scratch
from hinterland.llm.weak_quality import judge_quality


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Intermediate tables of the stage that ran last.
_made: list[Scratch] = []


def stage(run: Stage) -> Stage:
    """A stage gives back the intermediate tables of the one before it. Those rows have been written
    by then: a stage reads its input from where the output of the last one was written."""

    @wraps(run)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _made:
            _made.pop().close()
        WATCHERS.append(_made)
        try:
            return run(spark, docs, sf_dir)
        finally:
            WATCHERS.remove(_made)

    return started


def numbered(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a number for each row that stays the same when the table is read again: its
    file's place and its row there. Rows that come from no file are written first."""
    try:
        paths = docs.select(F.col("_metadata.file_path").alias("p")).distinct()
        files = sorted(r["p"] for r in paths.collect())
        places = docs.sparkSession.createDataFrame(list(enumerate(files)), "_place long, _path string")
        rows = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index"))
        place = F.shiftleft("_place", 40) + F.col("_index")
        # One row a file: its size is set by the number of files.
        return rows.join(F.broadcast(places), "_path").withColumn(name, place).select(*docs.columns, name)
    except AnalysisException:
        return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that weak supervision keeps.

    Rows are told apart by a hash of id and text, so repeated or NULL ids do no harm.
    """
    row = F.xxhash64(docs["doc_id"], docs["text"])
    verdicts = judge_quality(docs.select(row.alias("doc_id"), "text"))
    kept = Scratch(spark).keep(verdicts.where("kept").select("doc_id").distinct(), "kept")
    return docs.join(kept, row == kept["doc_id"], "left_semi")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, by shingles of five words.

    Rows are told apart by a number of their own, so that ids may repeat or be NULL. Of a group
    the row with the smallest id stays, of rows without ids or with one id that of the smallest
    hash; rows without words stay.
    """
    scratch = Scratch(spark)
    number = "_number"
    while number in docs.columns:
        number += "_"
    rows = numbered(docs, number, scratch)
    found = near_duplicates(rows, id_col=number, shingle=5).select(
        F.col("doc_id").alias("n"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(number).alias("n"))
    kept = scratch.keep(
        found.join(rows.select(F.col(number).alias("n"), place.alias("place")), "n")
        .groupBy("component_id").agg(F.min("place").alias("place")).select("place.n"), "kept")
    scratch.rest()
    return rows.join(kept, rows[number] == kept["n"], "left_semi").drop(number)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that an earlier place holds; ``n_chars`` follows the text.

    Every row stays, NULL and empty texts unchanged; an empty table stays empty.
    """
    cleaned = dedup_paragraphs(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length of what is left. NULL texts are empty, repeated rows get
    pieces each, an empty table gives none."""
    import public_tokenizers

    return pack_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Packing needs a tokenizer and the paragraph stage exact set joins, which SQL can't say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again, and removed once
    the next one is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, step in STAGES[:-1]:
        found = scratch.keep(step(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = found
    return STAGES[-1][1](spark, docs, sf_dir)

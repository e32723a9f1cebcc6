"""Substring dedup by MinHash banding of paragraphs, then of exact passages across lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.passages import repeated_windows, take_out
from hinterland.llm.scratch import Scratch
from hinterland.llm.similar_sets import link_sets
from hinterland.llm.sketches import Units, distinct_nodes, place, set_source, unit_sketches

#: 16 bands of 3 rows: paragraphs of similarity 0.8 share no band with probability 0.00001,
#: those of 0.9 with 0.00000000003. Tuned for recall; wrong candidates fail the exact test.
BANDS, ROWS, SEED = 16, 3, 303
#: Paragraphs of fewer words are left alone: short lines recur in clean text.
LEAST_WORDS = 40


def band_keys(nodes: DataFrame) -> DataFrame:
    """``(key, node, n, early)``: one key a band; the first quarter is looked at first."""
    bands = F.transform(F.col("sketch")[0], lambda x, i: F.struct(
        F.xxhash64(x, i).alias("key"), (i < BANDS // 4).alias("early")))
    return nodes.select(F.explode(bands).alias("k"), "node", "n").select("k.key", "node", "n", "k.early")


def repeated_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Paragraphs to remove: ``row_key, doc_id, unit, kept_doc_id, kept_unit``.

    A paragraph is a ``\\n`` line (``unit`` counts all lines from 0) of at least ``least_words``
    words. Two are linked when the Jaccard similarity of their ``shingle``-word sets is at
    least ``percent`` / 100, exactly measured. Of each connected component the place with the
    smallest (doc_id, unit) stays, all others are removed, also within one document.
    ``row_key`` hashes id and text and finds the row again where ids repeat or are NULL.
    """
    scratch = Scratch(docs.sparkSession)
    what = Units(k=shingle, by_line=True, least=least_words, plans=((BANDS, ROWS, SEED),))
    places = scratch.keep(unit_sketches(docs, what, id_col, text_col), "places")
    nodes = scratch.keep(distinct_nodes(places), "nodes")
    fetch = set_source(docs, nodes, what, id_col, text_col)
    labels = link_sets(band_keys(nodes), fetch, scratch, percent)

    member = nodes.select("node", "digest", "place", "copies").join(labels, "node", "left")
    alone = member.where("component IS NULL AND copies > 1").select(
        "digest", F.col("place").alias("kept"))
    linked = member.where("component IS NOT NULL")
    first = scratch.keep(linked.groupBy("component").agg(F.min("place").alias("kept")), "first")
    clusters = scratch.keep(
        linked.join(first, "component").select("digest", "kept").unionByName(alone), "clusters")
    gone = scratch.keep(
        places.select("row_id", "row_key", "unit", "digest").join(clusters, "digest")
        .where(~place().eqNullSafe(F.col("kept")))
        .select("row_key", F.col("row_id").alias("doc_id"), "unit",
                F.col("kept.row_id").alias("kept_doc_id"), F.col("kept.unit").alias("kept_unit")), "gone")
    scratch.drop(places, nodes, first, clusters)
    scratch.rest()
    return gone


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def dedup_paragraphs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``docs`` with repeated paragraphs and passages taken out of the text, and three columns more.

    First whole lines go that are near copies of an earlier line. Of what is left each run of
    over 50 words that an earlier place holds word for word goes as well, wherever it lies:
    inside a longer line, over several lines, or across a line break. Words are compared as
    for paragraphs, so case and white space make no difference.

    ``n_removed`` counts the lines and passages taken out; ``removed`` lists the lines with the
    place of the copy that stays, ``passages`` the runs: ``first_word`` counts the words that the
    line step left, from 0, and ``kept_word`` those of the text that keeps the run's first window.
    Every row stays, in any case: NULL texts and rows without repeats are unchanged, and a row
    that loses all its lines has an empty text. Rows equal in id and text hold the same lines and
    lose the same ones, but a passage stays in one row only. Columns of ``docs`` called
    ``n_removed``, ``removed`` or ``passages`` are replaced; others are carried along.
    """
    gone = repeated_paragraphs(docs, id_col, text_col, shingle, percent, least_words)
    scratch = Scratch(docs.sparkSession)
    found, own = _free_name(docs, "_cuts"), _free_name(docs, "_cut_key")
    number, out = _free_name(docs, "_number"), _free_name(docs, "_left")
    lists = scratch.keep(
        gone.select("row_key", F.struct("unit", "kept_doc_id", "kept_unit").alias("cut")).distinct()
        .groupBy(F.col("row_key").alias(own)).agg(F.sort_array(F.collect_list("cut")).alias(found)), "lists")
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    rows = docs.drop("n_removed", "removed", "passages")
    cuts = F.transform(found, lambda c: c["unit"])
    lines = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(cuts, i))
    left = scratch.keep(
        rows.join(lists, key == lists[own], "left")
        .withColumns({
            text_col: F.when(F.col(found).isNull(), F.col(text_col))
            .otherwise(F.array_join(lines, "\n")),
            "removed": F.coalesce(F.col(found), F.array().cast(
                "array<struct<unit:int,kept_doc_id:bigint,kept_unit:int>>")),
            number: F.monotonically_increasing_id(),
        })
        .select(*rows.columns, "removed", number), "left")
    scratch.drop(lists)
    scratch.rest()
    windows = repeated_windows(left.select(
        F.col(number).alias("number"), F.col(id_col).cast("long").alias("row_id"),
        F.col(text_col).cast("string").alias("text")), scratch).select(
        F.col("number").alias(own), F.col("cuts").alias(found))
    scratch.rest()
    # Texts that lose nothing are not sent to Python.
    cut = take_out(F.when(F.col(found).isNotNull(), F.col(text_col)), F.col(found))
    return (
        left.join(windows, F.col(number) == F.col(own), "left").withColumn(out, cut)
        .withColumns({
            text_col: F.coalesce(F.col(f"{out}.text"), F.col(text_col)),
            "passages": F.coalesce(F.col(f"{out}.passages"), F.array().cast(
                "array<struct<first_word:int,n_words:int,kept_doc_id:bigint,kept_word:int>>")),
        })
        .withColumn("n_removed", F.size("removed") + F.size("passages"))
        .select(*rows.columns, "n_removed", "removed", "passages")
    )

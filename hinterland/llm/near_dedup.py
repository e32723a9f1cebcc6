"""MinHash near-dedup with tensored banding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch
from hinterland.llm.similar_sets import link_sets
from hinterland.llm.sketches import Units, distinct_nodes, set_source, unit_sketches

#: Two collections of MinHash values, (count, rows combined, seed). A table key is a pair of
#: values, one from each: 8 x 11 = 88 tables of 5 rows from 49 hash functions instead of 440.
#: Sets of similarity s share a key unless a whole collection differs, so at s = 0.8 the chance
#: to miss is (1 - s^2)^8 + (1 - s^3)^11 = 0.0007, at 0.9 it is 0.000002.
COLLECTIONS = ((8, 2, 101), (11, 3, 202))


def tensored_keys(nodes: DataFrame) -> DataFrame:
    """``(key, node, n, early)``: every pair of a value of the first and of the second collection.

    The pairs of like position are looked at first.
    """
    a, b = F.col("sketch")[0], F.col("sketch")[1]
    keys = F.flatten(F.transform(a, lambda x, i: F.transform(
        b, lambda y, j: F.struct(F.xxhash64(x, y, i, j).alias("key"), (i == j).alias("early")))))
    return nodes.select(F.explode(keys).alias("k"), "node", "n").select("k.key", "node", "n", "k.early")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``percent`` / 100 are linked; a document's component is the smallest id it reaches.
    Candidates share a tensored key, links are confirmed on full sets.

    NULL or wordless texts have n_shingles 0 and are linked with nothing. Texts with fewer words
    than a shingle have one shingle, all their words. Each repeated row gets a row of its own.
    Rows without an id take part and get the smallest id they reach, NULL if there is none;
    they are kept only then. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    what = Units(k=shingle, plans=COLLECTIONS)
    sketches = scratch.keep(unit_sketches(docs, what, id_col, text_col), "sketches")
    nodes = scratch.keep(distinct_nodes(sketches), "nodes")
    fetch = set_source(docs, nodes, what, id_col, text_col)
    labels = link_sets(tensored_keys(nodes), fetch, scratch, percent)

    named = nodes.select("node", "digest", F.col("place.row_id").alias("first")).join(
        labels, "node", "left")
    lone = named.where("component IS NULL").select("digest", F.col("first").alias("component_id"))
    linked = named.where("component IS NOT NULL")
    smallest = scratch.keep(
        linked.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    names = scratch.keep(
        linked.join(smallest, "component").select("digest", "component_id").unionByName(lone), "names")
    scratch.drop(smallest)
    with_set = sketches.where("n > 0").select("row_id", "n", "digest").join(names, "digest", "left")
    without = sketches.where("n = 0").select("row_id", "n", F.col("row_id").alias("component_id"))
    found = scratch.keep(with_set.select("row_id", "n", "component_id").unionByName(without), "found")
    scratch.drop(sketches, nodes, names)
    scratch.rest()
    return found.select(
        F.col("row_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id",
        F.col("row_id").eqNullSafe(F.col("component_id")).alias("kept"))

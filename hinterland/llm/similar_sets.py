"""Links between similar sets: candidates from shared keys, verified on full sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hinterland.llm.components import components
from hinterland.llm.scratch import Scratch

#: Rounds of pivots go on while they leave at most this share of the members of keys open.
SHRINK = 0.8


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose intersection has at least ``percent`` per cent of their union."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "u").join(right, "v")
        .withColumn("common", common)
        .where(F.col("common") * 100 >= percent * (F.size("x") + F.size("y") - F.col("common")))
        .select("u", "v")
    )


def _sizes_fit(a: str, b: str, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


#: A set's parities: for each of 64 * PARITY_WORDS classes of items, whether it holds an odd number.
PARITY_WORDS = 8
_PARITY = (f"transform(sequence(0, {PARITY_WORDS - 1}), w -> aggregate(filter(items, "
           f"x -> pmod(shiftright(x, 6), {PARITY_WORDS}) = w), 0L, "
           "(a, x) -> a ^ shiftleft(1L, CAST(x & 63 AS INT))))")


def _parity_fits(a: str, b: str, na: str, nb: str, percent: int) -> Column:
    """False only for pairs that are surely not similar: where parities differ, an item lies in
    one set only, and similar sets have few of those."""
    apart = " + ".join(f"bit_count({a}[{w}] ^ {b}[{w}])" for w in range(PARITY_WORDS))
    return F.expr(f"({apart}) * {100 + percent} <= {100 - percent} * ({na} + {nb})")


def _rare_pairs(nodes: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """All pairs ``(u, v)`` of ``nodes(node, component)`` that can be similar across components.

    With items ordered by rarity, two sets that share ``percent`` per cent of their union share
    an item among their first n - ceil(n * percent / 100) + 1, and at the first that they share
    what is left of either still suffices; other pairs never meet. Of those that meet, the join
    keeps the ones whose parities allow the similarity.
    """
    items = scratch.keep(sets.join(nodes, "node").select(
        "node", "component", F.size("items").alias("n"), F.explode("items").alias("item")), "items")
    seen = scratch.keep(items.groupBy("item").agg(F.count("*").alias("seen")).where("seen > 1"), "seen")
    # Items of one set only come first and pair nothing: they only push the others back.
    shared = items.join(seen, "item")
    counts = shared.groupBy("node").agg(F.count("*").alias("m"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("seen", "item"))
    first = scratch.keep(
        shared.withColumn("rank", rank).join(counts, "node").withColumn("i", F.expr("rank + n - m"))
        .where(f"i <= n - (n * {percent} + 99) div 100 + 1")
        .join(sets.select("node", "bits"), "node")
        .select("node", "component", "n", "item", "i", "bits"), "first")
    left = first.select("item", F.col("node").alias("u"), F.col("n").alias("nu"),
                        F.col("component").alias("cu"), F.col("i").alias("iu"), F.col("bits").alias("bu"))
    right = first.select("item", F.col("node").alias("v"), F.col("n").alias("nv"),
                         F.col("component").alias("cv"), F.col("i").alias("iv"), F.col("bits").alias("bv"))
    pairs = left.join(right, "item").where("cu < cv").where(_sizes_fit("nu", "nv", percent)).where(
        f"(1 + least(nu - iu, nv - iv)) * (100 + {percent}) >= {percent} * (nu + nv)").where(
        _parity_fits("bu", "bv", "nu", "nv", percent))
    pairs = scratch.keep(pairs.select("u", "v").distinct(), "rare")
    scratch.drop(items, seen, first)
    return pairs


def link_sets(
    keys: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    percent: int = 80,
) -> DataFrame:
    """Components of sets that share a key and are similar: ``(node, component)``.

    ``keys(key, node, n, early)`` holds a set's keys and size and marks the few keys that are
    looked at first; ``fetch`` returns ``(node, items)`` for a table of nodes. Nodes without a
    link are not in the result.

    Within a key sets are compared with one pivot, so that a key shared by g sets costs g pairs.
    The pivot is the member that shares the most keys with the most sets: of an original and its
    changed copies that is the original, which is similar to more of them than they are to each
    other. The early keys join most copies; from then on only keys that still hold several
    components are looked at, and in them only sets of another component than the pivot's, as a
    pair within one changes nothing. Rounds go on while they close keys; what remains is compared
    exactly, by rare items. No pair of sets that share a key is thus left out, and no key is dropped
    for its size.
    """
    shared = scratch.keep(
        keys.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high").select("key", "held"), "shared")
    members = scratch.keep(keys.join(shared.hint("shuffle_hash"), "key"), "members")
    scratch.drop(shared)
    scratch.rest()
    sets = scratch.keep(fetch(members.select("node").distinct()).withColumn("bits", F.expr(_PARITY)), "sets")
    sizes = scratch.keep(
        members.groupBy("node").agg(F.first("n").alias("n"), F.sum("held").alias("score"))
        .join(sets.select("node", "bits"), "node"), "sizes")
    links: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """Verify pairs ``(u, v)`` and label all nodes linked so far."""
        pairs = pairs.distinct().join(
            sizes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu")), "u").join(
            sizes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")), "v")
        pairs = scratch.keep(
            pairs.where(_sizes_fit("nu", "nv", percent)).where(_parity_fits("bu", "bv", "nu", "nv", percent))
            .select("u", "v"), "pairs")
        links.append(scratch.keep(_verified(pairs, sets, percent), "links"))
        scratch.drop(pairs)
        return components(reduce(DataFrame.unionByName, links), scratch)

    def opened(rows: DataFrame) -> DataFrame:
        """Members of keys that hold several components, next to the key's pivot."""
        best = F.max(F.struct("score", -F.col("node"), "node", "component")).alias("best")
        open_keys = rows.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), best).where("low < high").select(
            "key", F.col("best.node").alias("pivot"), F.col("best.component").alias("own"))
        return rows.join(open_keys, "key")

    def pivot_pairs(rows: DataFrame) -> DataFrame:
        return rows.where("component <> own").select(
            F.least("pivot", "node").alias("u"), F.greatest("pivot", "node").alias("v"))

    scores = sizes.select("node", "score")
    early = members.where("early").select("key", "node").join(scores, "node").withColumn("component", F.col("node"))
    labels = linked(pivot_pairs(opened(early)))
    rest, before = members.select("key", "node"), None
    while True:
        named = scratch.keep(
            rest.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            .join(scores, "node"), "named")
        scratch.drop(members)
        members = scratch.keep(opened(named), "members")
        scratch.drop(named)
        scratch.rest()
        count = members.count()
        if not count:
            break
        if before is not None and count > SHRINK * before:
            labels = linked(_rare_pairs(members.select("node", "component").distinct(), sets, scratch, percent))
            break
        labels, before = linked(pivot_pairs(members)), count
        rest = members.where("node <> pivot").select("key", "node")
    scratch.drop(members, sets, sizes, *links)
    return labels

"""Roll-ups, weighted means, profiles, histograms and exact quantiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hinterland.functions.scalar import round_large
from hinterland.operators.frame import pivot_keys, pivoted, split_col, stack_rows, to_long
from hinterland.operators.joins import attach_row, keyed_join
from hinterland.sources.checkpoint import materialise

#: Sketches have 2 ** 12 registers: 2.5 KB a group and a standard error of 1.04 / 64.
SKETCH_BITS = 12


def rollup(
    df: DataFrame,
    key: str,
    n_chars: int,
    provider: str,
    means: Mapping[str, str],
    digits: int | None = 3,
    blank_as_zero: bool = False,
    approximate: bool = False,
    by: Sequence[str] = (),
    sketch: str | None = None,
) -> DataFrame:
    """Row count, distinct providers and mean measures by the leading ``n_chars`` of a key
    and any further ``by`` columns, such as a period.

    ``means`` maps output names to measure columns. Text that is no number is skipped, or
    counted as 0 with ``blank_as_zero``. The distinct count is planned on (key, provider)
    first, so a key with very many rows is reduced before it reaches one task.
    ``approximate`` swaps it for a fixed-size sketch. ``sketch`` names a further column that
    keeps a group's providers as a sketch, so that roll-ups can be merged later.
    """
    def measure(c: str) -> Column:
        v = F.col(c).try_cast("double")
        if blank_as_zero:
            v = F.when(F.col(c).isNotNull(), F.coalesce(v, F.lit(0.0)))
        m = F.avg(v)
        return m if digits is None else F.round(m, digits)

    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return (
        df.groupBy(F.substring(key, 1, n_chars).alias(key), *by)
        .agg(
            F.count("*").alias("mcount"),
            distinct(provider).alias("pcount"),
            *[measure(c).alias(name) for name, c in means.items()],
            *([F.hll_sketch_agg(provider, F.lit(SKETCH_BITS)).alias(sketch)] if sketch else []),
        )
    )


def provider_pairs(
    df: DataFrame, key: str, n_chars: int, provider: str, by: Sequence[str] = (), distinct: bool = True,
) -> DataFrame:
    """The exact state of a roll-up's distinct count: one row a key and provider.

    ``distinct=False`` leaves that to a merge that follows at once: it makes the pairs of all sources
    distinct in any case, and a task then holds them in one hash table, not in one a source and two more.
    """
    pairs = df.where(F.col(provider).isNotNull()).select(F.substring(key, 1, n_chars).alias(key), *by, provider)
    return pairs.distinct() if distinct else pairs


def merge_rollups(
    parts: Sequence[DataFrame],
    key: str | Sequence[str],
    counts: Sequence[str] = ("mcount", "pcount"),
    means: Sequence[str] = ("download", "upload"),
    weight: str = "mcount",
    digits: int | None = 3,
    distinct: str = "pcount",
    sketch: str | None = None,
    pairs: Sequence[DataFrame] = (),
) -> DataFrame:
    """Merge roll-ups of several sources: counts add up, means combine by ``weight``.

    A NULL mean takes its rows out of that mean's weight too. Distinct counts are added,
    so a provider that occurs in two sources counts twice, unless the roll-ups keep the
    providers: ``pairs`` are their ``provider_pairs``, which give ``distinct`` exactly, and
    ``sketch`` names their sketch column, which estimates it with a standard error of 1.6 % and
    stays in the result, merged.
    """
    if pairs and sketch:
        raise ValueError("either pairs or sketch")
    key = [key] if isinstance(key, str) else list(key)
    counts = [c for c in counts if c != distinct or not (pairs or sketch)]
    columns = [*key, *counts, *means, *([sketch] if sketch else [])]
    rows = reduce(DataFrame.union, [p.select(*columns) for p in parts])

    def mean(c: str) -> Column:
        n = F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))
        m = F.try_divide(F.sum(F.col(weight) * F.col(c)), n)
        return (m if digits is None else F.round(m, digits)).alias(c)

    union = [F.hll_union_agg(sketch).alias(sketch)] if sketch else []
    merged = rows.groupBy(*key).agg(
        *[F.sum(c).alias(c) for c in counts], *[mean(c) for c in means], *union
    )
    if sketch:
        return merged.withColumn(distinct, F.hll_sketch_estimate(sketch))
    if pairs:
        # Pairs are distinct first, so a key with very many of them is counted in parts.
        counted = reduce(DataFrame.union, pairs).distinct().groupBy(*key).agg(F.count("*").alias(distinct))
        return keyed_join(merged, counted, key, null_safe=True).fillna({distinct: 0})
    return merged


def weighted_mean(
    df: DataFrame,
    cols: Sequence[str],
    weight: str,
    by: Sequence[str] = (),
    scale: float = 1.0,
    na_propagate: bool = False,
) -> DataFrame:
    """``sum(x*w)/sum(w)`` of each column. NULL values are skipped with their weight, or
    make the group NULL with ``na_propagate``."""
    w = F.col(weight)

    def mean(c: str) -> Column:
        x = F.col(c)
        m = F.try_divide(F.sum(x * w), F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0))) * scale
        if na_propagate:
            m = F.when(F.count(x * w) == F.count("*"), m)
        return m.alias(c)

    return df.groupBy(*by).agg(*[mean(c) for c in cols])


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample standard deviation of each column, side by side."""
    return df.groupBy(*by).agg(*[
        f(c).alias(f"{c}_{name}")
        for c in cols
        for name, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ])


def describe_long(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), rounding=F.bround
) -> DataFrame:
    """``(by, ord, var, stat, value)``: values above 1 in whole numbers, others with two
    decimals; ``ord`` follows the order of ``cols``."""
    wide = describe(df, cols, by)
    stats = [c for c in wide.columns if c not in by]
    # Names may hold the separator themselves, so the statistic is split off the end.
    keyed = wide.withColumnsRenamed({
        c: f"{i // 2:04d}|{c.rpartition('_')[0]}|{c.rpartition('_')[2]}"
        for i, c in enumerate(stats)
    })
    cols_long = [c for c in keyed.columns if c not in by]
    long = split_col(to_long(keyed, by, cols_long), "key", ["ord", "var", "stat"], "|")
    return long.select(
        *by, F.col("ord").cast("int").alias("ord"), "var", "stat",
        round_large("value", rounding=rounding).alias("value"),
    )


def propmiss(df: DataFrame) -> DataFrame:
    """Missing values of every column, from one pass: ``variable, nmiss, n, propmiss``."""
    counts = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)],
    )
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"_m{i}").alias("nmiss"))
        for i, c in enumerate(df.columns)
    ]))
    return (
        counts.select("_n", rows.alias("r"))
        .select(
            "r.variable", "r.nmiss", F.col("_n").alias("n"),
            F.try_divide(F.col("r.nmiss"), F.col("_n")).alias("propmiss"),
        )
        .orderBy("propmiss", "variable")
    )


def share_positive(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shares above and below zero of each column."""
    return df.groupBy(*by).agg(*[
        F.avg(cond.cast("int")).alias(f"{c}_{name}")
        for c in cols
        for name, cond in (("gt0", F.col(c) > 0), ("lt0", F.col(c) < 0))
    ])


def threshold_share(
    df: DataFrame, col: str, thresholds: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Share of rows at or above each named threshold."""
    return df.groupBy(*by).agg(*[
        F.avg((F.col(col) >= t).cast("int")).alias(name) for name, t in thresholds.items()
    ])


def ratio_range(df: DataFrame, num: str, den: str, grid: Sequence[float]) -> DataFrame:
    """``x`` scaled by a factor that runs evenly from ``min(num)/min(den)`` to
    ``max(num)/max(den)`` along the grid: ``(i, x, y)``."""
    steps = max(len(grid) - 1, 1)
    ends = df.agg(
        (F.min(num) / F.min(den)).alias("lo"), (F.max(num) / F.max(den)).alias("hi")
    )
    points = F.posexplode(F.array(*[F.lit(float(g)) for g in grid])).alias("i", "x")
    factor = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.lit(float(steps))
    return ends.select("lo", "hi", points).select("i", "x", (F.col("x") * factor).alias("y"))


def histogram(
    df: DataFrame, col: str, bins: int = 30, lo: float = 1.0, hi: float = 11.0
) -> DataFrame:
    """Equal-width density histogram of the values within ``[lo, hi]``, empty bins
    included: ``(bin, left, right, n, density)``. One pass, one small row a task."""
    width = (hi - lo) / bins
    v = F.col(col)
    slot = F.least(F.floor((v - lo) / F.lit(width)), F.lit(bins - 1))
    counted = df.where(v.between(lo, hi)).select(slot.cast("int").alias("_b")).agg(
        F.array(*[F.count_if(F.col("_b") == i) for i in range(bins)]).alias("counts")
    )
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    return counted.select(
        total.alias("_total"), F.posexplode("counts").alias("bin", "n")
    ).select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("left"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("right"),
        "n",
        F.try_divide(F.col("n"), F.col("_total") * width).alias("density"),
    )


def kde(
    df: DataFrame, col: str, grid: Sequence[float], bandwidth: float | None = None
) -> DataFrame:
    """Gaussian kernel density of a sample on a grid: ``(x, density)``.

    The default bandwidth is ``0.9 * min(sd, IQR/1.34) * n**-0.2``; without a spread in the
    middle half the deviation alone counts, then the size of the value. Equal values are
    counted first, so a value that many rows share is evaluated once. The grid is a short
    array constant; its terms are summed in the task that holds the value, so only one row
    for each grid point leaves a task.
    """
    sample = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    if bandwidth is None:
        spread = quantiles(sample, "v", [0.25, 0.75], names=["q1", "q3"])
        scale = attach_row(
            sample.agg(F.stddev_samp("v").alias("sd"), F.count("*").alias("n")),
            spread, ["q1", "q3"],
        )
        middle = (F.col("q3") - F.col("q1")) / 1.34
        width = (
            F.when(middle > 0, F.least("sd", middle))
            .when(F.col("sd") > 0, F.col("sd"))
            .when(F.col("q1") != 0, F.abs("q1"))
            .otherwise(1.0)
        )
        h = scale.select((0.9 * width * F.pow(F.col("n"), F.lit(-0.2))).alias("h"))
    values = sample.groupBy("v").agg(F.count("*").alias("c"))
    if bandwidth is None:
        values = attach_row(values, h, ["h"])
    else:
        values = values.withColumn("h", F.lit(float(bandwidth)))
    u = (F.col("v") - F.col("x")) / F.col("h")
    points = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x")
    return (
        values.select("v", "c", "h", points)
        .groupBy("x")
        .agg((F.sum(F.col("c") * F.exp(-0.5 * u * u) / (F.col("h") * (2 * math.pi) ** 0.5))
              / F.sum("c")).alias("density"))
    )


_INFINITY = 2047 << 52
#: Bits below the digits of the first and of the second step.
_SHIFTS = (42, 21, 0)


def order_key(v: Column) -> Column:
    """Whole number of a double, in the same order and one to one (zeros are one): exponent and
    fraction, as powers of two and products with them are exact. NaN comes last."""
    a = F.abs(v)
    two = F.lit(2.0)
    e = F.floor(F.log2(F.when((a > 0) & (a < float("inf")), a)))
    e = e - F.when(a < F.pow(two, e), 1).otherwise(0)
    e = e + F.when(a >= F.pow(two, e + 1), 1).otherwise(0)
    e = F.greatest(e, F.lit(-1022))
    size = (e + 1022) * F.lit(2**52) + (a / F.pow(two, e) * float(2**52)).cast("long")
    size = F.when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(_INFINITY)).otherwise(size)
    return F.when(F.isnan(v), F.lit(_INFINITY + 1)).when(v < 0, -size).otherwise(size).cast("long")


def key_value(k: Column) -> Column:
    """The double of an ``order_key``."""
    a = F.abs(k)
    e = F.shiftright(a, 52)
    fraction = a.bitwiseAND(F.lit(2**52 - 1)) + F.when(e > 0, F.lit(2**52)).otherwise(F.lit(0))
    size = fraction.cast("double") * F.pow(F.lit(2.0), F.greatest(e, F.lit(1)).cast("double") - 1075.0)
    return F.when(a > _INFINITY, F.lit(float("nan"))).when(k < 0, -size).otherwise(size)


def quantiles(
    df: DataFrame,
    col: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    means: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation (type 7), NULL values skipped.

    ``means`` adds averages of expressions of the same column. Values are looked at as whole
    numbers of 64 bits in the same order. A first pass counts rows by group and leading digits; a
    second reads only rows whose digits hold a wanted rank, and counts them by value. Two more
    steps on those counts narrow the digits until one value is left for each rank. All groups of
    any size go this way: a task orders at most the 2**22 digits of a step, never the rows of a
    group.
    """
    by, names = list(by), list(names or [f"q{p:g}" for p in probs])
    means = means or {}
    value = F.col(col).cast("double")
    rows = df.where(F.col(col).isNotNull()).select(*by, value.alias("_v"), order_key(value).alias("_k"))
    first = rows.groupBy(*by, F.shiftright("_k", _SHIFTS[0]).alias("_d")).agg(
        F.count("*").alias("_c"),
        *[F.sum(f(F.col("_v")).cast("double")).alias(f"_s{i}") for i, f in enumerate(means.values())])
    first = materialise(first.withColumn("_p", F.lit(0).cast("long")))
    totals = first.groupBy(*by).agg(
        F.sum("_c").alias("_n"),
        *[(F.sum(f"_s{i}") / F.sum("_c")).alias(n) for i, n in enumerate(means)])
    at = (F.col("_n") - 1) * F.col("_prob")
    wanted = totals.select(*by, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_prob"))
    wanted = wanted.select(
        *by, "_i", (at - F.floor(at)).alias("_part"), F.lit(0).cast("long").alias("_p"),
        F.explode(F.array(F.floor(at), F.ceil(at))).alias("_rank")).distinct()

    def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
        return keyed_join(left, right, [*by, *keys], how, null_safe=True)

    def narrowed(counts: DataFrame, wanted: DataFrame) -> DataFrame:
        """The digit of each wanted rank among ``counts(by, _p, _d, _c)``, and its rank there."""
        upto = F.sum("_c").over(Window.partitionBy(*by, "_p").orderBy("_d"))
        placed = counts.select(*by, "_p", "_d", "_c").withColumn("_upto", upto)
        before = F.col("_upto") - F.col("_c")
        return same(wanted, placed, ["_p"]).where((F.col("_rank") >= before) & (F.col("_rank") < F.col("_upto"))).select(
            *by, "_i", "_part", F.col("_d").alias("_p"), (F.col("_rank") - before).alias("_rank"))

    wanted = materialise(narrowed(first, wanted))
    held = same(
        rows.withColumn("_p", F.shiftright("_k", _SHIFTS[0])), wanted.select(*by, "_p").distinct(), ["_p"], "left_semi")
    values = materialise(held.groupBy(*by, "_k").agg(F.count("*").alias("_c")))
    for above, shift in zip(_SHIFTS, _SHIFTS[1:]):
        counts = values.groupBy(
            *by, F.shiftright("_k", above).alias("_p"), F.shiftright("_k", shift).alias("_d")).agg(F.sum("_c").alias("_c"))
        # Digits of a step are few next to those that the last step left out.
        counts = same(counts, wanted.select(*by, "_p").distinct(), ["_p"], "left_semi")
        wanted = narrowed(counts, wanted)
    found = wanted.withColumn("_x", key_value(F.col("_p")))
    ends = found.groupBy(*by).agg(*[e for i, own in enumerate(F.col("_i") == i for i in range(len(names))) for e in (
        F.min(F.when(own, F.col("_x"))).alias(f"_lo{i}"), F.max(F.when(own, F.col("_x"))).alias(f"_hi{i}"),
        F.max(F.when(own, F.col("_part"))).alias(f"_f{i}"))])

    def between(i: int) -> Column:
        lo, hi, part = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)

    picked = ends.select(*by, *[between(i).alias(n) for i, n in enumerate(names)])
    if not means:
        return picked
    totals = totals.drop("_n")
    return same(picked, totals, []) if by else attach_row(picked, totals, list(means))


def counts_by(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def descriptive_table(
    df: DataFrame, cols: Sequence[str], year: str = "year", rounding=F.bround
) -> DataFrame:
    """Mean and SD rows in column order, followed by one row count a year."""
    stats = describe_long(df, cols, rounding=rounding)
    n = counts_by(df, [year], "value").select(
        F.lit(len(cols)).alias("ord"),
        F.concat(F.lit("N "), F.col(year).cast("string")).alias("var"),
        F.lit("n").alias("stat"),
        F.col("value").cast("double").alias("value"),
    )
    return stack_rows(stats, n)


def measures_by_year(
    df: DataFrame, cols: Sequence[str], years: Sequence[int] | None = None, year: str = "year", digits: int = 2,
    rounding=F.bround,
) -> DataFrame:
    """``(ord, var, stat)`` rows with one column a year: every year, or those given if they
    are all."""
    wide = describe(df, cols, [year])
    stats = [c for c in wide.columns if c != year]
    keyed = wide.withColumnsRenamed({
        c: f"{i // 2:04d}|{c.rpartition('_')[0]}|{c.rpartition('_')[2]}"
        for i, c in enumerate(stats)
    })
    long = split_col(
        to_long(keyed, [year], [c for c in keyed.columns if c != year]),
        "key", ["ord", "var", "stat"], "|",
    )
    # Years are looked up among the means, one row a year, and not in the data again.
    wide = materialise(long.withColumn("ord", F.col("ord").cast("int")))
    return pivoted(
        wide, ["ord", "var", "stat"], year, rounding(F.first("value"), digits), pivot_keys(wide, year, years))

"""Summaries of posterior draws.

A draws table has one row per draw: identifying columns (``fit`` by default) and a vector
column. Grids are short array constants, exploded in the task that reads the draw.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinterland.functions.scalar import interval_text, number_text
from hinterland.operators.aggregates import quantiles
from hinterland.operators.frame import pivot_keys, stack_rows
from hinterland.operators.joins import attach_row


#: Columns of a draw besides its slopes, in table order: the intercept comes last.
OTHER_TERMS = ("gamma", "a_region", "sigma", "sigma_a", "phi", "alpha")


def draws_long(
    draws: DataFrame, terms: Sequence[str] | None = None, by: Sequence[str] = ("fit",),
    vector: str = "beta", also: Sequence[str] = (),
) -> DataFrame:
    """``(by, pos, term, value)``; unnamed terms are called ``vector[k]``, k from 1.

    ``also`` names more columns, whose values follow those of ``vector``: a number under its own
    name, an array as ``name[k]``. What a fit does not have (NULL) is left out.
    """
    if also:
        def listed(c: str) -> Column:
            if isinstance(draws.schema[c].dataType, T.ArrayType):
                named = F.transform(c, lambda v, i: F.struct(
                    F.format_string(f"{c}[%d]", i + 1).alias("name"), v.cast("double").alias("value")))
                return F.coalesce(named, F.array().cast("array<struct<name:string,value:double>>"))
            return F.array(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")))

        held = F.filter(F.concat(*map(listed, also)), lambda e: e["value"].isNotNull())
        slopes = F.transform(vector, lambda v: F.struct(
            F.lit(None).cast("string").alias("name"), v.cast("double").alias("value")))
        long = draws.select(*by, F.posexplode(F.concat(slopes, held)).alias("pos", "e")).select(
            *by, "pos", "e.name", "e.value")
    else:
        long = draws.select(
            *by, F.posexplode(vector).alias("pos", "value")).withColumn("name", F.lit(None).cast("string"))
    fallback = F.format_string(f"{vector}[%d]", F.col("pos") + 1)
    if terms is not None:
        fallback = F.coalesce(F.get(F.array(*[F.lit(t) for t in terms]), F.col("pos")), fallback)
    return long.select(
        *by, "pos", F.coalesce("name", fallback).alias("term"), F.col("value").cast("double"))


def posterior_terms(
    draws: DataFrame,
    terms: Sequence[str] | None = None,
    level: float = 0.95,
    digits: int | None = 3,
    by: Sequence[str] = ("fit",),
    vector: str = "beta",
    drop: str | None = None,
    rounding=F.bround,
    also: Sequence[str] = (),
) -> DataFrame:
    """Posterior mean and central interval of each term: ``(by, pos, term, estimate, lo,
    hi)``. ``drop`` is a pattern of term names to leave out before anything is computed;
    ``also`` names columns that follow the vector, such as ``OTHER_TERMS``."""
    long = draws_long(draws, terms, by, vector, also)
    if drop is not None:
        long = long.where(~F.col("term").rlike(drop))
    tail = (1.0 - level) / 2.0
    out = quantiles(
        long, "value", [tail, 1.0 - tail], [*by, "pos", "term"], ["lo", "hi"],
        means={"estimate": lambda v: v},
    )
    shown = {c: F.col(c) if digits is None else rounding(F.col(c), digits)
             for c in ("estimate", "lo", "hi")}
    return out.select(*by, "pos", "term", *[v.alias(c) for c, v in shown.items()])


def _margin_summary(
    values: DataFrame, by: Sequence[str], ci: float, shift: float
) -> DataFrame:
    tail = (1.0 - ci / 100.0) / 2.0
    out = quantiles(
        values, "effect", [tail, 0.5, 1.0 - tail], [*by, "x"], ["lo_ci", "med", "hi_ci"],
        means={"mean": lambda v: v, "gt0": lambda v: (v > 0).cast("int")},
    )
    return out.select(
        *by, (F.col("x") + shift).alias("x"), "lo_ci", "med", "mean", "hi_ci", "gt0"
    )


def _slope(vector: str, i: int, j: int, x: Column) -> Column:
    b = F.col(vector)
    return F.get(b, F.lit(i)) + 2.0 * F.get(b, F.lit(j)) * x


def _grid(points: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(g)) for g in points])


def margin_quad(
    draws: DataFrame,
    i: int,
    j: int,
    grid: Sequence[float],
    ci: float = 95,
    by: Sequence[str] = ("fit",),
    vector: str = "beta",
    shift: float = 1.0,
) -> DataFrame:
    """Marginal effect ``b_i + 2 b_j x`` of a term with a square, over a grid of x.

    ``i`` and ``j`` count from 0. Returns ``(by, x, lo_ci, med, mean, hi_ci, gt0)`` with
    ``shift`` added to x.
    """
    values = draws.select(*by, vector, F.explode(_grid(grid)).alias("x")).select(
        *by, "x", _slope(vector, i, j, F.col("x")).cast("double").alias("effect")
    )
    return _margin_summary(values, by, ci, shift)


def margin_mult(
    draws: DataFrame,
    first: tuple[int, int],
    second: tuple[int, int],
    paired_grid: DataFrame,
    ci: float = 95,
    by: Sequence[str] = ("fit",),
    vector: str = "beta",
    shift: float = 1.0,
) -> DataFrame:
    """Joint effect of two terms with squares along paired points ``(i, x, y)``, such as
    ``ratio_range`` gives. The short grid travels as one array value."""
    packed = paired_grid.agg(
        F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_grid")
    )
    rows = attach_row(draws.select(*by, vector), packed, ["_grid"])
    values = rows.select(*by, vector, F.explode("_grid").alias("g")).select(
        *by, F.col("g.x").alias("x"),
        (_slope(vector, *first, F.col("g.x")) + _slope(vector, *second, F.col("g.y")))
        .cast("double").alias("effect"),
    )
    return _margin_summary(values, by, ci, shift)


class Margin(NamedTuple):
    """One margin table: which fit, what to call it, and where its two terms are."""

    fit: str
    type: str
    i: int
    j: int


def margin_tables(
    draws: DataFrame,
    margins: Sequence[Margin],
    grid: Sequence[float],
    ci: float = 95,
    vector: str = "beta",
    shift: float = 1.0,
) -> DataFrame:
    """Many margin tables in one job, keyed by ``(fit, type)``."""
    b = F.col(vector)
    wanted = F.filter(
        F.array(*[
            F.struct(
                F.lit(m.fit).alias("fit"), F.lit(m.type).alias("type"),
                F.get(b, F.lit(m.i)).cast("double").alias("b1"),
                F.get(b, F.lit(m.j)).cast("double").alias("b2"),
            )
            for m in margins
        ]),
        lambda m: m["fit"] == F.col("_fit"),
    )
    picked = (
        draws.where(F.col("fit").isin(sorted({m.fit for m in margins})))
        .select(F.col("fit").alias("_fit"), vector)
        .select(F.explode(wanted).alias("m"))
        .select("m.*", F.explode(_grid(grid)).alias("x"))
    )
    values = picked.select("fit", "type", "x", (F.col("b1") + 2.0 * F.col("b2") * F.col("x"))
                           .alias("effect"))
    return _margin_summary(values, ["fit", "type"], ci, shift)


def regression_table(
    summary: DataFrame,
    fits: Sequence[str],
    order: Sequence[str],
    counts: DataFrame | None = None,
    digits: int = 3,
) -> DataFrame:
    """Estimate and interval rows by term, one text column a fit.

    ``summary`` comes from ``posterior_terms`` with unrounded or rounded numbers; ``order``
    lists the terms to show, the intercept last. ``counts`` is a one-row table whose
    columns (unique units, rows) become closing rows with the same text for every fit.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("term"))
    cells = (
        summary.where(F.col("term").isin(list(order)))
        .select(
            "fit", (place - 1).cast("int").alias("ord"), "term",
            F.explode(F.array(
                F.struct(F.lit("estimate").alias("stat"),
                         number_text("estimate", digits).alias("text")),
                F.struct(F.lit("interval").alias("stat"),
                         interval_text("lo", "hi", digits).alias("text")),
            )).alias("c"),
        )
        .select("fit", "ord", "term", "c.*")
    )
    named = summary.select(F.col("fit").cast("string").alias("fit"))
    cells = cells.withColumn("fit", F.col("fit").cast("string"))
    body = cells.groupBy("ord", "term", "stat").pivot("fit", pivot_keys(named, "fit", fits)).agg(F.first("text"))
    if counts is None:
        return body
    closing = counts.select(F.explode(F.array(*[
        F.struct(
            F.lit(len(order) + k).alias("ord"), F.lit(c).alias("term"),
            F.lit("n").alias("stat"), F.col(c).cast("string").alias("text"),
        )
        for k, c in enumerate(counts.columns)
    ])).alias("r")).select("r.ord", "r.term", "r.stat", *[F.col("r.text").alias(f) for f in fits])
    return stack_rows(body, closing)


def fit_labels(draws: DataFrame, labels: Mapping[object, str], col: str = "fit") -> DataFrame:
    """Rename fits; unlisted ones keep their name."""
    out = F.col(col).cast("string")
    for old, new in labels.items():
        out = F.when(F.col(col) == F.lit(old), F.lit(new)).otherwise(out)
    return draws.withColumn(col, out)

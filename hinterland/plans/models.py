"""The grid of fits and the tables made from their draws."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hinterland.operators.beta_models import (
    fit_beta_batch, fit_varying_beta_batch, open_interval,
)
from hinterland.operators.design import design_matrix, moments, square_terms, thin_qr
from hinterland.operators.frame import one_hot
from hinterland.operators.normal_models import (
    GroupLevel, fit_normal, fit_varying_normal, group_level, group_stats,
)
from hinterland.operators.posterior import Margin, margin_mult, margin_tables
from hinterland.operators.aggregates import ratio_range
from hinterland.operators.windows import first_per_key
from hinterland.sources.checkpoint import stored

# Names, order and codes of the model variables.
MEASURES = {m: f"pdw2_{m}" for m in ("download", "upload", "pcount")}
RUCC = list(range(2, 10))
SHARED = [
    "lefdetot", "nwhitenrlp", "womenenrlp", "upgrntpp", "pttotp", "age25op", "lpopdens",
    "year13", "year14", *[f"rucc_{k}" for k in RUCC],
]
FIRST_LEVEL = {
    "full": ["twoyr", "room", *SHARED],
    "sens": ["twoyr", "room", "privnp", "privfp", "openadmp", *SHARED],
}
SECOND_LEVEL = ["stunemrate", "appropfte_t", "twoyr_p", "pwm_dist_oa"]
LEFT_OUT_UNIT = 150987
SEED = 100605
CHAINS, DRAWS = 4, 1000
GRID = [i / 10 for i in range(101)]


class FitSpec(NamedTuple):
    model: str  # sl or vi
    family: str  # normal or beta
    sample: str  # full or sens
    measure: str  # download, upload, pcount or all

    @property
    def name(self) -> str:
        return f"{self.model}_{self.family}_{self.sample}_{self.measure}"

    @property
    def measures(self) -> list[str]:
        return list(MEASURES) if self.measure == "all" else [self.measure]


ALL_FITS = [
    FitSpec(model, family, sample, measure)
    for model in ("sl", "vi") for family in ("normal", "beta")
    for sample in ("full", "sens") for measure in (*MEASURES, "all")
]


def model_rows(panel: DataFrame) -> DataFrame:
    """Rows used in models, with rurality indicators and the proportion outcome."""
    kept = panel.where(F.col("unitid") != LEFT_OUT_UNIT)
    return one_hot(kept, "rucc", RUCC).withColumn(
        "efdesomp", F.try_divide("efdesom", "efdetot")
    )


def second_level(
    rows: DataFrame, average: bool = False, covariates: Sequence[str] = SECOND_LEVEL
) -> GroupLevel:
    """State covariates: those of a state's first row in (unit, year) order, or their mean
    over its rows."""
    columns = ["stfips", *covariates, "region"]
    if average:
        states = rows.groupBy("stfips").agg(
            *[F.avg(c).alias(c) for c in covariates], F.min("region").alias("region")
        )
    else:
        states = first_per_key(rows.select(*columns, "unitid", "year"), ["stfips"],
                               ["unitid", "year"]).select(*columns)
    return group_level(states, "stfips", covariates, "region")


def fit_grid(
    samples: Mapping[str, DataFrame],
    specs: Sequence[FitSpec],
    outcomes: Mapping[str, str],
    covariates: Mapping[str, Sequence[str]] = FIRST_LEVEL,
    group: str = "stfips",
    second: Mapping[str, GroupLevel] | None = None,
    draws: int = DRAWS,
    chains: int = CHAINS,
    seed: int = SEED,
    at_once: int = 8,
) -> DataFrame:
    """Draws of every requested fit, keyed by ``fit``, ``chain`` and ``draw``.

    For each sample and family the widest design is built and stored once. Normal fits
    need one pass over it (and one group pass): the four measure sets are parts of the wide
    triangle and the wide sums. Beta fits of one model take all their steps in the same passes
    over packed rows, so passes do not grow with the number of fits. ``at_once`` batches send
    their jobs to Spark at the same time, which fills the gaps between small jobs.
    """
    second = second or {}
    options = {"draws": draws, "chains": chains, "seed": seed}
    Job = Callable[[], list[DataFrame]]

    def prepared(sample: str, family: str) -> list[Job]:
        wanted = [s for s in specs if (s.sample, s.family) == (sample, family)]
        used = [m for m in MEASURES if any(m in s.measures for s in wanted)]
        design, names = design_matrix(
            samples[sample], outcomes[family], [MEASURES[m] for m in used], covariates[sample],
            group,
        )
        design = stored(design if family == "normal" else open_interval(design))
        own = {s.name: [*square_terms([MEASURES[m] for m in s.measures]), *covariates[sample]] for s in wanted}
        at = {f: [names.index(n) for n in cols] for f, cols in own.items()}
        single = {s.name: at[s.name] for s in wanted if s.model == "sl"}
        varying = {s.name: at[s.name] for s in wanted if s.model == "vi"}
        level = second.get(sample)
        if family == "normal":
            return _normal_jobs(design, names, list(single), list(varying), own, at, group, level, options)
        jobs: list[Job] = []
        if single:
            jobs.append(lambda: [f.draws for f in fit_beta_batch(design, names, single, **options).values()])
        if varying:
            jobs.append(lambda: [f.draws for f in fit_varying_beta_batch(
                design, names, varying, group, level, **options).values()])
        return jobs

    spark = next(iter(samples.values())).sparkSession
    prepare = inheritable_thread_target(spark)(prepared)
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPoolExecutor(at_once) as pool:
        kinds = list(dict.fromkeys((s.sample, s.family) for s in specs))
        work = [job for jobs in pool.map(lambda kind: prepare(*kind), kinds) for job in jobs]
        parts = [draws for found in pool.map(run, work) for draws in found]
    # Stored once made: summaries read draws several times.
    return stored(reduce(DataFrame.unionByName, parts))


def _normal_jobs(
    design: DataFrame, names: list[str], single: list[str], varying: list[str], own: Mapping[str, list[str]],
    at: Mapping[str, list[int]], group: str, level: GroupLevel | None, options: Mapping[str, int],
) -> list[Callable[[], list[DataFrame]]]:
    """Normal fits of one sample, from one wide triangle and one wide table of group sums."""
    jobs = []
    if single:
        wide = thin_qr(design, len(names))
        jobs.append(lambda: [
            fit_normal(design, own[f], fit=f, known=wide.subset(at[f]), **options).draws for f in single])
    if varying:
        # Varying fits take only rows whose group has a second level, in all their sums.
        usable = level.restrict(design, group)
        sums, stats = moments(usable, len(names)), stored(group_stats(usable, group, len(names)))
        jobs += [lambda f=f: [fit_varying_normal(
            design, own[f], group, level, fit=f, known=sums.subset(at[f]), stats=stats, columns=at[f], **options
        ).draws] for f in varying]
    return jobs


def margins(draws: DataFrame, ci: float = 95) -> DataFrame:
    """Margins of the normal fits of the full sample: each measure alone, then each
    measure of the joint fits, keyed by ``(fit, type)``."""
    short = {"download": "dl", "upload": "ul", "pcount": "pc"}
    solo = [Margin(f"sl_normal_full_{m}", t, 0, 1) for m, t in short.items()]
    joint = [
        Margin(f"{model}_normal_full_all", t, 2 * k, 2 * k + 1)
        for model in ("sl", "vi") for k, t in enumerate(short.values())
    ]
    return margin_tables(draws, [*solo, *joint], GRID, ci)


def combined_margins(draws: DataFrame, rows: DataFrame, ci: float = 95) -> DataFrame:
    """Joint download and upload margin of both joint normal fits, uploads following
    downloads along their observed ratio."""
    joint = draws.where(F.col("fit").isin("sl_normal_full_all", "vi_normal_full_all"))
    pairs = ratio_range(rows, MEASURES["upload"], MEASURES["download"], GRID)
    return margin_mult(joint, (0, 1), (2, 3), pairs, ci)

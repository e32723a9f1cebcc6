"""Analysis panel: institutions with measures and area covariates, ready for models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.functions.scalar import area_code, flag, lenient, paste, zero_pad
from hinterland.operators.frame import cols_between, derive, lower_names, select_as, to_long
from hinterland.operators.joins import keyed_join, lookup, natural_left_join
from hinterland.operators.windows import group_mean, with_dense_index
from hinterland.plans.measures import nearest_mean_distance
from hinterland.sources.delimited import write_extracts

# Fixed values.
FINANCE_COLUMNS = ["year", "stname", "fte", "appropfte", "nettuitfte", "stuappropshare"]
YEARS = [2012, 2013, 2014]
LABOUR_COLUMNS = {
    "totpop": "hc01_est_vc01", "lforcepct": "hc02_est_vc01", "emppct": "hc03_est_vc01",
    "unemrate": "hc04_est_vc01", "totwhite": "hc01_est_vc22", "bahigh": "hc01_est_vc41",
}
COMPLETE = ["efdesom", "efteug", "efdeexc", "efdenon", "openadmp", "public", "age25o", "upgrntn"]
RENUMBERED_COUNTY = ("46102", "46113")


def located_institutions(
    panel: DataFrame, measures: DataFrame, crosswalk: DataFrame
) -> DataFrame:
    """Panel with weighted measures and state names; unknown areas and DC are dropped."""
    states = crosswalk.withColumnRenamed("st", "stabbr")
    joined = keyed_join(panel, measures, ["unitid", "year"])
    return (
        lookup(joined, states, "stabbr")
        .where((F.col("fips") > 0) & F.col("stname").isNotNull() & (F.col("stabbr") != "DC"))
        .withColumn("fips", zero_pad("fips", 5))
    )


def finance(sheet: DataFrame, crosswalk: DataFrame, years: Sequence[int] = YEARS) -> DataFrame:
    """State finance by year; the exported sheet's header is replaced by our names."""
    kept = sheet.toDF(*FINANCE_COLUMNS).where(
        (F.col("stname") != "US") & F.col("year").isin(list(years))
    )
    return lookup(
        kept.withColumn("fte", F.bround("fte", 0).cast("int")),
        crosswalk.select("stfips", "stname"), "stname",
    )


def _labour(table: DataFrame, key: str, prefix: str) -> DataFrame:
    # The key's name holds a dot; it is renamed before any column is resolved by name.
    named = table.toDF(*[c.lower().replace(".", "_") for c in table.columns])

    def n(c: str) -> Column:
        return F.col(f"{prefix}{c}")

    numbers = select_as(named, {
        key: F.col("geo_id2"),
        **{f"{prefix}{new}": lenient(old) for new, old in LABOUR_COLUMNS.items()},
    })
    return derive(numbers, **{
        f"{prefix}totnonwhite": n("totpop") - n("totwhite"),
        f"{prefix}labforce": F.bround(n("totpop") * n("lforcepct") / 100, 0),
        f"{prefix}totunem": F.bround(n("labforce") * n("unemrate") / 100, 0),
    })


def labour(state: DataFrame, county: DataFrame) -> DataFrame:
    """County labour statistics next to those of their state."""
    counties = _labour(county, "fips", "ct").withColumn("stfips", area_code("fips", "state"))
    return keyed_join(_labour(state, "stfips", "st"), counties, ["stfips"]).where(
        F.col("fips").isNotNull()
    )


def _population(rows: DataFrame, ids: Sequence[str], name: str) -> DataFrame:
    cols = cols_between(rows, f"popestimate{YEARS[0]}", f"popestimate{YEARS[-1]}")
    return to_long(rows, ids, cols, "year", name, r"(\d{4})$", "int")


def state_population(population: DataFrame) -> DataFrame:
    rows = lower_names(population).where(F.col("sumlev") == "040")
    return _population(rows.withColumnRenamed("state", "stfips"), ["stfips"], "statepop")


def county_population(
    population: DataFrame, land: DataFrame, rurality: DataFrame
) -> DataFrame:
    """County population, density and rurality by year."""
    rows = lower_names(population).where(F.col("sumlev") == "050")
    rows = rows.withColumnRenamed("state", "stfips")
    old, new = RENUMBERED_COUNTY
    code = paste("stfips", "county")
    coded = _population(rows, ["stfips", "county", "ctyname"], "countypop").withColumn(
        "fips", F.when(code == old, new).otherwise(code)
    )
    areas = select_as(lower_names(land), {"fips": "stcou", "landarea": "lnd110210d"})
    codes = select_as(lower_names(rurality), {"fips": "fips", "rucc": "rucc_2013"})
    joined = lookup(lookup(coded, areas, "fips"), codes, "fips")
    return joined.withColumn("popdens", F.try_divide("countypop", "landarea"))


def analysis_panel(
    institutions: DataFrame,
    county: DataFrame,
    state: DataFrame,
    labour_stats: DataFrame,
    finances: DataFrame,
    distances: DataFrame,
    null_safe: bool = False,
) -> DataFrame:
    """All covariates on the institution panel, complete rows, derived variables.

    The state index counts the states that are left after every filter.
    """
    joined = natural_left_join(
        institutions, county, state, labour_stats, finances, distances, null_safe=null_safe
    )
    kept = joined.dropna(subset=COMPLETE).where(
        ~F.col("stabbr").isin("AK", "HI")
        & (F.col("efdesom") > 0) & (F.col("efdesom") != F.col("efdetot"))
    ).withColumn("appropfte_t", F.col("appropfte") / 1000)
    indexed = with_dense_index(kept, "stfips", "ststan")
    shares = group_mean(kept, ["stfips"], ["twoyr", "public"], digits=2)
    return lookup(indexed, shares, "stfips").withColumns(_derived())


def _derived() -> dict[str, Column]:
    total = F.col("efdetot")
    return {
        "lpopdens": F.log("popdens"),
        "lefdesom": F.log1p("efdesom"),
        "lefdetot": F.log1p("efdetot"),
        "nwhitenrlp": F.try_divide(total - F.col("efwhitt"), total),
        "womenenrlp": F.try_divide(total - F.col("eftotlw"), total),
        "upgrntpp": F.col("upgrntp") / 100,
        "pttotp": F.try_divide("pttot", total),
        "age25op": F.try_divide("age25o", total),
        "year13": flag(F.col("year") == 2013),
        "year14": flag(F.col("year") == 2014),
    }


def store_analysis(panel: DataFrame, base: str) -> dict[str, str]:
    """Write the panel and its two subsets; returns their paths."""
    public = F.col("public") == 1
    return write_extracts(
        panel, base,
        {"analysis_oap": public & (F.col("openadmp") == 1), "analysis_public": public},
        whole="analysis_all",
    )

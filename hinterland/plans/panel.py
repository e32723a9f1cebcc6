"""Institution-year panel from yearly survey files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.functions.scalar import flag, lenient, recode_sentinel
from hinterland.operators.frame import lower_names, select_as
from hinterland.operators.joins import left_chain, members


@dataclass(frozen=True)
class SurveyPart:
    """What one survey table adds to the panel: which rows, which columns, new names."""

    table: str
    columns: Mapping[str, str]
    where: Mapping[str, int] = field(default_factory=dict)

    def take(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        rows = lower_names(tables[self.table])
        for column, value in self.where.items():
            rows = rows.where(F.col(column) == value)
        return select_as(rows, {"unitid": "unitid", "year": "year", **self.columns})


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# Survey tables, their row codes and the columns taken.
SPINE = SurveyPart("header", {
    "stabbr": "stabbr", "fips": "countycd", "sector": "sector", "lon": "longitud",
    "lat": "latitude",
})
PARTS = [
    SurveyPart("characteristics", _same("openadmp", "room")),
    SurveyPart("full_time_equivalent", _same("efteug")),
    SurveyPart("enrolment_a", _same("eftotlt", "eftotlw", "efwhitt"), {"efalevel": 2}),
    SurveyPart("enrolment_b", {"pttot": "efage06"}, {"efbage": 1, "lstudy": 2}),
    SurveyPart("enrolment_b", {"age25o": "efage09"}, {"efbage": 7, "lstudy": 2}),
    SurveyPart("aid", _same("upgrntn", "upgrntp")),
    SurveyPart("distance", _same("efdetot", "efdesom", "efdeexc", "efdenon"), {"efdelev": 2}),
]
NOT_SCHOOLS = [0, 99]
PANEL_COLUMNS = [
    "unitid", "year", "stabbr", "fips", "lon", "lat", "openadmp", "room", "efteug", "eftotlt",
    "eftotlw", "efwhitt", "pttot", "age25o", "upgrntn", "upgrntp", "efdetot", "efdesom",
    "efdeexc", "efdenon", "twoyr", "fouryr", "public", "privnp", "privfp",
]


def sector_flags(sector: str) -> dict[str, Column]:
    """Level and control indicators of a sector code 1 to 9."""
    s = F.col(sector)
    return {
        "twoyr": flag((s > 3) & (s < 7)),
        "fouryr": flag(s < 4),
        "public": flag(s.isin(1, 4, 7)),
        "privnp": flag(s.isin(2, 5, 8)),
        "privfp": flag(s.isin(3, 6, 9)),
    }


def institution_panel(
    tables: Mapping[str, DataFrame], states: DataFrame, null_safe: bool = False
) -> DataFrame:
    """Join all survey parts on ``(unitid, year)``.

    Every table holds all years with a ``year`` column, so there is no loop over years.
    ``states`` has the abbreviations to keep in ``st``. Rows are unique by unit and year.
    """
    joined = left_chain(
        SPINE.take(tables), [p.take(tables) for p in PARTS], ["unitid", "year"], null_safe
    )
    schools = joined.where(~F.col("sector").isin(NOT_SCHOOLS)).withColumns({
        **sector_flags("sector"),
        "openadmp": recode_sentinel("openadmp", {2: 0}),
        "room": recode_sentinel("room", {2: 0}),
        "pttot": lenient("pttot"),
        "age25o": lenient("age25o"),
    })
    return members(schools.select(*PANEL_COLUMNS), states, "stabbr", "st")

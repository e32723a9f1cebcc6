"""Column expressions: every helper takes and returns Spark columns."""

from hinterland.functions.geo import (
    EARTH_RADIUS_M,
    distance_weight,
    great_circle,
    unit_vector,
)
from hinterland.functions.scalar import (
    academic_year_code,
    area_code,
    flag,
    interval_text,
    inv_logit,
    lenient,
    month_number,
    number_text,
    paste,
    parenthesise,
    recode_sentinel,
    round_even,
    round_large,
    zero_pad,
)

__all__ = [
    "EARTH_RADIUS_M",
    "academic_year_code",
    "area_code",
    "distance_weight",
    "flag",
    "great_circle",
    "interval_text",
    "inv_logit",
    "lenient",
    "month_number",
    "number_text",
    "paste",
    "parenthesise",
    "recode_sentinel",
    "round_even",
    "round_large",
    "unit_vector",
    "zero_pad",
]

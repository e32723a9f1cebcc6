"""Scalar expressions. All stay inside whole-stage codegen; none is a UDF."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a 15-character area code that name each level.
AREA_CODE_LENGTH = {"state": 2, "county": 5, "block_group": 12, "block": 15}

# Month names as they appear in period table names.
MONTH_NUMBER = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def area_code(code: Column | str, level: str) -> Column:
    """Prefix of a hierarchical area code: block > block_group > county > state."""
    return F.substring(_col(code), 1, AREA_CODE_LENGTH[level])


def zero_pad(value: Column | str, width: int) -> Column:
    """Left-pad with zeros; longer values are kept whole (``lpad`` would cut them)."""
    text = _col(value).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def lenient(value: Column | str, to: str = "double") -> Column:
    """Cast that gives NULL for text that is no number, also under ANSI mode."""
    return _col(value).try_cast(to)


def paste(*parts: Column | str, sep: str = "", null_text: str | None = None) -> Column:
    """Join parts with ``sep``. NULL parts make the result NULL unless ``null_text``
    names the text to put in their place."""
    cols = [_col(p).cast("string") for p in parts]
    if null_text is not None:
        return F.concat_ws(sep, *[F.coalesce(c, F.lit(null_text)) for c in cols])
    pieces = [cols[0]]
    for c in cols[1:]:
        pieces += [F.lit(sep), c] if sep else [c]
    return F.concat(*pieces)


def academic_year_code(year: Column | str) -> Column:
    """School year ending in ``year``, two digits a side: 2012 gives ``1112``."""
    y = _col(year).cast("int")
    return F.concat(zero_pad(y - 2001, 2), zero_pad(y - 2000, 2))


def month_number(name: Column | str) -> Column:
    """Month number from a name such as ``June`` or ``JUN``."""
    key = F.lower(F.substring(_col(name), 1, 3))
    out = F.lit(None).cast("int")
    for short, number in MONTH_NUMBER.items():
        out = F.when(key == short, F.lit(number)).otherwise(out)
    return out


def round_even(value: Column | str, digits: int = 0) -> Column:
    """Ties go to the even neighbour."""
    return F.bround(_col(value), digits)


def round_large(
    value: Column | str,
    threshold: float = 1.0,
    digits: int = 2,
    rounding: Callable[[Column, int], Column] = F.bround,
) -> Column:
    """Whole numbers above ``threshold``, ``digits`` decimals at or below it."""
    v = _col(value)
    return F.when(v > threshold, rounding(v, 0)).otherwise(rounding(v, digits))


def flag(condition: Column) -> Column:
    """1/0 indicator; NULL where the condition is NULL."""
    return condition.cast("int")


def recode_sentinel(
    value: Column | str,
    mapping: Mapping[int, int | None],
    negative_to_null: bool = True,
) -> Column:
    """Replace listed codes, turn negative sentinels into NULL, keep the rest."""
    v = _col(value)
    out = F.when(v < 0, F.lit(None)).otherwise(v) if negative_to_null else v
    for old, new in mapping.items():
        out = F.when(v == old, F.lit(new)).otherwise(out)
    return out


def number_text(value: Column | str, digits: int = 3) -> Column:
    """Rounded number as text without trailing zeros: ``0.5``, ``-1.204``, ``3``."""
    fixed = F.format_string(f"%.{digits}f", _col(value))
    short = F.regexp_replace(fixed, r"\.?0+$", "") if digits > 0 else fixed
    return F.when(_col(value).isNotNull(), F.when(short == "-0", "0").otherwise(short))


def interval_text(lo: Column | str, hi: Column | str, digits: int = 3) -> Column:
    """``[lo,hi]``."""
    return F.concat(
        F.lit("["), number_text(lo, digits), F.lit(","), number_text(hi, digits), F.lit("]")
    )


def parenthesise(text: Column | str) -> Column:
    return F.concat(F.lit("("), _col(text).cast("string"), F.lit(")"))


def inv_logit(value: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(value)))

"""Column selection, recoding and reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.functions.scalar import flag


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included, in table order."""
    names = df.columns
    i, j = names.index(first), names.index(last)
    return names[i : j + 1] if i <= j else names[j : i + 1][::-1]


def cols_like(df: DataFrame, regex: str) -> list[str]:
    return [c for c in df.columns if re.search(regex, c)]


def apply_to_columns(
    df: DataFrame, cols: Sequence[str], fn: Callable[[Column], Column]
) -> DataFrame:
    """Replace each listed column by ``fn`` of it, in one projection."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def one_hot(
    df: DataFrame, col: str, values: Sequence[object], prefix: str | None = None
) -> DataFrame:
    """1/0 column per listed value; NULL where ``col`` is NULL."""
    stem = prefix or f"{col}_"
    return df.withColumns({f"{stem}{v}": flag(F.col(col) == F.lit(v)) for v in values})


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns one after another, so that later ones may use earlier ones. Catalyst
    collapses the chain into one projection."""
    for name, expr in columns.items():
        df = df.withColumn(name, expr)
    return df


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    cols: Sequence[str],
    key: str = "key",
    value: str = "value",
    key_regex: str | None = None,
    key_type: str = "string",
) -> DataFrame:
    """Unpivot ``cols``; ``key_regex`` keeps its first group of each column name."""
    out = df.unpivot(list(ids), list(cols), key, value)
    if key_regex is not None:
        out = out.withColumn(key, F.regexp_extract(key, key_regex, 1).cast(key_type))
    return out


def split_col(df: DataFrame, col: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    parts = F.split(F.col(col), re.escape(sep))
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(into)}).drop(col)


#: Columns that a pivot makes at most.
MOST_KEYS = 10_000


def pivot_keys(df: DataFrame, key: str, keys: Sequence[object] | None = None, most: int = MOST_KEYS) -> list[object]:
    """Keys of a pivot, one job over the distinct values: all that occur, in order and NULL last,
    or the given ones if none is missing from them. More than ``most`` keys are refused."""
    found = [r[0] for r in df.select(key).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{key} has more than {most} values, too many for columns")
    if keys is None:
        return sorted(v for v in found if v is not None) + [None] * (None in found)
    if missed := [k for k in found if k not in keys]:
        raise ValueError(f"{key} has values without a column: {missed[:10]}")
    return list(keys)


def pivoted(df: DataFrame, ids: Sequence[str], key: str, value: Column, keys: Sequence[object]) -> DataFrame:
    """One column a key; NULL keys go to a column called NULL. ``value`` is an aggregate."""
    names = [k for k in keys if k is not None]
    if None not in keys:
        return df.groupBy(*ids).pivot(key, names).agg(value)
    # A pivot matches keys by equality: those without one are summarised beside it.
    whole = df.groupBy(*ids, key).agg(value.alias("_value"))
    columns = [F.first(F.when(F.col(key) == F.lit(k), F.col("_value")), ignorenulls=True).alias(str(k)) for k in names]
    columns.append(F.first(F.when(F.col(key).isNull(), F.col("_value")), ignorenulls=True).alias("NULL"))
    return whole.groupBy(*ids).agg(*columns)


def to_wide(
    df: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence[object] | None = None
) -> DataFrame:
    """Pivot one value per (ids, key), with a column for each key that occurs, also for NULL; given
    ``keys`` set the order and must miss none."""
    return pivoted(df, ids, key, F.first(value, ignorenulls=True), pivot_keys(df, key, keys))


def stack_rows(*parts: DataFrame) -> DataFrame:
    """Append by name; columns a part lacks become NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def select_as(df: DataFrame, names: Mapping[str, str | Column]) -> DataFrame:
    """Select, rename and reorder: ``{new: old or expression}``."""
    return df.select(*[
        (F.col(v) if isinstance(v, str) else v).alias(k) for k, v in names.items()
    ])

"""Column helpers that give R/dplyr semantics on Spark 4 (ANSI mode).

Each helper is a plain Column expression, so it stays inside whole-stage
codegen.  The traps they close are listed in the README.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r_in(c, values: Iterable) -> Column:
    """``x %in% values``: a missing x is *not in* the set (never NULL)."""
    return F.coalesce(_c(c).isin(list(values)), F.lit(False))


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero denominator instead of raising."""
    return F.try_divide(_c(num), _c(den))


def nan_to_null(c) -> Column:
    """NaN -> NULL for doubles, so that ``coalesce`` sees it as missing."""
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


def fill_na(c, value) -> Column:
    """``coalesce(x, v)`` that also treats NaN as missing (R's NA/NaN)."""
    return F.coalesce(nan_to_null(c), F.lit(value))


def r_mean(c, na_rm: bool = False) -> Column:
    """Aggregate mean.  Without ``na_rm`` any missing value makes it NULL."""
    x = nan_to_null(c)
    if na_rm:
        return F.avg(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.avg(x))


def r_sd(c, na_rm: bool = False) -> Column:
    """Aggregate sample sd; without ``na_rm`` any missing value gives NULL."""
    x = nan_to_null(c)
    if na_rm:
        return F.stddev_samp(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.stddev_samp(x))


def present(c) -> Column:
    """``!is.na(x)`` as 0/1 double."""
    return _c(c).isNotNull().cast("double")


# -- whole-frame helpers (schema work only; no data moves) ------------------

def snake_name(name: str) -> str:
    """One column name in snake_case with accents folded (janitor style)."""
    s = unicodedata.normalize("NFKD", name)
    s = "".join(ch for ch in s if not unicodedata.combining(ch))
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; duplicates get ``_2``, ``_3``..."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        base = snake_name(c)
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return df.toDF(*out)


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Positional range ``first:last`` resolved against ``df.columns``."""
    cols = df.columns
    i, j = cols.index(first), cols.index(last)
    if i > j:
        i, j = j, i
    return cols[i:j + 1]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)]


def cast_all(df: DataFrame, cols: Iterable[str] | None = None,
             to: str = "double") -> DataFrame:
    """Bulk cast (``mutate_all/at(as.numeric)``) with bad values -> NULL."""
    cols = list(cols) if cols is not None else df.columns
    return df.withColumns({c: F.col(c).try_cast(to) for c in cols})


def logical_to_double(df: DataFrame) -> DataFrame:
    """``mutate_if(is.logical, as.numeric)``."""
    bools = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("double") for c in bools})


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    """``mutate_if(is.numeric, round, digits)`` on the fractional columns.

    Values are first canonicalised to ``digits + 4`` places (at most 9) so
    that float noise from summation order cannot flip a half-way case."""
    frac = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType,
                                       T.DecimalType))]
    canon = min(9, digits + 4)
    return df.withColumns({c: F.round(F.round(F.col(c), canon), digits) for c in frac})


def cap(c, hi) -> Column:
    """``ifelse(x > hi, hi, x)`` (NULL stays NULL)."""
    x = _c(c)
    return F.when(x > hi, F.lit(hi)).otherwise(x)


def value_map(c, mapping: dict, default=None) -> Column:
    """``case_when(x == k1 ~ v1, ...,  TRUE ~ x)``: recode listed values,
    keep the rest (or use ``default``)."""
    x = _c(c)
    out = None
    for k, v in mapping.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    rest = x if default is None else F.lit(default)
    return rest if out is None else out.otherwise(rest)


def with_na_level(c, label: str = "<NA>") -> Column:
    """Factor with NA as its own level (``addNA``), as a string column."""
    return F.coalesce(_c(c).cast("string"), F.lit(label))

"""Month-precision dates (lubridate ``ym``/``my``) and file-name keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ym(c) -> Column:
    """'yyyy-MM' -> first day of month; bad input -> NULL."""
    return F.try_to_date(_c(c), "yyyy-MM")


def my(c) -> Column:
    """'MMyyyy' -> first day of month; bad input -> NULL."""
    return F.try_to_date(_c(c), "MMyyyy")


def months_open(start, cutoff: str = "2022-11") -> Column:
    """Days from ``start`` to the cut-off month, divided by 30."""
    return F.datediff(F.to_date(F.lit(cutoff), "yyyy-MM"), _c(start)) / 30.0


def period_from_path(path_col="_metadata.file_path", digits: int = 4,
                     century: str = "20") -> Column:
    """Snapshot key from a file name: the first ``MMYY`` digits become the
    date ``MM/<century>YY`` (``digits=6`` reads ``MMYYYY`` directly).  Only
    the base name is searched."""
    base = F.element_at(F.split(_c(path_col), "/"), -1)
    found = F.regexp_substr(base, F.lit(r"\d{%d}" % digits))
    if digits == 6:
        return my(found)
    mmyyyy = F.concat(F.substring(found, 1, 2), F.lit(century), F.substring(found, 3, 2))
    return my(mmyyyy)


def first_number_in_path(path_col="_metadata.file_path") -> Column:
    """First run of digits of the base name (state / period keys)."""
    base = F.element_at(F.split(_c(path_col), "/"), -1)
    return F.regexp_substr(base, F.lit(r"[0-9]+"))

"""Dates out of text. No function reads the clock: callers pass ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.text import strip

# Accepted date formats, in order of preference.
SORT_FORMATS = ["d.M.yyyy", "yyyy-M-d", "d/M/yyyy", "yyyy.M.d"]
PAGE_FORMATS = ["d.M.yyyy", "yyyy-M-d", "d/M/yyyy"]
# Dates inside longer texts, with the format each one is read by.
EMBEDDED_DATES = [
    (r"(\d{2}\.\d{2}\.\d{4})", "dd.MM.yyyy"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"(\d{2}/\d{2}/\d{4})", "dd/MM/yyyy"),
]
FAR_PAST = "0001-01-01"


def _first_format(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in formats])


def lenient_date(text: Column) -> Column:
    """Date for sorting: whole-text formats, then a date inside the text, then the far past."""
    embedded = [F.try_to_date(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), fmt) for pattern, fmt in EMBEDDED_DATES]
    return F.coalesce(_first_format(text, SORT_FORMATS), *embedded, F.lit(FAR_PAST).cast("date"))


def page_date(text: Column, as_of: Column | None = None) -> Column:
    """Date of a page field; ``as_of`` (null if not given) where it cannot be read."""
    parsed = _first_format(strip(text), PAGE_FORMATS)
    return parsed if as_of is None else F.coalesce(parsed, as_of)


def embedded_date_text(text: Column) -> Column:
    """The first date found inside a text, as written; null if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern, _ in EMBEDDED_DATES])


def iso_timestamp(text: Column) -> Column:
    """ISO timestamp, with or without a trailing Z."""
    return F.try_to_timestamp(text)


def date_text(date: Column) -> Column:
    """Day.month.year as reports show it."""
    return F.date_format(date, "dd.MM.yyyy")


def year_of_text(text: Column) -> Column:
    """Year of a date text, null if it cannot be read."""
    return F.year(_first_format(strip(text), PAGE_FORMATS))


def year_prefix(text: Column) -> Column:
    """First four characters of a date text."""
    return F.substring(text, 1, 4)

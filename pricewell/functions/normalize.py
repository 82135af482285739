"""Characteristic values: number, unit and normalized text out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.labels import literal_map
from pricewell.functions.text import strip
from pricewell.functions.units import standard_unit

# What counts as a number and as a unit in a characteristic.
NUMBER = r"[\d.,]+"
UNIT = r"[a-zA-Zа-яА-ЯёЁ°²³μ]+\d*"

SPACE = r"[\s\p{Z}]*"

# A number with its unit, possibly after a bound sign that is dropped.
SINGLE = rf"^(?:[<>≤≥]{SPACE})?({NUMBER}){SPACE}(?:{UNIT})$"
# A range with its unit; it stands for its midpoint.
RANGE = rf"^({NUMBER}){SPACE}[-–]{SPACE}({NUMBER}){SPACE}(?:{UNIT})$"
# The unit at the end of either form.
UNIT_AT_END = rf"({UNIT})$"


def _number(text: Column) -> Column:
    return F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def with_normalized(df: DataFrame, value: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>_normalized``, ``_number``, ``_unit`` and ``_is_numeric`` for a text column.

    The steps are separate projections, so each regular expression runs once a row.
    """
    text, shaped, number, unit = (f"{prefix}_{part}" for part in ("normalized", "shaped", "number", "unit"))
    given = F.coalesce(F.col(value), F.lit(""))
    return (
        df.withColumn(text, strip(F.lower(given)))
        .withColumn(shaped, _shaped_number(F.col(text)))
        .withColumns(
            {
                number: F.coalesce(F.col(shaped), _number(F.regexp_extract(text, f"({NUMBER})", 1))),
                unit: F.when(F.col(shaped).isNotNull(), standard_unit(F.regexp_extract(text, UNIT_AT_END, 1))),
            }
        )
        .withColumn(f"{prefix}_is_numeric", F.col(number).isNotNull())
        .drop(shaped)
    )


def _shaped_number(text: Column) -> Column:
    """The number of a text that is a number or range with a unit, else null."""
    midpoint = (_number(F.regexp_extract(text, RANGE, 1)) + _number(F.regexp_extract(text, RANGE, 2))) / F.lit(2.0)
    return F.coalesce(_number(F.regexp_extract(text, SINGLE, 1)), midpoint)


def normalize_value(value: Column) -> Column:
    """The same as one struct: original, normalized, numeric_value, unit, is_numeric."""
    text = strip(F.lower(F.coalesce(value, F.lit(""))))
    shaped = _shaped_number(text)
    number = F.coalesce(shaped, _number(F.regexp_extract(text, f"({NUMBER})", 1)))
    return F.struct(
        F.coalesce(value, F.lit("")).alias("original"),
        text.alias("normalized"),
        number.alias("numeric_value"),
        F.when(shaped.isNotNull(), standard_unit(F.regexp_extract(text, UNIT_AT_END, 1))).alias("unit"),
        number.isNotNull().alias("is_numeric"),
    )


# Other names of common characteristics.
SPEC_SYNONYMS = {"граммаж": "плотность", "cie": "белизна"}


def canonical_spec_name(name: Column) -> Column:
    """Trimmed lower-case name of a characteristic, synonyms mapped to one name."""
    plain = strip(F.lower(name))
    return F.coalesce(F.try_element_at(literal_map(SPEC_SYNONYMS), plain), plain)

"""Units of measure: dictionary, standard spelling, compatibility, conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.labels import literal_array, literal_map

# Each standard unit with the spellings that stand for it. Among
# spellings of one length the earlier one wins, so the order matters.
UNIT_SPELLINGS = {
    "ml": ["ml", "milliliter", "milliliters", "мл", "миллилитр", "миллилитров"],
    "l": ["l", "liter", "liters", "litre", "litres", "л", "литр", "литров"],
    "m3": ["m3", "cubic meter", "cubic meters", "м3", "куб.м", "кубический метр"],
    "g": ["g", "gram", "grams", "г", "грамм"],
    "kg": ["kg", "kilogram", "kilograms", "кг", "килограмм", "килограммов"],
    "t": ["t", "ton", "tons", "tonne", "tonnes", "т", "тонна", "тонн"],
    "mm": ["mm", "millimeter", "millimeters", "мм", "миллиметр", "миллиметров"],
    "cm": ["cm", "centimeter", "centimeters", "см", "сантиметр", "сантиметров"],
    "m": ["m", "meter", "meters", "metre", "metres", "м", "метр", "метров"],
    "km": ["km", "kilometer", "kilometers", "км", "километр", "километров"],
    "m2": ["m2", "square meter", "square meters", "м2", "кв.м", "квадратный метр", "sqm", "sq.m"],
    "pcs": ["pcs", "pc", "piece", "pieces", "шт", "штук", "штука"],
    "unit": ["unit", "units", "ед", "единица", "единиц"],
    "set": ["set", "sets", "компл", "комплект", "комплектов"],
    "h": ["h", "hour", "hours", "ч", "час", "часов"],
    "day": ["day", "days", "д", "день", "дней"],
    "week": ["week", "weeks", "нед", "неделя", "недель"],
    "month": ["month", "months", "мес", "месяц", "месяцев"],
    "year": ["year", "years", "год", "лет", "года"],
}

# Unit pairs that count as compatible, in either direction.
COMPATIBLE_PAIRS = [("ml", "l"), ("l", "m3"), ("g", "kg"), ("kg", "t"), ("mm", "cm"), ("cm", "m"), ("m", "km")]

# Size of each unit in the smallest unit of its kind.
UNIT_SIZE = {
    "ml": 1.0, "l": 1000.0, "m3": 1000000.0,
    "g": 1.0, "kg": 1000.0, "t": 1000000.0,
    "mm": 1.0, "cm": 10.0, "m": 1000.0, "km": 1000000.0,
}

UNIT_OF = {spelling: unit for unit, spellings in UNIT_SPELLINGS.items() for spelling in spellings}
# Longest first; the sort is stable, so dictionary order breaks ties.
SPELLINGS_BY_LENGTH = sorted(UNIT_OF, key=len, reverse=True)

NOT_UNIT_CHARS = r"[^a-zA-Zа-яА-ЯёЁ°²³μ\d]"


def standard_unit(text: Column) -> Column:
    """Standard unit for a unit text.

    An exact spelling wins, then the longest spelling that is a whole word, then
    the longest one contained anywhere; otherwise the cleaned text itself.
    """
    units = literal_map(UNIT_OF)
    spellings = literal_array(SPELLINGS_BY_LENGTH)

    def look_up(cleaned: Column) -> Column:
        # the degree sign is the only kept character that ends a word
        words = F.split(cleaned, "°")
        whole = F.get(F.filter(spellings, lambda s: F.array_contains(words, s)), F.lit(0))
        inside = F.get(F.filter(spellings, lambda s: F.contains(cleaned, s)), F.lit(0))
        contained = F.coalesce(F.when(F.contains(cleaned, F.lit("°")), whole), inside)
        return F.coalesce(F.try_element_at(units, cleaned), F.try_element_at(units, contained), cleaned)

    # bound through a one-element array, so the text is cleaned once and not per spelling
    cleaned = F.regexp_replace(F.lower(text), NOT_UNIT_CHARS, "")
    return F.get(F.transform(F.array(cleaned), look_up), F.lit(0))


def units_compatible(left: Column, right: Column) -> Column:
    """True if both units are missing, equal, or a listed pair in either direction."""
    listed = [f"{a}|{b}" for a, b in COMPATIBLE_PAIRS] + [f"{b}|{a}" for a, b in COMPATIBLE_PAIRS]
    return (
        F.when(left.isNull() & right.isNull(), True)
        .when(left.isNull() | right.isNull(), False)
        .otherwise((left == right) | F.concat_ws("|", left, right).isin(listed))
    )


def in_smallest_unit(number: Column, unit: Column) -> Column:
    """Number converted to the smallest unit of its kind; other units stay as they are."""
    sizes = F.create_map(*[F.lit(part) for pair in UNIT_SIZE.items() for part in pair])
    return number * F.coalesce(F.try_element_at(sizes, unit), F.lit(1.0))

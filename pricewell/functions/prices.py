"""Prices out of text, and unit prices out of contract fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewell.functions.text import strip


def card_price(text: Column) -> Column:
    """Price on a search card: the first run of digits, spaces, commas and dots.

    Only plain spaces are dropped and every comma reads as a decimal dot; what is
    then no number is null, so that the caller can try its next source.
    """
    run = F.regexp_extract(text, r"([\d\s\p{Z},.]+)", 1)
    digits = F.replace(F.replace(run, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return strip(digits).try_cast("double")


def page_price(text: Column) -> Column:
    """Price on a contract page: digits and commas only, the comma being the decimal mark.

    A decimal dot is dropped with the currency text, as in the pages this was made for.
    """
    digits = F.regexp_replace(text, r"[^\d,]", "")
    return F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")


def unit_price(first_item_price: Column, total: Column, first_item_quantity: Column) -> Column:
    """Unit price of a contract: its first item's, else total by quantity, else null.

    Zero counts as missing in all three places.
    """
    zero = F.lit(0)
    return F.coalesce(
        F.nullif(first_item_price, zero),
        F.nullif(total, zero) / F.nullif(first_item_quantity, zero),
    )

"""Text, money and number rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything Unicode counts as white space at the ends of a text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)

# Legal forms that are not part of a maker's name.
LEGAL_FORMS = ["ООО", "LLC", "GmbH", "Inc", "Corp", "Company"]

# Currency marks in price texts.
CURRENCY_MARKS = [("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("РУБ", "RUB"), ("₽", "RUB"), ("RUB", "RUB")]

# Name fragments that decide the display category.
CATEGORY_WORDS = [("paper", ["бумаг"]), ("pc", ["комп", "моноблок"])]


def strip(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def normalize_text(text: Column) -> Column:
    """Trimmed lower case; null becomes the empty text."""
    return F.coalesce(F.lower(strip(text)), F.lit(""))


def strip_legal_form(name: Column) -> Column:
    """Lower-case maker name without legal forms at its ends."""
    form = "(?:" + "|".join(f.lower() for f in LEGAL_FORMS) + r")\.?"
    inner = F.regexp_replace(normalize_text(name), rf"^(?:{form}\s+)+", "")
    return strip(F.regexp_replace(inner, rf"(?:\s+{form})+$", ""))


def currency_of(text: Column) -> Column:
    """Currency named in a price text, rubles by default."""
    upper = F.upper(text)
    chain = F.when(upper.contains(CURRENCY_MARKS[0][0]), F.lit(CURRENCY_MARKS[0][1]))
    for mark, code in CURRENCY_MARKS[1:]:
        chain = chain.when(upper.contains(mark), F.lit(code))
    return chain.otherwise(F.lit("RUB"))


def category_of(name: Column) -> Column:
    """Display category from fragments of the name."""
    lower = F.lower(name)
    chain = None
    for category, words in CATEGORY_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | lower.contains(word)
        chain = F.when(hit, F.lit(category)) if chain is None else chain.when(hit, F.lit(category))
    return chain.otherwise(F.lit("generic"))


def money_text(amount: Column) -> Column:
    """Two decimals with thousands separators."""
    return F.format_number(amount.cast("decimal(18,2)"), 2)


def percent(done: Column, total: Column) -> Column:
    """Share in percent; zero where the total is zero or missing."""
    return F.when(total > 0, done / total * F.lit(100.0)).otherwise(F.lit(0.0))


def step_percent(step: Column, total: Column) -> Column:
    """Progress of one step on the 10 to 90 percent stretch of a run, in whole percent."""
    return F.lit(10) + F.when(total > 0, F.floor(step / total * F.lit(80.0))).otherwise(F.lit(0)).cast("int")


def plain_number(number: Column) -> Column:
    """A number without exponent, with at least one and at most six decimals."""
    digits = F.regexp_replace(number.cast("decimal(28,6)").cast("string"), "0+$", "")
    return F.regexp_replace(digits, r"\.$", ".0")

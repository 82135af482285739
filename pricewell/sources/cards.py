"""Search result pages: site total and contract cards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions.dates import embedded_date_text
from pricewell.functions.prices import card_price
from pricewell.sources.pages import Selector, absolute_url, selected, text_of

# Where a result page shows its parts, in order of preference.
TOTAL = [
    Selector("div", css="search-results__total"),
    Selector("div", css="search-results-total"),
    Selector("div", css="total-results"),
    Selector("span", css="total-count"),
    Selector("div", css="results-count"),
]
CARD = [
    Selector("div", css="search-registry-entry-block"),
    Selector("div", css="registry-entry"),
    Selector("div", css="contract-card"),
    Selector("div", css="search-result-item"),
    Selector("div", css="card-wrapper"),
]
REGISTRY_NO = [
    Selector("a", css="registry-entry__header-mid__number"),
    Selector("div", css="registry-entry__header-mid__number"),
    Selector("span", css="contract-number"),
    Selector("div", css="contract-id"),
    Selector("a", link_part="/contract/"),
    Selector("a", link_part="/epz/contract/"),
]
DATE = [
    Selector("div", css="data-block__value"),
    Selector("span", css="contract-date"),
    Selector("div", css="publish-date"),
    Selector("time"),
    Selector("div", css="date-value"),
]
PRICE = [
    Selector("div", css="price-block__value"),
    Selector("span", css="contract-price"),
    Selector("div", css="price-value"),
    Selector("div", css="amount"),
    Selector("span", css="amount-value"),
]
URL = [
    Selector("a", css="registry-entry__header-mid__number", linked=True),
    Selector("a", link_part="/contract/", linked=True),
    Selector("a", link_part="/epz/contract/", linked=True),
    Selector("a", css="card-link", linked=True),
]
CUSTOMER = [
    Selector("div", css="registry-entry__body-href"),
    Selector("div", css="customer-name"),
    Selector("span", css="organization"),
    Selector("div", css="procuring-entity"),
]
STATUS = [
    Selector("div", css="registry-entry__header-mid__title"),
    Selector("span", css="contract-status"),
    Selector("div", css="status-badge"),
    Selector("div", css="execution-status"),
]


def numbered(*groups: Sequence[Selector]) -> tuple[list[Selector], list[range]]:
    """All selectors of some groups in one list, and the numbers of each group."""
    numbers, start = [], 0
    for group in groups:
        numbers.append(range(start, start + len(group)))
        start += len(group)
    return [selector for group in groups for selector in group], numbers


def first_value(
    hits: Column, numbers: Sequence[int], value: Callable[[Column], Column], default: Column | None = None
) -> Column:
    """The value of the first selector that has one: each selector offers its first hit."""
    first = lambda n: F.get(F.filter(hits, lambda h: h["selector"] == n), F.lit(0))
    offers = [F.get(F.transform(F.array(first(n)), value), F.lit(0)) for n in numbers]
    return F.coalesce(*offers, *([default] if default is not None else []))


def largest_number(text: Column) -> Column:
    """The largest of the numbers in a text, blanks inside numbers allowed; null without one."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d[\d\s\p{Z}]*)"), F.lit(1))
    return F.array_max(F.transform(runs, lambda r: F.trim(F.replace(r, F.lit(" "), F.lit(""))).try_cast("bigint")))


def site_totals(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of hits each result page states, 0 if it states none."""
    chosen, (total,) = numbered(TOTAL)
    value = lambda h: largest_number(text_of(h, F.col("texts")))
    stated = first_value(F.col("hits"), total, value, F.lit(0).cast("bigint"))
    return selected(pages, keys, chosen).select(*keys, stated.alias("site_total"))


def search_cards(pages: DataFrame, keys: Sequence[str], base_url: str) -> DataFrame:
    """The contract cards of result pages; cards without number and date are dropped."""
    chosen, (card, registry_no, date, price, url, customer, status) = numbered(
        CARD, REGISTRY_NO, DATE, PRICE, URL, CUSTOMER, STATUS
    )
    hits = F.col("hits")
    # the cards are the hits of the first of their selectors that has any
    kind = F.array_min(F.transform(F.filter(hits, lambda h: h["selector"] <= card[-1]), lambda h: h["selector"]))
    one_card = F.transform(
        F.filter(hits, lambda h: h["selector"] == F.col("kind")),
        lambda c: F.struct(
            F.filter(hits, lambda h: (h["idx"] > c["idx"]) & (h["idx"] <= c["last"]) & (h["selector"] > card[-1])).alias("inside"),
            F.slice("texts", c["t_from"] + 1, c["t_to"] - c["t_from"]).alias("texts"),
            c["t_from"].alias("base"),
        ),
    )
    rows = (
        selected(pages, keys, chosen)
        .withColumn("kind", kind)
        .select(*keys, F.posexplode(one_card).alias("card_no", "card"))
        .select(*keys, "card_no", "card.*")
    )
    inside = F.col("inside")
    text = lambda h: text_of(h, F.col("texts"), F.col("base"))
    blank = F.lit("")
    link = lambda h: absolute_url(F.nullif(h["href"], blank), F.lit(base_url))
    return (
        rows.select(
            *keys,
            "card_no",
            first_value(inside, registry_no, lambda h: F.nullif(text(h), blank), blank).alias("registry_no"),
            first_value(inside, date, lambda h: embedded_date_text(text(h)), blank).alias("date"),
            first_value(inside, price, lambda h: card_price(text(h))).alias("price"),
            first_value(inside, url, link, blank).alias("url"),
            first_value(inside, customer, text, blank).alias("customer"),
            first_value(inside, status, text, blank).alias("status"),
        )
        .filter((F.col("registry_no") != "") | (F.col("date") != ""))
    )

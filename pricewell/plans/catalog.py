"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from pricewell.plans import characteristics, dialogs, listings, live, selection, values, web_pages
from pricewell.plans.registry import Query

PARTS = [selection.query, characteristics.query, values.query, listings.query, web_pages.query, dialogs.query, live.query]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for part in PARTS:
        found.update(part.queries)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for part in PARTS:
        found.update(part.sql)
    return found

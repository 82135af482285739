"""Price aggregation against brute force."""

from decimal import Decimal
from statistics import median

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pricewell.operators import prices


def kept_by_hand(values):
    if len(values) < 3:
        return list(values)
    ordered, n = sorted(values), len(values)
    q1, q3 = ordered[n // 4], ordered[3 * n // 4]
    spread = 1.5 * (q3 - q1)
    return [v for v in values if q1 - spread <= v <= q3 + spread]


def frame(spark, groups):
    rows = [(g, Decimal(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "search_id STRING, unit_price DECIMAL(15,2)")


GOLDEN = {
    "two": ([100, 900], 2),
    "three": ([100, 100, 900], 3),
    "eight": ([10, 11, 12, 13, 14, 15, 16, 100], 7),
    "flat": ([5, 5, 5, 5, 9], 4),
}


def test_outlier_golden_rows(spark):
    df = frame(spark, {name: values for name, (values, _) in GOLDEN.items()})
    small = {r.search_id: r for r in prices.small_group_ceiling(df, ["search_id"]).collect()}
    positions = prices.price_positions(df, ["search_id"], "unit_price")
    large = {r.search_id: r for r in prices.cleaned_mean(positions, ["search_id"]).collect()}
    left = prices.without_outliers(df, ["search_id"]).groupBy("search_id").count()
    counts = {r.search_id: r["count"] for r in left.collect()}
    for name, (values, kept) in GOLDEN.items():
        mean = sum(kept_by_hand(values)) / len(kept_by_hand(values))
        assert small[name].kept_count == large[name].kept == counts[name] == kept
        assert small[name].ceiling == pytest.approx(mean) and large[name].mean_price == pytest.approx(mean)


def test_groups_without_a_valid_price_have_no_ceiling(spark):
    df = spark.createDataFrame([("a", None), ("a", Decimal(0))], "search_id STRING, unit_price DECIMAL(15,2)")
    row = prices.small_group_ceiling(df, ["search_id"]).first()
    assert (row.selected_count, row.priced_count, row.ceiling) == (2, 0, None)


def test_groups_without_a_valid_price_stay(spark):
    rows = [("a", None), ("a", Decimal(0)), ("b", Decimal(4)), ("b", None), (None, Decimal(6)), (None, Decimal(6))]
    df = spark.createDataFrame(rows, "search_id STRING, unit_price DECIMAL(15,2)")
    positions = prices.price_positions(df, ["search_id"], "unit_price")
    cleaned = {r.search_id: (r.kept, r.mean_price) for r in prices.cleaned_mean(positions, ["search_id"]).collect()}
    assert cleaned == {"a": (0, None), "b": (1, 4.0), None: (2, 6.0)}
    middle = {r.search_id: (r.prices, r.median_price) for r in prices.median_price(positions, ["search_id"]).collect()}
    assert middle == {"a": (0, None), "b": (1, 4.0), None: (2, 6.0)}
    trimmed = {r.search_id: (r.used, r.trimmed_mean) for r in prices.trimmed_mean(positions, ["search_id"]).collect()}
    assert trimmed == {"a": (0, None), "b": (1, 4.0), None: (2, 6.0)}
    assert prices.without_outliers(df, ["search_id"]).count() == 3


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from("abcd"), st.lists(st.integers(1, 400), min_size=1, max_size=40), min_size=1, max_size=4
    )
)
def test_large_group_aggregates_match_brute_force(spark, groups):
    positions = prices.price_positions(frame(spark, groups).repartition(3), ["search_id"], "unit_price")
    cleaned = {r.search_id: r for r in prices.cleaned_mean(positions, ["search_id"]).collect()}
    middle = {r.search_id: r.median_price for r in prices.median_price(positions, ["search_id"]).collect()}
    trimmed = {r.search_id: r for r in prices.trimmed_mean(positions, ["search_id"]).collect()}
    for group, values in groups.items():
        kept = kept_by_hand(values)
        assert kept, "cleaning never empties a group"
        assert cleaned[group].kept == len(kept)
        assert cleaned[group].mean_price == pytest.approx(sum(kept) / len(kept))
        assert middle[group] == pytest.approx(median(values))
        cut = len(values) * 10 // 100
        inner = sorted(values)[cut : len(values) - cut]
        assert trimmed[group].used == len(inner)
        assert trimmed[group].trimmed_mean == pytest.approx(sum(inner) / len(inner))

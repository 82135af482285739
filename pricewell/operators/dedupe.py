"""Exact duplicates of texts and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.operators.topk import first_per_key


def distinct_texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The first document of each distinct text, with the number of its copies.

    Only digests are shuffled, and copies are counted before the shuffle.
    """
    hashed = documents.select(key, F.sha2(text, 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def one_per_search_and_number(results: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One result per search and registry number, chosen by a total order."""
    return first_per_key(results, ["search_id", "registry_no"], order)

"""Fuzzy text similarity as Arrow-batched functions.

Each function scores a pair once and remembers it for the rest of its task, so
repeated pairs (the usual case for names) cost a lookup. Nothing is shuffled: a
pair that fills a third of all rows is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Remembered pairs are forgotten before the next batch when their texts take more bytes than this.
REMEMBERED_BYTES = 64_000_000
# What a pair takes beside its characters.
PAIR_BYTES = 250


def _positions(text: str) -> dict[str, int]:
    """For each character, the set of its positions as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(text):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def _common(where: dict[str, int], size: int, other: str) -> int:
    row = full = (1 << size) - 1
    for ch in other:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one word operation per character."""
    return _common(_positions(a), len(a), b)


def ratio(a: str, b: str) -> float:
    """Share of characters in the longest common subsequence."""
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one.

    Windows are as long as the shorter text, or cut off at either end of the longer.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(short) == len(long) else best


def _best_window(short: str, long: str) -> float:
    n, where, best = len(short), _positions(short), 0.0
    for start in range(1 - n, len(long)):
        lo, hi = max(start, 0), min(start + n, len(long))
        # without its useless edge character a window is no worse; its neighbour covers that
        edge = long[hi - 1] if start <= len(long) - n else long[lo]
        if edge in where:
            best = max(best, 2.0 * _common(where, n, long[lo:hi]) / (n + hi - lo))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    """Ratio of the texts with their words sorted."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words, and the shared words with either rest."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 1.0
    rest_a, rest_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    common = len(" ".join(sorted(shared)))
    gap = 1 if common else 0
    size_a, size_b = common + gap + len(rest_a), common + gap + len(rest_b)
    # what the two full texts share: the common words and the best match of the rests
    best = 2.0 * (common + gap + lcs_length(rest_a, rest_b)) / (size_a + size_b)
    if common:
        best = max(best, 2.0 * common / (common + size_a), 2.0 * common / (common + size_b))
    return best


def best_ratio(a: str, b: str) -> float:
    """The best of the four ratios; two empty texts are alike, one empty text matches nothing."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def _batched(score: Callable[[str, str], float]):
    known: dict[tuple[str, str], float] = {}
    held = 0

    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        nonlocal held
        if held > REMEMBERED_BYTES:
            known.clear()
            held = 0
        scores: list[float | None] = []
        for pair in zip(left, right):
            if None in pair:
                scores.append(None)
                continue
            found = known.get(pair)
            if found is None:
                found = score(*pair)
                size = PAIR_BYTES + 4 * (len(pair[0]) + len(pair[1]))
                if held + size <= 2 * REMEMBERED_BYTES:
                    known[pair] = found
                    held += size
            scores.append(found)
        return pd.Series(scores, dtype="float64")

    return F.pandas_udf(apply, "double")


def text_similarity(left: Column, right: Column) -> Column:
    """Best of the four ratios, 0 to 1; null if either text is null."""
    return _batched(best_ratio)(left, right)


def name_ratio(left: Column, right: Column) -> Column:
    return _batched(ratio)(left, right)


def name_partial_ratio(left: Column, right: Column) -> Column:
    return _batched(partial_ratio)(left, right)


def name_token_sort_ratio(left: Column, right: Column) -> Column:
    return _batched(token_sort_ratio)(left, right)


def name_token_set_ratio(left: Column, right: Column) -> Column:
    return _batched(token_set_ratio)(left, right)

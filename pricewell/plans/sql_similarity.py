"""The four text ratios in plain SQL, for short texts (up to 60 characters)."""

from __future__ import annotations


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two SQL text expressions."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = (
        f"coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substring({a}, i + 1, 1) = c"
        " THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT"
    )
    masks = f"list_transform(string_split({b}, ''), lambda c: {mask})"
    step = f"((row + (row & m)) | (row - (row & m))) & {full}"
    folded = f"list_reduce({masks}, lambda row, m: {step}, {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({folded}) END)"


def ratio(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * {lcs(a, b)} / (length({a}) + length({b})))"


def similarity_ctes(pairs: str) -> str:
    """CTEs ending in ``sim(a, b, ratio, partial, token_sort, token_set, best)``.

    ``pairs`` is SQL giving distinct non-empty texts ``a`` and ``b``.
    """
    return f"""
pairs AS ({pairs}),
oriented AS (
  SELECT a, b, a AS s, b AS l FROM pairs WHERE length(a) <= length(b)
  UNION ALL SELECT a, b, b, a FROM pairs WHERE length(b) <= length(a)),
windows AS (
  SELECT DISTINCT a, b, s, substring(l, greatest(st, 0) + 1, least(st + length(s), length(l)) - greatest(st, 0)) AS w
  FROM (SELECT *, unnest(range(1 - length(s), length(l))) AS st FROM oriented)),
partials AS (SELECT a, b, max({ratio('s', 'w')}) AS partial FROM windows GROUP BY a, b),
words AS (
  SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa,
         array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb,
         list_sort(list_distinct(string_split(a, ' '))) AS ta, list_sort(list_distinct(string_split(b, ' '))) AS tb
  FROM pairs),
rests AS (
  SELECT *, array_to_string(list_filter(ta, lambda x: NOT list_contains(tb, x)), ' ') AS ra,
         array_to_string(list_filter(tb, lambda x: NOT list_contains(ta, x)), ' ') AS rb,
         length(array_to_string(list_filter(ta, lambda x: list_contains(tb, x)), ' ')) AS common
  FROM words),
sized AS (
  SELECT *, CASE WHEN common > 0 THEN 1 ELSE 0 END AS gap,
         common + CASE WHEN common > 0 THEN 1 ELSE 0 END + length(ra) AS na,
         common + CASE WHEN common > 0 THEN 1 ELSE 0 END + length(rb) AS nb FROM rests),
ratios AS (
  SELECT p.a, p.b, {ratio('p.a', 'p.b')} AS ratio, q.partial, {ratio('t.sa', 't.sb')} AS token_sort,
         CASE WHEN common > 0 AND (ra = '' OR rb = '') THEN 1.0::DOUBLE
              ELSE greatest(2.0::DOUBLE * (common + gap + {lcs('t.ra', 't.rb')}) / (na + nb),
                            CASE WHEN common > 0 THEN 2.0::DOUBLE * common / (common + na) ELSE 0 END,
                            CASE WHEN common > 0 THEN 2.0::DOUBLE * common / (common + nb) ELSE 0 END)
         END AS token_set
  FROM pairs p JOIN partials q ON p.a = q.a AND p.b = q.b JOIN sized t ON p.a = t.a AND p.b = t.b),
sim AS (SELECT *, greatest(ratio, partial, token_sort, token_set) AS best FROM ratios)"""

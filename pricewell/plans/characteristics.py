"""Normalization, similarity and specification matching queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import compare, scoring, similarity, units
from pricewell.functions.normalize import with_normalized
from pricewell.operators import joins, matching, name_join, prices, synonyms
from pricewell.plans import ceiling
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.sql_similarity import similarity_ctes
from pricewell.plans.sql_views import add_view, with_views
from pricewell.session import materialized
from pricewell.sources import tables

query = Registry()


def pick(position: Column, values: list[str | None]) -> Column:
    """One of some literal values, by a zero-based position."""
    return F.get(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def sql_pick(position: str, values: list[str | None]) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{quoted}])[{position} + 1]"


# ---------------------------------------------------------------- normalization

# Value texts in the spellings the normalizer must read; N is the line's quantity.
VALUE_SHAPES = [
    "N мм", "Nмм", "N.5 кг", "N-99 м", ">N г", "N,5л", "N г/м2", "N%", "core iN", "a, b N", "Ngb",
    "сталь", "", " N ШТ ", "N–60 см", "1.2.N кг", "≤ N мл",
]

_UNIT_ROWS = ", ".join(f"('{s}', '{u}', {i})" for i, (s, u) in enumerate(units.UNIT_OF.items()))
add_view("units", f"SELECT * FROM (VALUES {_UNIT_ROWS}) t(spelling, unit, ord)", [])

_UNIT = "[a-zA-Zа-яА-ЯёЁ°²³μ]+[0-9]*"


def _sql_number(text: str) -> str:
    return f"try_cast(replace(nullif({text}, ''), ',', '.') AS DOUBLE)"


def normalized_ctes(values: str) -> str:
    """CTEs ending in ``norm(v, normalized, number, unit)`` for SQL giving distinct texts ``v``."""
    single = rf"regexp_extract(n, '^(?:[<>≤≥]\s*)?([\d.,]+)\s*(?:{_UNIT})$', 1)"
    low, high = (rf"regexp_extract(n, '^([\d.,]+)\s*[-–]\s*([\d.,]+)\s*(?:{_UNIT})$', {g})" for g in (1, 2))
    return rf"""
values_given AS ({values}),
shaped AS (
  SELECT v, n, coalesce({_sql_number(single)}, ({_sql_number(low)} + {_sql_number(high)}) / 2.0) AS shaped,
         regexp_extract(n, '({_UNIT})$', 1) AS u
  FROM (SELECT v, lower(trim(coalesce(v, ''))) AS n FROM values_given)),
standard AS (
  SELECT u, coalesce(unit, u) AS unit FROM (SELECT DISTINCT u FROM shaped) LEFT JOIN units ON contains(u, spelling)
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY length(spelling) DESC, ord) = 1),
norm AS (
  SELECT v, n AS normalized,
         coalesce(shaped, {_sql_number(r"regexp_extract(n, '([\d.,]+)', 1)")}) AS number,
         CASE WHEN shaped IS NOT NULL THEN unit END AS unit
  FROM shaped JOIN standard USING (u))"""


def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.table(spark, sf_dir, "lineitem")
    shape = pick(F.pmod("l_partkey", F.lit(len(VALUE_SHAPES))), VALUE_SHAPES)
    quantity = F.col("l_quantity").cast("int").cast("string")
    return line.select(F.replace(shape, F.lit("N"), quantity).alias("value"))


_VALUES_SQL = f"""SELECT replace({sql_pick(f'l_partkey % {len(VALUE_SHAPES)}', VALUE_SHAPES)}, 'N',
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS v, count(*) AS n FROM lineitem GROUP BY ALL"""


@query(
    "normalize_values",
    with_views(
        f""", counted AS ({_VALUES_SQL}), {normalized_ctes('SELECT v FROM counted').strip()}
        SELECT c.v AS value, normalized, number, unit, CAST(number IS NOT NULL AS VARCHAR) AS is_numeric, n AS rows
        FROM counted c JOIN norm USING (v)""",
        "units",
    ),
)
def normalize_values(spark, sf_dir):
    """Each distinct text is normalized once."""
    distinct = value_texts(spark, sf_dir).groupBy("value").agg(F.count("*").alias("rows"))
    normalized = with_normalized(distinct, "value", "v")
    return shown(
        normalized.select(
            "value",
            F.col("v_normalized").alias("normalized"),
            F.col("v_number").alias("number"),
            F.col("v_unit").alias("unit"),
            F.col("v_is_numeric").alias("is_numeric"),
            "rows",
        )
    )


UNIT_TEXTS = [
    "gb", "квт", "м²", "см3", "дюйм", "°c", "kg", "Литров", "куб.м", "штуки", "миллиметров", "xyz", "м/с",
    "cubic meter", "sqm", "компл.", "часа", "тонны", "PCS", "год", "года", "щ",
]


@query(
    "standardize_units",
    with_views(
        f""", given AS (SELECT {sql_pick(f'l_partkey % {len(UNIT_TEXTS)}', UNIT_TEXTS)} AS unit_text,
            count(*) AS rows FROM lineitem GROUP BY ALL),
        cleaned AS (SELECT *, regexp_replace(lower(unit_text), '[^a-zA-Zа-яА-ЯёЁ°²³μ0-9]', '', 'g') AS u FROM given)
        SELECT unit_text, rows, coalesce(unit, u) AS standard FROM cleaned LEFT JOIN units ON contains(u, spelling)
        QUALIFY row_number() OVER (PARTITION BY unit_text ORDER BY length(spelling) DESC, ord) = 1""",
        "units",
    ),
)
def standardize_units(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    texts = line.select(pick(F.pmod("l_partkey", F.lit(len(UNIT_TEXTS))), UNIT_TEXTS).alias("unit_text"))
    distinct = texts.groupBy("unit_text").agg(F.count("*").alias("rows"))
    return shown(distinct.withColumn("standard", units.standard_unit(F.col("unit_text"))))


# ---------------------------------------------------------------- numbers and units

ACTUAL_UNITS = ["mm", "cm", "kg", None]
_COMPATIBLE = "(" + ", ".join(
    f"'{a}|{b}', '{b}|{a}'" for a, b in units.COMPATIBLE_PAIRS
) + ")"


def sql_compatible(a: str, b: str) -> str:
    return (
        f"(CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false"
        f" ELSE {a} = {b} OR ({a} || '|' || {b}) IN {_COMPATIBLE} END)"
    )


def sql_confidence(t: str, a: str, tu: str, au: str) -> str:
    gap = f"(abs({t} - {a}) / greatest(abs({t}), abs({a})))"
    return (
        f"CASE WHEN NOT {sql_compatible(tu, au)} THEN 0.0::DOUBLE WHEN {t} = 0 AND {a} = 0 THEN 1.0"
        f" WHEN {t} = 0 OR {a} = 0 THEN 0.0"
        f" WHEN {gap} <= 0.01::DOUBLE THEN 1.0::DOUBLE - {gap} / 0.01::DOUBLE"
        f" ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ({gap} - 0.01::DOUBLE)) END"
    )


_SIZED = (
    "SELECT search_id, contract_id, target_size_mm::DOUBLE AS t, size_mm::DOUBLE AS a, 'mm' AS tu, "
    f"{sql_pick('l_partkey % 4', ACTUAL_UNITS)} AS au FROM candidates"
)


def sized_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested and delivered size, the latter in changing units."""
    return ceiling.candidate_contracts(spark, sf_dir).select(
        "search_id",
        "contract_id",
        F.col("target_size_mm").cast("double").alias("t"),
        F.col("size_mm").cast("double").alias("a"),
        F.lit("mm").alias("tu"),
        pick(F.pmod("l_partkey", F.lit(4)), ACTUAL_UNITS).alias("au"),
    )


def _confidence(df: DataFrame, mode: str) -> DataFrame:
    confidence = compare.numeric_confidence(F.col("t"), F.col("a"), F.col("tu"), F.col("au"), mode=mode)
    return shown(df.select("search_id", "contract_id", confidence.alias("confidence")))


@query(
    "numeric_confidence_compat",
    with_views(
        f", sized AS ({_SIZED}) SELECT search_id, contract_id, {sql_confidence('t', 'a', 'tu', 'au')}"
        " AS confidence FROM sized",
        "candidates",
    ),
)
def numeric_confidence_compat(spark, sf_dir):
    return _confidence(sized_candidates(spark, sf_dir), "compat")


@query(
    "numeric_confidence_strict",
    with_views(
        f""", sized AS ({_SIZED}), sizes AS (SELECT *, a * CASE au WHEN 'cm' THEN 10.0::DOUBLE WHEN 'kg' THEN 1000
            ELSE 1 END AS b FROM sized)
        SELECT search_id, contract_id, CASE WHEN NOT {sql_compatible('tu', 'au')} THEN 0.0::DOUBLE
          WHEN t = 0 AND b = 0 THEN 1.0 WHEN t = 0 OR b = 0 THEN 0.0
          ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(t - b) / greatest(abs(t), abs(b))) END AS confidence
        FROM sizes""",
        "candidates",
    ),
)
def numeric_confidence_strict(spark, sf_dir):
    return _confidence(sized_candidates(spark, sf_dir), "strict")


PAIR_UNITS = ["ml", "l", "m3", "g", "kg", "t", "mm", "cm", "m", "km", "pcs", None]


@query(
    "unit_compatibility",
    f"""WITH pairs AS (SELECT {sql_pick('l_partkey % 12', PAIR_UNITS)} AS u1, {sql_pick('l_suppkey % 12', PAIR_UNITS)}
      AS u2 FROM lineitem)
    SELECT u1, u2, CAST({sql_compatible('u1', 'u2')} AS VARCHAR) AS compatible, count(*) AS rows
    FROM pairs GROUP BY ALL""",
)
def unit_compatibility(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    n = F.lit(len(PAIR_UNITS))
    pairs = line.select(
        pick(F.pmod("l_partkey", n), PAIR_UNITS).alias("u1"), pick(F.pmod("l_suppkey", n), PAIR_UNITS).alias("u2")
    )
    counted = pairs.groupBy("u1", "u2").agg(F.count("*").alias("rows"))
    return shown(counted.withColumn("compatible", units.units_compatible(F.col("u1"), F.col("u2"))))


# ---------------------------------------------------------------- text similarity

_NAME_PAIRS = "SELECT DISTINCT lower(target_name) AS a, lower(object_name) AS b FROM candidates"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct requested and delivered names that meet in a candidate."""
    names = ceiling.candidate_contracts(spark, sf_dir).select(
        F.lower("target_name").alias("a"), F.lower("object_name").alias("b")
    )
    return names.distinct()


def _ratio_query(name: str, column: str, score) -> None:
    sql = with_views(f", {similarity_ctes(_NAME_PAIRS).strip()} SELECT a, b, {column} AS score FROM sim", "candidates")

    @query(name, sql)
    def run(spark, sf_dir):
        return name_pairs(spark, sf_dir).withColumn("score", score(F.col("a"), F.col("b")))


_ratio_query("name_ratio", "ratio", similarity.name_ratio)
_ratio_query("name_partial_ratio", "partial", similarity.name_partial_ratio)
_ratio_query("name_token_sort", "token_sort", similarity.name_token_sort_ratio)
_ratio_query("name_token_set", "token_set", similarity.name_token_set_ratio)
_ratio_query("string_similarity", "best", similarity.text_similarity)


add_view("part_names", "SELECT p_type AS code, p_name AS object_name FROM part", [])


@query(
    "fuzzy_names_by_code",
    with_views(
        ", "
        + similarity_ctes(
            "SELECT DISTINCT lower(q.object_name) AS a, lower(c.object_name) AS b"
            " FROM requests q JOIN part_names c ON q.ktru_code = c.code"
        ).strip()
        + """ SELECT DISTINCT c.code, a AS target_name, b AS object_name, best AS similarity
        FROM requests q JOIN part_names c ON q.ktru_code = c.code
        JOIN sim ON a = lower(q.object_name) AND b = lower(c.object_name) WHERE best > 0.8""",
        "part_names",
        "requests",
    ),
)
def fuzzy_names_by_code(spark, sf_dir):
    wanted = tables.requests(spark, sf_dir).select(
        F.col("ktru_code").alias("code"), F.col("object_name").alias("target_name")
    )
    found = tables.table(spark, sf_dir, "part").select(F.col("p_type").alias("code"), F.col("p_name").alias("object_name"))
    return name_join.similar_names(wanted, found, ["code"], "target_name", "object_name", compare.NAME_THRESHOLD)


# Pairs of synonyms, from which chains follow: a name and the brand of one size, as if they meant the same.
_SYNONYMS = """pairs AS (SELECT lower(p_name) AS a, lower(p_brand) AS b FROM part WHERE p_size = 1),
  links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
  known AS (SELECT a AS name, least(a, min(b)) AS canonical FROM reached GROUP BY a)"""


def synonym_groups_of(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").where("p_size = 1")
    return synonyms.groups(part, "p_name", "p_brand")


@query("synonym_groups", f"WITH RECURSIVE {_SYNONYMS} SELECT name, canonical FROM known")
def synonym_groups(spark, sf_dir):
    """Groups of names that pairs join, also over others."""
    return synonym_groups_of(spark, sf_dir)


@query(
    "canonical_names",
    f"""WITH RECURSIVE {_SYNONYMS} SELECT l_partkey AS p_partkey, coalesce(canonical, lower(p_name)) AS canonical, count(*) AS lines,
      sum(l_quantity::BIGINT)::BIGINT AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN known ON name = lower(p_name) GROUP BY ALL""",
)
def canonical_names(spark, sf_dir):
    """Line items under the one name of their group of synonyms."""
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = synonyms.with_canonical(part, "p_name", synonym_groups_of(spark, sf_dir)).select("p_partkey", "canonical")
    line = tables.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").cast("bigint").alias("q"))
    counts = line.groupBy("p_partkey").agg(F.count("*").alias("lines"), F.sum("q").alias("quantity"))
    return counts.join(named, "p_partkey").select("p_partkey", "canonical", "lines", "quantity")


# ---------------------------------------------------------------- manufacturers


def _maker_counts(df: DataFrame, **columns: Column) -> DataFrame:
    named = df.select(
        F.col("target_manufacturer").alias("target"), F.col("manufacturer").alias("found"),
        *[col.alias(name) for name, col in columns.items()],
    )
    return shown(named.groupBy(*named.columns).agg(F.count("*").alias("rows")))


_MAKERS = "SELECT target_manufacturer AS target, manufacturer AS found, {expr} AS {name}, count(*) AS rows" + (
    " FROM {source} GROUP BY ALL"
)


@query(
    "manufacturer_exact",
    with_views(
        _MAKERS.format(
            expr="CAST(lower(trim(target_manufacturer)) = lower(trim(manufacturer)) AS VARCHAR)",
            name="same",
            source="candidates",
        ),
        "candidates",
    ),
)
def manufacturer_exact(spark, sf_dir):
    rows = ceiling.candidate_contracts(spark, sf_dir)
    return _maker_counts(rows, same=compare.maker_exact(F.col("target_manufacturer"), F.col("manufacturer")))


@query(
    "manufacturer_contains",
    with_views(
        _MAKERS.format(
            expr="CAST(coalesce(contains(lower(manufacturer), lower(target_manufacturer)), false) AS VARCHAR)",
            name="contained",
            source="candidates",
        ),
        "candidates",
    ),
)
def manufacturer_contains(spark, sf_dir):
    rows = ceiling.candidate_contracts(spark, sf_dir)
    return _maker_counts(rows, contained=compare.maker_contains(F.col("target_manufacturer"), F.col("manufacturer")))


@query(
    "manufacturer_warning",
    with_views(
        _MAKERS.format(
            expr="CAST(is_recent AND NOT contains(lower(coalesce(manufacturer, '')), lower(target_manufacturer))"
            " AS VARCHAR)",
            name="warning",
            source="scored",
        ),
        "scored",
    ),
)
def manufacturer_warning(spark, sf_dir):
    rows = tables.with_match_attributes(ceiling.candidate_contracts(spark, sf_dir))
    warning = compare.maker_warning(F.col("is_recent"), F.col("target_manufacturer"), F.col("manufacturer"))
    return _maker_counts(rows, warning=warning)


_MAKER_PAIRS = """SELECT DISTINCT lower('ООО ' || target_manufacturer) AS a, lower(manufacturer) AS b FROM candidates
  WHERE manufacturer IS NOT NULL AND target_manufacturer IS NOT NULL"""


@query(
    "manufacturer_fuzzy",
    with_views(
        f""", {similarity_ctes(_MAKER_PAIRS).strip()}, counted AS (SELECT 'ООО ' || target_manufacturer AS target,
          manufacturer AS found, count(*) AS rows FROM candidates GROUP BY ALL)
        SELECT target, found, rows, coalesce(best, 0.0) AS similarity,
          CAST(coalesce(best, 0.0) >= 0.7 AS VARCHAR) AS alike
        FROM counted LEFT JOIN sim ON lower(target) = a AND lower(found) = b""",
        "candidates",
    ),
)
def manufacturer_fuzzy(spark, sf_dir):
    rows = ceiling.candidate_contracts(spark, sf_dir)
    counted = (
        rows.select(
            F.concat(F.lit("ООО "), "target_manufacturer").alias("target"), F.col("manufacturer").alias("found")
        )
        .groupBy("target", "found")
        .agg(F.count("*").alias("rows"))
    )
    scored = counted.withColumn("similarity", compare.maker_similarity(F.col("target"), F.col("found")))
    return shown(scored.withColumn("alike", F.col("similarity") >= compare.MAKER_THRESHOLD))


_ANY_PAIRS = """SELECT DISTINCT lower(target_manufacturer) AS a, lower(m) AS b
  FROM (SELECT target_manufacturer, unnest([manufacturer, supplier]) AS m FROM candidates) WHERE m IS NOT NULL"""
# Some contracts name no maker, and some requests want none.
_NAMED = "CASE WHEN l_linenumber % 4 <> 0 THEN [manufacturer, supplier] END"
_WANTED = "CASE WHEN l_suppkey % 5 <> 0 THEN target_manufacturer END"


def with_named_makers(candidates: DataFrame) -> DataFrame:
    """Candidates with the list of makers they name; some name none, and some requests want none."""
    named = F.when(F.col("l_linenumber") % 4 != 0, F.array("manufacturer", "supplier"))
    wanted = F.when(F.col("l_suppkey") % 5 != 0, F.col("target_manufacturer"))
    return candidates.withColumns({"makers": named, "wanted": wanted})


@query(
    "manufacturer_any_of",
    with_views(
        f""", {similarity_ctes(_ANY_PAIRS).strip()},
        makers AS (SELECT search_id, contract_id, {_WANTED} AS wanted, unnest({_NAMED}) AS m FROM candidates),
        hits AS (SELECT search_id, contract_id, bool_or(coalesce(best > 0.7, false)) AS hit FROM makers
          LEFT JOIN sim ON lower(wanted) = a AND lower(m) = b WHERE m IS NOT NULL AND wanted IS NOT NULL GROUP BY ALL)
        SELECT c.search_id, c.contract_id, CAST(hit AS VARCHAR) AS maker_match FROM candidates c
        LEFT JOIN hits h ON c.search_id = h.search_id AND c.contract_id = h.contract_id""",
        "candidates",
    ),
)
def manufacturer_any_of(spark, sf_dir):
    """True if any maker named in a contract is alike, null if it names none or none is wanted."""
    rows = with_named_makers(ceiling.candidate_contracts(spark, sf_dir)).select("search_id", "contract_id", "wanted", "makers")
    return shown(matching.makers_alike(rows, "wanted", F.col("makers"), "maker_match"), "search_id", "contract_id", "maker_match")


@query(
    "manufacturer_contains_any",
    with_views(
        f"""SELECT search_id, contract_id, CASE WHEN {_WANTED} IS NOT NULL AND len(list_filter({_NAMED}, lambda m: m IS NOT NULL)) > 0
          THEN CAST(len(list_filter({_NAMED}, lambda m: contains(lower(m), lower({_WANTED})))) > 0 AS VARCHAR) END AS maker_match
        FROM candidates""",
        "candidates",
    ),
)
def manufacturer_contains_any(spark, sf_dir):
    """The same by containment."""
    rows = with_named_makers(ceiling.candidate_contracts(spark, sf_dir))
    hit = compare.maker_contains_any(F.col("wanted"), F.col("makers"))
    return shown(rows.select("search_id", "contract_id", hit.alias("maker_match")))


# ---------------------------------------------------------------- specifications

TARGET_SIZES = ["N мм", "Nмм", ">N мм", "N-60 мм"]
ACTUAL_SIZES = ["N мм", "N mm", "N.0 миллиметров"]


def with_spec_maps(candidates: DataFrame) -> DataFrame:
    """Requested and delivered characteristics as maps, missing values left out."""
    target_size = pick(F.pmod("target_size_mm", F.lit(4)), TARGET_SIZES)
    actual_size = pick(F.pmod("l_partkey", F.lit(3)), ACTUAL_SIZES)
    target = F.create_map(
        F.lit("размер"), F.replace(target_size, F.lit("N"), F.col("target_size_mm").cast("string")),
        F.lit("цена"), F.concat(F.col("target_retail_price").cast("string"), F.lit(" руб")),
        F.lit("производитель"), F.col("target_manufacturer"),
        F.lit("наименование"), F.col("target_name"),
    )
    actual = F.create_map(
        F.lit("размер"), F.replace(actual_size, F.lit("N"), F.col("size_mm").cast("string")),
        F.lit("цена"), F.concat(F.col("retail_price").cast("string"), F.lit(" руб")),
        F.lit("производитель"), F.col("manufacturer"),
        F.lit("наименование"), F.col("object_name"),
        F.lit("количество"), F.concat(F.col("quantity").cast("string"), F.lit(" шт")),
    )
    present = lambda specs: F.map_filter(specs, lambda _, v: v.isNotNull())
    return candidates.withColumns({"target_specs": present(target), "actual_specs": present(actual)})


def model_score() -> Column:
    """The model only scores names here."""
    return F.when(F.col("name") == "наименование", F.col("ai_score") / F.lit(100.0))


def spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir)).select(
        "search_id", "contract_id", "ai_score", "target_specs", "actual_specs"
    )
    return matching.spec_comparison_rows(matching.spec_pairs(contracts), model_score())


add_view(
    "spec_pairs",
    f"""
SELECT search_id, contract_id, ai_score, unnest([
  {{'name': 'размер', 'target': replace({sql_pick('target_size_mm % 4', TARGET_SIZES)}, 'N', target_size_mm::VARCHAR),
    'actual': replace({sql_pick('l_partkey % 3', ACTUAL_SIZES)}, 'N', size_mm::VARCHAR)}},
  {{'name': 'цена', 'target': target_retail_price || ' руб', 'actual': retail_price || ' руб'}},
  {{'name': 'производитель', 'target': coalesce(target_manufacturer, ''), 'actual': coalesce(manufacturer, '')}},
  {{'name': 'наименование', 'target': target_name, 'actual': object_name}},
  {{'name': 'количество', 'target': '', 'actual': quantity || ' шт'}}], recursive := true)
FROM candidates""",
    ["candidates"],
)

_SPEC_ROWS_CTES = f"""
{normalized_ctes('SELECT DISTINCT target AS v FROM spec_pairs UNION SELECT actual FROM spec_pairs').strip()},
paired AS (
  SELECT p.*, t.normalized AS tn, a.normalized AS an, t.number AS t, a.number AS a, t.unit AS tu, a.unit AS au
  FROM spec_pairs p JOIN norm t ON p.target = t.v JOIN norm a ON p.actual = a.v),
{similarity_ctes('''SELECT DISTINCT tn AS a, an AS b FROM paired
  WHERE (t IS NULL OR a IS NULL) AND tn <> '' AND an <> '' ''').strip()},
compared AS (
  SELECT p.*, CASE WHEN t IS NOT NULL AND p.a IS NOT NULL THEN {sql_confidence('t', 'p.a', 'tu', 'au')}
      WHEN tn = an THEN 1.0 ELSE coalesce(best, 0.0) END AS heuristic,
    CASE WHEN t IS NOT NULL AND p.a IS NOT NULL THEN 'numeric' ELSE 'string' END AS method,
    CASE WHEN name = 'наименование' THEN ai_score / 100.0 ELSE 0.0 END::DOUBLE AS ai
  FROM paired p LEFT JOIN sim ON tn = sim.a AND an = sim.b),
spec_rows AS (
  SELECT *, heuristic * 0.7::DOUBLE + ai * 0.3::DOUBLE AS confidence,
    CASE WHEN heuristic * 0.7::DOUBLE + ai * 0.3::DOUBLE >= 0.7::DOUBLE THEN 'MATCH'
         WHEN heuristic * 0.7::DOUBLE + ai * 0.3::DOUBLE >= 0.3::DOUBLE THEN 'UNKNOWN' ELSE 'DIFF' END AS match_status
  FROM compared)
"""

# A second set of similarity tables beside the first, for maker names.
_MAKER_SIM = (
    similarity_ctes(
        """SELECT DISTINCT lower(target_manufacturer) AS a, lower(manufacturer) AS b
        FROM candidates WHERE manufacturer IS NOT NULL"""
    )
    .strip()
    .replace("pairs AS", "maker_pairs AS")
    .replace("FROM pairs", "FROM maker_pairs")
    .replace("oriented", "m_oriented")
    .replace("windows", "m_windows")
    .replace("partials", "m_partials")
    .replace("words", "m_words")
    .replace("rests", "m_rests")
    .replace("sized", "m_sized")
    .replace("ratios", "m_ratios")
    .replace("sim AS", "maker_sim AS")
)


@query(
    "spec_comparison_rows",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}
        SELECT search_id, contract_id, name, target AS target_value, actual AS actual_value, method,
          heuristic AS heuristic_confidence, ai AS ai_confidence, confidence, match_status, 1::BIGINT AS weight
        FROM spec_rows""",
        "spec_pairs",
        "units",
    ),
)
def spec_comparison_rows(spark, sf_dir):
    return shown(
        spec_rows(spark, sf_dir),
        "search_id", "contract_id", "name", "target_value", "actual_value", "method", "heuristic_confidence",
        "ai_confidence", "confidence", "match_status", "weight",
    )


@query(
    "spec_match_summary",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}, {_MAKER_SIM},
        summary AS (SELECT search_id, contract_id, count(*) AS total_specs,
          count(CASE WHEN match_status = 'MATCH' THEN 1 END) AS match_count,
          count(CASE WHEN match_status = 'DIFF' THEN 1 END) AS diff_count,
          count(CASE WHEN match_status = 'UNKNOWN' THEN 1 END) AS unknown_count,
          sum(CAST(round(confidence * 1e9) AS BIGINT)) / count(*) / 1e9 AS avg_confidence,
          count(CASE WHEN match_status = 'MATCH' THEN 1 END) / count(*) * 100.0 AS match_percentage
        FROM spec_rows GROUP BY ALL)
        SELECT s.*, best AS manufacturer_confidence, CAST(best >= 0.7 AS VARCHAR) AS manufacturer_match
        FROM summary s JOIN candidates c ON s.search_id = c.search_id AND s.contract_id = c.contract_id
        LEFT JOIN maker_sim ON lower(target_manufacturer) = a AND lower(manufacturer) = b""",
        "spec_pairs",
        "units",
    ),
)
def spec_match_summary(spark, sf_dir):
    contracts = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir)).select(
        "search_id", "contract_id", "ai_score", "target_manufacturer", "manufacturer", "target_specs", "actual_specs"
    )
    return shown(
        matching.match_specifications(
            contracts, ["search_id", "contract_id"], "target_manufacturer", "manufacturer", model_score()
        )
    )


@query(
    "spec_names",
    with_views(
        "SELECT search_id, name FROM spec_pairs WHERE target <> '' OR actual <> '' GROUP BY ALL", "spec_pairs"
    ),
)
def spec_names(spark, sf_dir):
    """Names of characteristics that occur on either side of a search."""
    maps = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir))
    side = lambda column: maps.select("search_id", F.explode(F.map_keys(column)).alias("name"))
    return shown(matching.spec_names(side("target_specs"), side("actual_specs"), ["search_id"]))


@query(
    "spec_pairs_long",
    with_views(
        "SELECT search_id, contract_id, name, target AS target_value, actual AS actual_value FROM spec_pairs",
        "spec_pairs",
    ),
)
def spec_pairs_long(spark, sf_dir):
    """The full outer join by name over long tables of characteristics."""
    maps = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir))
    side = lambda column: maps.select("search_id", "contract_id", F.explode(column).alias("name", "value"))
    keys = ["search_id", "contract_id"]
    return shown(matching.spec_pairs_long(side("target_specs"), side("actual_specs"), keys))


MANDATORY = ["размер", "производитель"]


@query(
    "mandatory_classification",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}, grouped AS (
          SELECT search_id, contract_id,
            bool_and(match_status = 'MATCH') FILTER (name IN ('размер', 'производитель')) AS all_required,
            coalesce(bool_or(match_status = 'DIFF') FILTER (name IN ('размер', 'производитель')), false) AS conflict,
            count(CASE WHEN match_status = 'MATCH' THEN 1 END) / count(*) AS match_share
          FROM spec_rows GROUP BY ALL),
        typed AS (SELECT *, CASE WHEN all_required THEN 'IDENTICAL' WHEN match_share >= 0.4 AND NOT conflict
          THEN 'HOMOGENEOUS' ELSE 'NO_MATCH' END AS match_type FROM grouped)
        SELECT search_id, contract_id, match_share, match_type, CASE match_type WHEN 'IDENTICAL' THEN 'ACCEPT'
          WHEN 'HOMOGENEOUS' THEN 'REVIEW' ELSE 'REJECT' END AS decision FROM typed""",
        "spec_pairs",
        "units",
    ),
)
def mandatory_classification(spark, sf_dir):
    rows = spec_rows(spark, sf_dir)
    return shown(matching.classify_by_fields(rows, ["search_id", "contract_id"], MANDATORY, 0.4))


# Every third contract has no characteristics at all, every fifth no delivered size.
_BARE = "split_part(contract_id, '-', 2)::INT % 3 = 0"
_SIZELESS = "split_part(contract_id, '-', 3)::INT % 5 = 0"


@query(
    "spec_summary_bare",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}, told AS (SELECT * FROM spec_rows WHERE NOT {_BARE})
        SELECT c.search_id, c.contract_id, count(name) AS total_specs,
          count(CASE WHEN match_status = 'MATCH' THEN 1 END) AS match_count,
          count(CASE WHEN match_status = 'DIFF' THEN 1 END) AS diff_count,
          count(CASE WHEN match_status = 'UNKNOWN' THEN 1 END) AS unknown_count,
          coalesce(sum(CAST(round(confidence * 1e9) AS BIGINT)) / nullif(count(name), 0) / 1e9, 0) AS avg_confidence,
          coalesce(count(CASE WHEN match_status = 'MATCH' THEN 1 END) / nullif(count(name), 0) * 100.0, 0)
            AS match_percentage
        FROM candidates c LEFT JOIN told t ON c.search_id = t.search_id AND c.contract_id = t.contract_id
        GROUP BY ALL""",
        "spec_pairs",
        "units",
    ),
)
def spec_summary_bare(spark, sf_dir):
    """Summaries where some contracts have no characteristics: theirs are zeros."""
    bare = F.split_part("contract_id", F.lit("-"), F.lit(2)).cast("int") % 3 == 0
    nothing = F.create_map().cast("map<string,string>")
    contracts = with_spec_maps(ceiling.candidate_contracts(spark, sf_dir))
    for side in ("target_specs", "actual_specs"):
        contracts = contracts.withColumn(side, F.when(bare, nothing).otherwise(F.col(side)))
    pairs = matching.spec_pairs(
        contracts.select("search_id", "contract_id", "ai_score", "target_specs", "actual_specs"), keep_empty=True
    )
    return shown(matching.spec_summary(matching.spec_comparison_rows(pairs, model_score()), ["search_id", "contract_id"]))


@query(
    "mandatory_missing",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}, told AS (SELECT * FROM spec_rows WHERE NOT ({_SIZELESS} AND name = 'размер')),
        grouped AS (
          SELECT search_id, contract_id, list_sort(list(DISTINCT name) FILTER (name IN ('размер', 'производитель')
              AND match_status = 'MATCH')) = ['производитель', 'размер'] AS all_required,
            count(*) FILTER (name IN ('размер', 'производитель') AND match_status = 'DIFF') AS conflicts,
            count(CASE WHEN match_status = 'MATCH' THEN 1 END) / count(*) AS match_share
          FROM told GROUP BY ALL)
        SELECT search_id, contract_id, match_share, CASE WHEN all_required THEN 'IDENTICAL'
          WHEN match_share >= 0.4 AND conflicts = 0 THEN 'HOMOGENEOUS' ELSE 'NO_MATCH' END AS match_type,
          CASE WHEN all_required THEN 'ACCEPT' WHEN match_share >= 0.4 AND conflicts = 0 THEN 'REVIEW' ELSE 'REJECT' END
            AS decision
        FROM grouped""",
        "spec_pairs",
        "units",
    ),
)
def mandatory_missing(spark, sf_dir):
    """Classes where some contracts lack a mandatory field: those are never identical."""
    sizeless = F.split_part("contract_id", F.lit("-"), F.lit(3)).cast("int") % 5 == 0
    rows = spec_rows(spark, sf_dir).where(~(sizeless & (F.col("name") == "размер")))
    return shown(matching.classify_by_fields(rows, ["search_id", "contract_id"], MANDATORY, 0.4))


@query(
    "ceiling_from_comparison",
    with_views(
        f""", {_SPEC_ROWS_CTES.strip()}, {_MAKER_SIM},
        summary AS (SELECT r.search_id, r.contract_id,
          CAST(round(count(CASE WHEN match_status = 'MATCH' THEN 1 END) / count(*) * 100) AS INTEGER) AS ai_score
          FROM spec_rows r JOIN fresh f ON r.search_id = f.search_id AND r.contract_id = f.contract_id GROUP BY ALL),
        judged AS (SELECT f.search_id, f.contract_id, f.sign_date, f.unit_price, s.ai_score, best >= 0.7 AS manufacturer_match,
            CASE WHEN s.ai_score >= 90 THEN 'IDENTICAL' WHEN s.ai_score >= 70 THEN 'HOMOGENEOUS' ELSE 'NO_MATCH' END AS match_type
          FROM fresh f JOIN summary s ON f.search_id = s.search_id AND f.contract_id = s.contract_id
          LEFT JOIN maker_sim ON lower(target_manufacturer) = a AND lower(manufacturer) = b),
        best_three AS (SELECT *, 10.0::DOUBLE * CASE match_type WHEN 'IDENTICAL' THEN 3 WHEN 'HOMOGENEOUS' THEN 2 ELSE 1 END
            + ai_score * 0.5::DOUBLE + CASE WHEN manufacturer_match THEN 10 ELSE 0 END
            + CASE WHEN year(sign_date) >= 2000 THEN 10 WHEN year(sign_date) >= 1998 THEN 5 ELSE 0 END
            + CASE WHEN unit_price IS NOT NULL THEN 5 ELSE 0 END AS selection_score FROM judged
          QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY selection_score DESC, contract_id) <= 3),
        ranked AS (SELECT *, CAST(unit_price AS DOUBLE) AS p, row_number() OVER (PARTITION BY search_id ORDER BY unit_price) - 1 AS i,
          count(*) OVER (PARTITION BY search_id) AS n FROM best_three),
        bounds AS (SELECT search_id, max(n) AS n, max(CASE WHEN i = n // 4 THEN p END) AS q1,
          max(CASE WHEN i = (3 * n) // 4 THEN p END) AS q3 FROM ranked GROUP BY search_id),
        kept AS (SELECT r.* FROM ranked r JOIN bounds b ON r.search_id = b.search_id
          WHERE b.n < 3 OR p BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE),
        ends AS (SELECT search_id, CAST(sum(unit_price) AS DOUBLE) / count(*) AS ceiling FROM kept GROUP BY search_id),
        counts AS (SELECT search_id, count(*) AS processed FROM fresh GROUP BY search_id)
        SELECT q.id AS search_id, coalesce(processed, 0) AS processed, ceiling,
          CASE WHEN processed IS NULL THEN 'ERROR' ELSE 'DONE' END AS status
        FROM requests q LEFT JOIN counts c ON q.id = c.search_id LEFT JOIN ends e ON q.id = e.search_id""",
        "fresh",
        "spec_pairs",
        "units",
    ),
)
def ceiling_from_comparison(spark, sf_dir):
    """The whole path: candidates, the freshest of them, their comparison, the three best by its score, the ceiling."""
    fresh = materialized(with_spec_maps(ceiling.freshest_contracts(spark, sf_dir)), "fresh")
    keys = ["search_id", "contract_id"]
    summary = matching.match_specifications(fresh, keys, "target_manufacturer", "manufacturer", model_score())
    judged = summary.select(
        *keys, F.round("match_percentage").cast("int").alias("ai_score"), "manufacturer_match"
    ).withColumn("match_type", scoring.type_of_score(F.col("ai_score")))
    year = F.year("sign_date")
    score = scoring.selection_score(
        F.col("match_type"), F.col("ai_score"), F.col("manufacturer_match"), year, F.col("unit_price"), tables.AS_OF_YEAR
    )
    rows = fresh.select(*keys, "sign_date", "unit_price").join(judged, keys).withColumn("selection_score", score)
    found = prices.small_group_ceiling(ceiling.best(rows), ["search_id"]).select("search_id", "ceiling")
    counted = fresh.groupBy("search_id").agg(F.count("*").alias("processed"))
    searches = joins.valid_requests(tables.requests(spark, sf_dir)).select(F.col("id").alias("search_id"))
    whole = searches.join(counted, "search_id", "left").join(found, "search_id", "left").fillna(0, ["processed"])
    status = scoring.final_status(F.lit(None).cast("string"), F.col("processed"))
    return shown(whole.select("search_id", "processed", "ceiling", status.alias("status")))

"""Queries over the scalar functions: dates, money, labels, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.functions import compare, dates, labels, normalize, prices, scoring, text
from pricewell.plans.characteristics import pick, sql_pick
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.plans.sql_views import with_views
from pricewell.sources import tables

query = Registry()

# ---------------------------------------------------------------- dates

_DATE_TEXT_SQL = """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN 3 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN 4 THEN 'от ' || strftime(o_orderdate, '%d.%m.%Y') || ' г.'
  WHEN 5 THEN 'invalid' WHEN 6 THEN '' WHEN 7 THEN '31.02.2024'
  ELSE strftime(o_orderdate, '%-d.%-m.%Y') || ' ' END AS t FROM orders"""


def date_texts(spark, sf_dir) -> DataFrame:
    """Order dates as texts in nine shapes, some unreadable."""
    order = tables.table(spark, sf_dir, "orders")
    date = F.col("o_orderdate")
    shapes = [
        F.date_format(date, "dd.MM.yyyy"), F.date_format(date, "yyyy-MM-dd"), F.date_format(date, "dd/MM/yyyy"),
        F.date_format(date, "yyyy.MM.dd"), F.concat(F.lit("от "), F.date_format(date, "dd.MM.yyyy"), F.lit(" г.")),
        F.lit("invalid"), F.lit(""), F.lit("31.02.2024"), F.concat(F.date_format(date, "d.M.yyyy"), F.lit(" ")),
    ]
    shape = F.col("o_orderkey") % len(shapes)
    chosen = F.when(shape == 0, shapes[0])
    for i, value in enumerate(shapes[1:], start=1):
        chosen = chosen.when(shape == i, value)
    return order.select("o_orderkey", chosen.alias("t"))


# A whole-text format allows no blanks around the date, which try_strptime would skip.
_WHOLE = "CASE WHEN t = trim(t) THEN t END"
_PAGE = "try_strptime(trim(t), ['%d.%m.%Y', '%Y-%m-%d', '%d/%m/%Y'])"


@query(
    "lenient_dates",
    rf"""WITH texts AS ({_DATE_TEXT_SQL}), found AS (SELECT *,
        nullif(regexp_extract(t, '(\d{{2}}\.\d{{2}}\.\d{{4}})', 1), '') AS dotted,
        nullif(regexp_extract(t, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') AS dashed,
        nullif(regexp_extract(t, '(\d{{2}}/\d{{2}}/\d{{4}})', 1), '') AS slashed FROM texts)
    SELECT o_orderkey, t, coalesce(CAST(coalesce(
        try_strptime({_WHOLE}, '%d.%m.%Y'), try_strptime({_WHOLE}, '%Y-%m-%d'), try_strptime({_WHOLE}, '%d/%m/%Y'),
        try_strptime({_WHOLE}, '%Y.%m.%d'), try_strptime(dotted, '%d.%m.%Y'), try_strptime(dashed, '%Y-%m-%d'),
        try_strptime(slashed, '%d/%m/%Y'))::DATE AS VARCHAR), '0001-01-01') AS sort_date,
      CAST({_PAGE}::DATE AS VARCHAR) AS page_date, coalesce(year({_PAGE}), 0) AS page_year,
      coalesce(dotted, dashed, slashed) AS as_written, substring(t, 1, 4) AS prefix
    FROM found""",
)
def lenient_dates(spark, sf_dir):
    """Sort date (far past if unreadable), page date (null if unreadable), year and raw date text."""
    t = F.col("t")
    return shown(
        date_texts(spark, sf_dir).select(
            "o_orderkey",
            "t",
            dates.lenient_date(t).alias("sort_date"),
            dates.page_date(t).alias("page_date"),
            F.coalesce(dates.year_of_text(t), F.lit(0)).alias("page_year"),
            dates.embedded_date_text(t).alias("as_written"),
            dates.year_prefix(t).alias("prefix"),
        )
    )


@query(
    "iso_timestamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS written,
      strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS read_back FROM events""",
)
def iso_timestamps(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    written = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return shown(
        events.select("event_id", "ts", written.alias("written"), dates.iso_timestamp(written).alias("read_back"))
    )


# ---------------------------------------------------------------- prices

_PRICE_SHAPES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, whole, CASE l_partkey % 7
  WHEN 0 THEN (whole // 1000) || ' ' || lpad((whole % 1000)::VARCHAR, 3, '0') || ',' || frac || ' руб.'
  WHEN 1 THEN (whole // 1000) || ' ' || lpad((whole % 1000)::VARCHAR, 3, '0') || '.' || frac || ' руб.'
  WHEN 2 THEN (whole // 1000) || ',' || lpad((whole % 1000)::VARCHAR, 3, '0') || '.' || frac
  WHEN 3 THEN (whole // 1000) || chr(160) || lpad((whole % 1000)::VARCHAR, 3, '0') || ',' || frac || ' ₽'
  WHEN 4 THEN '' WHEN 5 THEN 'Цена: ' || whole || ' EUR' ELSE whole || ',' || frac || ' USD' END AS t
  FROM (SELECT *, cents // 100 AS whole, lpad((cents % 100)::VARCHAR, 2, '0') AS frac
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem))"""


def price_texts(spark, sf_dir) -> DataFrame:
    """Line totals as texts in seven shapes."""
    line = tables.table(spark, sf_dir, "lineitem").withColumn("cents", tables.cents(F.col("l_extendedprice")))
    sized = line.withColumns(
        {
            "whole": F.expr("cents div 100"),
            "frac": F.lpad((F.col("cents") % 100).cast("string"), 2, "0"),
        }
    )
    head, tail = F.expr("whole div 1000").cast("string"), F.lpad((F.col("whole") % 1000).cast("string"), 3, "0")
    shapes = [
        F.concat(head, F.lit(" "), tail, F.lit(","), "frac", F.lit(" руб.")),
        F.concat(head, F.lit(" "), tail, F.lit("."), "frac", F.lit(" руб.")),
        F.concat(head, F.lit(","), tail, F.lit("."), "frac"),
        F.concat(head, F.lit(" "), tail, F.lit(","), "frac", F.lit(" ₽")),
        F.lit(""),
        F.concat(F.lit("Цена: "), F.col("whole").cast("string"), F.lit(" EUR")),
    ]
    shape = F.col("l_partkey") % 7
    chosen = F.when(shape == 0, shapes[0])
    for i, value in enumerate(shapes[1:], start=1):
        chosen = chosen.when(shape == i, value)
    last = F.concat(F.col("whole").cast("string"), F.lit(","), "frac", F.lit(" USD"))
    return sized.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", chosen.otherwise(last).alias("t"))


_LINE_KEYS = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey"


@query(
    "price_text_card",
    rf"""WITH texts AS ({_PRICE_SHAPES_SQL}) SELECT {_LINE_KEYS}, t,
      try_cast(replace(replace(regexp_extract(t, '([\d\s\x{{A0}},.]+)', 1), ' ', ''), ',', '.') AS DOUBLE) AS price
    FROM texts""",
)
def price_text_card(spark, sf_dir):
    return shown(price_texts(spark, sf_dir).withColumn("price", prices.card_price(F.col("t"))))


@query(
    "price_text_page",
    rf"""WITH texts AS ({_PRICE_SHAPES_SQL}) SELECT {_LINE_KEYS}, t,
      try_cast(replace(regexp_replace(t, '[^\d,]', '', 'g'), ',', '.') AS DOUBLE) AS price,
      CASE WHEN t LIKE '%USD%' THEN 'USD' WHEN t LIKE '%EUR%' THEN 'EUR' ELSE 'RUB' END AS currency FROM texts""",
)
def price_text_page(spark, sf_dir):
    priced = price_texts(spark, sf_dir).withColumn("price", prices.page_price(F.col("t")))
    return shown(priced.withColumn("currency", text.currency_of(F.col("t"))))


@query(
    "money_format",
    with_views(
        """SELECT contract_id, format('{:,.2f}', total_price::DOUBLE) AS total, strftime(sign_date, '%d.%m.%Y') AS signed,
          CASE WHEN manufacturer IS NULL THEN 'Не указано' WHEN manufacturer = 'Brand#7' THEN 'Да' ELSE 'Нет' END
            AS wanted_maker,
          CASE WHEN year(sign_date) >= 2000 THEN 'Да' ELSE 'Нет' END AS recent,
          CASE WHEN quantity % 5 > 0 THEN quantity / (quantity % 5) * 100.0 ELSE 0.0 END AS percent,
          10 + CAST(floor(l_linenumber / 7::DOUBLE * 80) AS BIGINT) AS step_percent FROM contracts""",
        "contracts",
    ),
)
def money_format(spark, sf_dir):
    rows = tables.contracts(spark, sf_dir)
    return shown(
        rows.select(
            "contract_id",
            text.money_text(F.col("total_price")).alias("total"),
            dates.date_text(F.col("sign_date")).alias("signed"),
            labels.yes_no_unspecified(F.col("manufacturer") == "Brand#7").alias("wanted_maker"),
            labels.yes_no(F.year("sign_date") >= 2000).alias("recent"),
            text.percent(F.col("quantity"), F.col("quantity") % 5).alias("percent"),
            text.step_percent(F.col("l_linenumber"), F.lit(7)).alias("step_percent"),
        )
    )


# ---------------------------------------------------------------- texts

NAME_HEADS = ["Бумага ", "КОМПЬЮТЕР ", "Моноблок ", "Стул "]


@query(
    "category_keywords",
    f"""WITH named AS (SELECT {sql_pick('p_partkey % 4', NAME_HEADS)} || p_name AS name FROM part)
    SELECT name, CASE WHEN contains(lower(name), 'бумаг') THEN 'paper' WHEN contains(lower(name), 'комп')
      OR contains(lower(name), 'моноблок') THEN 'pc' ELSE 'generic' END AS category, count(*) AS parts
    FROM named GROUP BY ALL""",
)
def category_keywords(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    head = pick(F.pmod("p_partkey", F.lit(4)), NAME_HEADS)
    counted = part.select(F.concat(head, "p_name").alias("name")).groupBy("name").agg(F.count("*").alias("parts"))
    return shown(counted.withColumn("category", text.category_of(F.col("name"))))


LEGAL_SHAPES = ["ООО N", "N Inc.", "LLC N Company", "GmbH N Corp", " n ", "N"]
_FORM = r"(?:ооо|llc|gmbh|inc|corp|company)\.?"


@query(
    "maker_names",
    rf"""WITH named AS (SELECT s_suppkey, replace({sql_pick('s_suppkey % 6', LEGAL_SHAPES)}, 'N', s_name) AS name
      FROM supplier)
    SELECT s_suppkey, name, lower(trim(name)) AS plain,
      trim(regexp_replace(regexp_replace(lower(trim(name)), '^({_FORM}\s+)+', ''), '(\s+{_FORM})+$', '')) AS maker
    FROM named""",
)
def maker_names(spark, sf_dir):
    supplier = tables.table(spark, sf_dir, "supplier")
    name = F.replace(pick(F.pmod("s_suppkey", F.lit(6)), LEGAL_SHAPES), F.lit("N"), F.col("s_name"))
    named = supplier.select("s_suppkey", name.alias("name"))
    return shown(
        named.withColumns(
            {"plain": text.normalize_text(F.col("name")), "maker": text.strip_legal_form(F.col("name"))}
        )
    )


LAW_LABELS = ["44-ФЗ", "223-ФЗ", "94-ФЗ", "615-ПП"]
STATUS_LABELS = ["Исполнение завершено", "Исполняется", "Расторгнут", "Черновик"]


@query(
    "label_codes",
    f"""WITH given AS (SELECT {sql_pick('o_orderkey % 4', LAW_LABELS)} AS law,
        {sql_pick('o_custkey % 4', STATUS_LABELS)} AS s1, {sql_pick('o_orderkey % 3', STATUS_LABELS)} AS s2 FROM orders)
    SELECT law, s1, s2, CASE law WHEN '223-ФЗ' THEN 'fz223' WHEN '94-ФЗ' THEN 'fz94' ELSE 'fz44' END AS law_code,
      concat_ws(',', CASE s1 WHEN 'Исполнение завершено' THEN 'EXECUTION_COMPLETED' WHEN 'Исполняется'
          THEN 'EXECUTION_IN_PROGRESS' WHEN 'Расторгнут' THEN 'TERMINATED' END,
        CASE s2 WHEN 'Исполнение завершено' THEN 'EXECUTION_COMPLETED' WHEN 'Исполняется'
          THEN 'EXECUTION_IN_PROGRESS' WHEN 'Расторгнут' THEN 'TERMINATED' END) AS status_codes, count(*) AS orders
    FROM given GROUP BY ALL""",
)
def label_codes(spark, sf_dir):
    order = tables.table(spark, sf_dir, "orders")
    given = order.select(
        pick(F.pmod("o_orderkey", F.lit(4)), LAW_LABELS).alias("law"),
        pick(F.pmod("o_custkey", F.lit(4)), STATUS_LABELS).alias("s1"),
        pick(F.pmod("o_orderkey", F.lit(3)), STATUS_LABELS).alias("s2"),
    )
    counted = given.groupBy("law", "s1", "s2").agg(F.count("*").alias("orders"))
    return shown(
        counted.withColumns(
            {
                "law_code": labels.law_code(F.col("law")),
                "status_codes": F.array_join(labels.status_codes(F.array("s1", "s2")), ","),
            }
        )
    )


REQUIREMENTS = ["N ± 2 мм", "N±0,5 г/м2", "N мм", "не менее N"]
SPEC_NAMES = ["Плотность", " Граммаж", "CIE", "Белизна", "Цвет"]


@query(
    "stated_tolerances",
    rf"""WITH asked AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
        replace({sql_pick('l_partkey % 4', REQUIREMENTS)}, 'N', CAST(l_quantity AS BIGINT)::VARCHAR) AS requirement,
        lower(trim({sql_pick('l_suppkey % 5', SPEC_NAMES)})) AS n, l_quantity AS target,
        l_quantity + (l_suppkey % 4) AS actual FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, requirement,
      CASE n WHEN 'граммаж' THEN 'плотность' WHEN 'cie' THEN 'белизна' ELSE n END AS name,
      CAST(abs(target - actual) <= coalesce(try_cast(replace(nullif(regexp_extract(requirement, '±\s*([\d.,]+)', 1),
        ''), ',', '.') AS DOUBLE), 0.0) AS VARCHAR) AS matches FROM asked""",
)
def stated_tolerances(spark, sf_dir):
    """Exact match of numbers unless the requirement states a tolerance; synonyms of names unified."""
    line = tables.table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    asked = line.withColumn(
        "requirement", F.replace(pick(F.pmod("l_partkey", F.lit(4)), REQUIREMENTS), F.lit("N"), quantity)
    )
    matches = compare.within_stated_tolerance(
        F.col("l_quantity"),
        F.col("l_quantity") + F.col("l_suppkey") % 4,
        compare.stated_tolerance(F.col("requirement")),
    )
    name = normalize.canonical_spec_name(pick(F.pmod("l_suppkey", F.lit(5)), SPEC_NAMES))
    return shown(
        asked.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "requirement", name.alias("name"),
            matches.alias("matches"),
        )
    )


MODEL_TYPES = ["IDENTICAL", "Identical", "HOMOGENEOUS", "Homogeneous", "Partial", "NO_MATCH"]


@query(
    "model_match_types",
    f"""WITH given AS (SELECT {sql_pick('l_partkey % 6', MODEL_TYPES)} AS match_type, (l_partkey * 7 + l_suppkey * 13)
        % 101 AS score, l_quantity / 50 AS similarity FROM lineitem)
    SELECT match_type, CASE WHEN match_type IN ('IDENTICAL', 'HOMOGENEOUS', 'NO_MATCH') THEN match_type
        ELSE 'NO_MATCH' END AS stored,
      CASE WHEN upper(match_type) IN ('IDENTICAL', 'HOMOGENEOUS') THEN upper(match_type) ELSE 'NO_MATCH' END AS mapped,
      count(*) AS answers, max(similarity * 0.4::DOUBLE + score / 100.0 * 0.6::DOUBLE) AS best_overall
    FROM given GROUP BY match_type""",
)
def model_match_types(spark, sf_dir):
    line = tables.table(spark, sf_dir, "lineitem")
    given = line.select(
        pick(F.pmod("l_partkey", F.lit(6)), MODEL_TYPES).alias("match_type"),
        scoring.overall_score(
            F.col("l_quantity") / 50, F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey") * 13, F.lit(101))
        ).alias("overall"),
    )
    counted = given.groupBy("match_type").agg(F.count("*").alias("answers"), F.max("overall").alias("best_overall"))
    return shown(
        counted.withColumns(
            {
                "stored": scoring.known_match_type(F.col("match_type")),
                "mapped": scoring.known_match_type(F.col("match_type"), mapped=True),
            }
        )
    )

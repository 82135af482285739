"""Page queries: over the raw pages, and over contract pages written out from the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.functions import prices as price_functions
from pricewell.functions import scoring
from pricewell.functions.dates import lenient_date
from pricewell.operators import joins, prices, topk
from pricewell.plans.output import shown
from pricewell.plans.registry import Registry
from pricewell.session import materialized, scratch_dir
from pricewell.sources import cards, contract_pages, pages, quarantine, tables
from pricewell.sources.tables import PAGE_HOST

query = Registry()

THRESHOLD_YEAR = 2000


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.spread(tables.table(spark, sf_dir, "pages"), "page_id")


# ---------------------------------------------------------------- raw pages


_START_TAG = "<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
_ENTITY_TEXT = "t"
for _entity, _plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    _ENTITY_TEXT = f"replace({_ENTITY_TEXT}, '{_entity}', '{_plain}')"


@query(
    "page_elements",
    rf"""WITH plain AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
        '<(script|style)([^>]*)>.*?</(script|style)>', '<\1\2></\3>', 'gs') AS html FROM pages),
      found AS (SELECT page_id, unnest(regexp_extract_all(html, '{_START_TAG}')) AS e,
        unnest(range(len(regexp_extract_all(html, '{_START_TAG}')))) AS idx FROM plain),
      parts AS (SELECT page_id, idx, lower(regexp_extract(e, '{_START_TAG}', 1)) AS tag,
        regexp_extract(e, '{_START_TAG}', 2) AS attributes FROM found)
    SELECT page_id, idx, tag, array_to_string(list_filter(string_split(regexp_extract(attributes, 'class="([^"]*)"', 1), ' '),
        lambda c: c <> ''), ' ') AS classes,
      CASE WHEN contains(attributes, ' id="') THEN regexp_extract(attributes, ' id="([^"]*)"', 1) END AS id,
      CASE WHEN contains(attributes, ' href="') THEN regexp_extract(attributes, ' href="([^"]*)"', 1) END AS href FROM parts""",
)
def page_elements(spark, sf_dir):
    """Every element of every page, its classes, id and link target."""
    rows = pages.page_elements(raw_pages(spark, sf_dir), ["page_id"])
    return shown(rows.withColumn("classes", F.trim("classes")), "page_id", "idx", "tag", "classes", "id", "href")


@query(
    "paragraph_texts",
    f"""SELECT page_id, count(*) AS paragraphs, sum(length(t))::BIGINT AS chars FROM (
        SELECT page_id, trim({_ENTITY_TEXT}, ' ' || chr(10)) AS t FROM (
          SELECT page_id, unnest(regexp_extract_all(html, '<p>([^<]*)</p>', 1)) AS t FROM pages))
      WHERE t <> '' GROUP BY page_id""",
)
def paragraph_texts(spark, sf_dir):
    """Paragraphs without markup inside, and how long their own texts are."""
    rows = pages.page_elements(raw_pages(spark, sf_dir), ["page_id"])
    own = rows.where("tag = 'p' AND classes = '  ' AND last = idx AND text <> ''")
    return shown(own.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("chars")))


@query(
    "page_links_relative",
    """WITH links AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)([^?#]*/)?', 1) AS host,
      coalesce(nullif(regexp_extract(url, '^(https?://[^/?#]+)([^?#]*/)?', 2), ''), '/') AS folder,
      unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, '../x/./' || href AS href, host || regexp_replace(folder, '[^/]+/$', '') || 'x/' || href AS url,
      count(*) AS links FROM links WHERE href <> '' GROUP BY ALL""",
)
def page_links_relative(spark, sf_dir):
    """Links as if they were given relative to a folder beside the page's."""
    given = raw_pages(spark, sf_dir).withColumnRenamed("url", "page_url")
    links = pages.page_links(given, ["page_id", "page_url"], F.col("page_url")).where("href rlike '^/.'")
    moved = links.withColumn("href", F.concat(F.lit("../x/./"), F.expr("substring(href, 2)")))
    resolved = moved.withColumn("url", pages.absolute_url(F.col("href"), F.col("page_url")))
    return resolved.groupBy("page_id", "href", "url").agg(F.count("*").alias("links"))


@query(
    "page_tags",
    """SELECT page_id, lower(tag) AS tag, count(*) AS elements
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    GROUP BY ALL""",
)
def page_tags(spark, sf_dir):
    """Elements of each page by tag."""
    rows = pages.shredded(raw_pages(spark, sf_dir), ["page_id"])
    tags = rows.select("page_id", F.explode(F.transform("elements", lambda e: e["tag"])).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


# Entities in the sample's headings; some have lost their semicolon where a title was cut.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&quot": '"', "&#x27;": "''", "&amp;": "&", "&amp": "&"}


def _sql_text(tag: str) -> str:
    text = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's')"
    for entity, plain in ENTITIES.items():
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


@query(
    "page_headings",
    f"""SELECT page_id, coalesce(nullif(trim({_sql_text('h1')}, ' ' || chr(10)), ''),
      trim({_sql_text('title')}, ' ' || chr(10))) AS heading FROM pages""",
)
def page_headings(spark, sf_dir):
    """The heading of each page, or its title where it has none: the first selector with a text wins."""
    chosen = [pages.Selector("h1"), pages.Selector("title")]
    rows = pages.selected(raw_pages(spark, sf_dir), ["page_id"], chosen)
    text = lambda h: F.nullif(pages.text_of(h, F.col("texts")), F.lit(""))
    heading = cards.first_value(F.col("hits"), range(len(chosen)), text)
    return rows.select("page_id", heading.alias("heading"))


@query(
    "page_links",
    """SELECT page_id, unnest(range(len(hrefs))) AS position, unnest(hrefs) AS href,
      regexp_extract(url, '^(https?://[^/?#]+)', 1) || unnest(hrefs) AS url
    FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)""",
)
def page_links(spark, sf_dir):
    given = raw_pages(spark, sf_dir).withColumnRenamed("url", "page_url")
    links = pages.page_links(given, ["page_id", "page_url"], F.col("page_url"))
    return shown(links, "page_id", "position", "href", "url")


@query(
    "page_samples",
    """SELECT page_id, substring(html, 1, 5000) AS html_sample, length(html) AS html_length,
      coalesce(regexp_extract(url, 'reestrNumber=([^&]+)', 1), '') AS reestr_number FROM pages""",
)
def page_samples(spark, sf_dir):
    """The page sample kept for debugging: the first 5000 characters and the full length."""
    number = contract_pages.registry_number(F.col("url"))
    sample = F.substring("html", 1, contract_pages.SAMPLE_CHARS)
    return shown(
        tables.table(spark, sf_dir, "pages").select(
            "page_id",
            sample.alias("html_sample"),
            F.length("html").cast("bigint").alias("html_length"),
            F.coalesce(number, F.lit("")).alias("reestr_number"),
        )
    )


# ---------------------------------------------------------------- search result pages


def written_price(whole_cents: Column) -> Column:
    """Cents as ``1 234,56``."""
    whole = F.floor(whole_cents / 100)
    return F.concat(
        F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","),
        F.lpad((whole_cents % 100).cast("string"), 2, "0"),
    )


def tag(name: str, css: str, *parts: Column | str) -> Column:
    """An HTML element around some texts."""
    head, *rest = name.split(" ", 1)
    more = f" {rest[0]}" if rest else ""
    given = [F.lit(p) if isinstance(p, str) else p for p in parts]
    css_text = f' class="{css}"' if css else ""
    return F.concat(F.lit(f"<{head}{css_text}{more}>"), *given, F.lit(f"</{head}>"))


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = tables.table(spark, sf_dir, "orders")
    customer = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = order.join(customer, order.o_custkey == customer.c_custkey)
    return tables.spread_pages(joined, order, "o_orderkey").withColumns(
        {
            "key": F.col("o_orderkey").cast("string"),
            "cents": tables.cents(F.col("o_totalprice")),
            "dotted": F.date_format("o_orderdate", "dd.MM.yyyy"),
            "dashed": F.date_format("o_orderdate", "yyyy-MM-dd"),
        }
    )


def result_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result page per order: its card, a card with only a date and an empty one, in two markups."""
    key = F.col("key")
    price = written_price(F.col("cents"))
    link = F.concat(F.lit('<a class="registry-entry__header-mid__number" href="/epz/contract/common-info.html?reestrNumber='), key, F.lit('">№ '), key, F.lit("</a>"))
    block = "search-registry-entry-block box"
    first = F.concat(
        tag("div", "search-results__total", "Найдено: ", written_price(F.col("o_orderkey") * 100 + 7 * 100000), " записей, 3 страницы"),
        tag("div", block, tag("div", "head", link, tag("div", "registry-entry__header-mid__title", " Исполнение завершено ")),
            tag("div", "price-block__value", price, " ₽"), tag("div", "data-block__value", "Размещено ", F.col("dotted")),
            tag("div", "registry-entry__body-href", tag("a href='#'", "", F.col("c_name")))),
        tag("div", block, tag("time", "", F.col("dashed")), tag("div", "amount", "по запросу"), tag("span", "amount-value", price)),
        tag("div", block, tag("span", "contract-status", "Черновик")),
    )
    second = F.concat(
        tag("span", "total-count", "найдено ", key, " записей"),
        tag("div", "contract-card", tag("span", "contract-number", " ", key, "\n"), tag("span", "contract-date", F.col("dashed")),
            tag("span", "contract-price", price, " руб."), F.concat(F.lit('<a class="card-link" href="https://other.example.org/'), key, F.lit('">Открыть</a>')),
            tag("span", "organization", F.col("c_name"), " &amp; Co"), tag("div", "status-badge", "Исполняется")),
    )
    body = F.when(F.col("o_orderkey") % 2 == 0, first).otherwise(second)
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Поиск</title></head><body>"), body, F.lit("<br></body></html>"))
    return orders_with_customer(spark, sf_dir).select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


_ORDER_CTE = """WITH o AS (SELECT o_orderkey AS page_id, o_orderkey::VARCHAR AS key, c_name,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, strftime(o_orderdate, '%d.%m.%Y') AS dotted,
  strftime(o_orderdate, '%Y-%m-%d') AS dashed, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "search_cards",
    _ORDER_CTE
    + f"""
    SELECT page_id, 0::BIGINT AS card_no, '№ ' || key AS registry_no, dotted AS date, cents / 100.0 AS price,
      '{PAGE_HOST}/epz/contract/common-info.html?reestrNumber=' || key AS url, c_name AS customer,
      'Исполнение завершено' AS status FROM o WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 1, '', dashed, cents / 100.0, '', '', '' FROM o WHERE page_id % 2 = 0
    UNION ALL SELECT page_id, 0, key, dashed, cents / 100.0, 'https://other.example.org/' || key, c_name || ' & Co',
      'Исполняется' FROM o WHERE page_id % 2 = 1""",
)
def search_cards(spark, sf_dir):
    return shown(cards.search_cards(result_pages(spark, sf_dir), ["page_id"], PAGE_HOST))


@query(
    "site_totals",
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey ELSE o_orderkey + 700000 // 100 END
      AS site_total FROM orders""",
)
def site_totals(spark, sf_dir):
    """The largest number of the total line; blanks inside it are allowed."""
    return shown(cards.site_totals(result_pages(spark, sf_dir), ["page_id"]))


# ---------------------------------------------------------------- contract pages

ITEM_NAMES = ["Бумага офисная", "Моноблок учебный с клавиатурой", "Стул"]


def contract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit(f"{PAGE_HOST}/epz/contract/common-info.html?reestrNumber="), "key", F.lit("&tab=1"))
    return orders_with_customer(spark, sf_dir).withColumn("url", url)


def common_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of common facts per order; some facts are left out by rule."""
    key = F.col("o_orderkey")
    row = lambda label, value: tag("tr", "", tag("td", "label", label), tag("td", "", value))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("Исполнение завершено")).otherwise(F.lit("Исполняется"))
    parts = [
        row("Дата заключения контракта", F.when(key % 11 == 0, F.lit("не определена")).otherwise(F.col("dotted"))),
        F.when(key % 3 != 0, row("Заказчик (сокращенно)", F.col("c_name"))).otherwise(F.lit("")),
        row("Поставщик", F.concat(F.lit("Supplier "), "key")),
        F.when(key % 5 != 0, row("ЦЕНА КОНТРАКТА", F.concat(written_price(F.col("cents")), F.lit(" ₽")))).otherwise(F.lit("")),
        F.when(key % 4 == 0, row("Валюта", F.lit("USD"))).otherwise(F.lit("")),
        row("Статус исполнения", status),
    ]
    html = F.concat(F.lit('<html><body><h1>Сведения</h1><table class="facts">'), *parts, F.lit("</table></body></html>"))
    return contract_urls(spark, sf_dir).select("o_orderkey", "url", html.alias("html"))


def payment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one to three line items per order; every seventh order has none."""
    item = lambda i: tag(
        "tr", "",
        tag("td", "", i.cast("string")),
        tag("td", "", F.get(F.array(*[F.lit(n) for n in ITEM_NAMES]), (i - 1).cast("int")), " ", F.col("key")),
        tag("td", "", F.concat(F.lit("OKPD2: 17.12."), i.cast("string"), F.lit(" KTRU: 17.12.14.110-0000000"), i.cast("string"))),
        tag("td", "", "шт"),
        tag("td", "", (i * 2).cast("string"), ",0"),
        tag("td", "", written_price(F.col("cents") + i)),
        tag("td", "", written_price((F.col("cents") + i) * i * 2), " ₽"),
    )
    items = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int")), item), "")
    heads = tag("tr", "", *[tag("th", "", h) for h in ("№", "Наименование", "Код", "Ед.")])
    html = F.concat(
        F.lit("<html><body>"), tag("table", "notes", tag("tr", "", *[tag("td", "", "x")] * 6)),
        tag("table", "blockInfo__table specification", heads, items), F.lit("</body></html>"),
    )
    return contract_urls(spark, sf_dir).filter(F.col("o_orderkey") % 7 != 0).select("o_orderkey", html.alias("html"))


def attachment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of attachments per order; some name a printed form, some hold no file; every fifth is missing."""
    key = F.col("o_orderkey")
    link = lambda href, *name: tag(f'a href="{href}"', "", *name)
    html = F.concat(
        F.lit("<html><body>"), link("/about", "О сайте"), link("/files/terms.DOCX", "Условия"),
        F.when(key % 2 == 0, link("https://files.example.org/spec.pdf", "")).otherwise(F.lit("")),
        F.when(key % 3 == 0, link("/files/form.pdf", "Печатная форма ", F.col("key"))).otherwise(F.lit("")),
        F.lit("</body></html>"),
    )
    return contract_urls(spark, sf_dir).filter(key % 5 != 0).select("o_orderkey", html.alias("html"))


@query(
    "contract_tabs",
    _ORDER_CTE
    + f""", u AS (SELECT page_id, '{PAGE_HOST}/epz/contract/common-info.html?reestrNumber=' || key || '&tab=1' AS url
      FROM o)
    SELECT page_id AS o_orderkey, regexp_extract(url, 'reestrNumber=([^&]+)', 1) AS reestr_number,
      replace(url, 'common-info', 'payment-info') AS payments_url, replace(url, 'common-info', 'attachments')
      AS attachments_url FROM u""",
)
def contract_tabs(spark, sf_dir):
    """Registry number and sibling tab addresses from contract addresses."""
    url = F.col("url")
    return shown(
        contract_urls(spark, sf_dir).select(
            "o_orderkey",
            contract_pages.registry_number(url).alias("reestr_number"),
            contract_pages.tab_url(url, "payment-info").alias("payments_url"),
            contract_pages.tab_url(url, "attachments").alias("attachments_url"),
        )
    )


def numberless_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract pages of which every 7th address has no number, every 13th page nothing on it."""
    key = F.col("o_orderkey")
    url = F.when(key % 7 == 0, F.regexp_replace("url", "reestrNumber=[^&]+", "reestrNumber=")).otherwise(F.col("url"))
    return common_pages(spark, sf_dir).withColumns({"url": url, "html": F.when(key % 13 != 0, F.col("html"))})


def page_rules() -> dict[str, Column]:
    number = contract_pages.registry_number(F.col("url"))
    return {"no registry number": number.isNull(), "no page": F.coalesce(F.trim("html"), F.lit("")) == ""}


PAGE_COLUMNS = "o_orderkey BIGINT, url STRING, html STRING"


@query(
    "pages_judged",
    _ORDER_CTE
    + """ SELECT page_id AS o_orderkey, 'good' AS half, key AS reestr_number, NULL AS reasons FROM o WHERE page_id % 7 <> 0 AND page_id % 13 <> 0
    UNION ALL SELECT page_id, 'reject', CASE WHEN page_id % 7 <> 0 THEN key END,
      concat_ws('; ', CASE WHEN page_id % 7 = 0 THEN 'no registry number' END, CASE WHEN page_id % 13 = 0 THEN 'no page' END)
    FROM o WHERE page_id % 7 = 0 OR page_id % 13 = 0""",
)
def pages_judged(spark, sf_dir):
    """Pages without a number or a text land in the reject table with their reasons; the others are parsed."""
    out = scratch_dir(spark, "judged-pages")
    quarantine.write_judged(numberless_pages(spark, sf_dir), page_rules(), out)
    good, rejects = quarantine.read_judged(spark, out, PAGE_COLUMNS)
    facts = contract_pages.common_facts(good, ["o_orderkey"], "url")
    none = F.lit(None).cast("string")
    parsed = facts.select("o_orderkey", F.lit("good").alias("half"), "reestr_number", none.alias("reasons"))
    number = contract_pages.registry_number(F.col("url"))
    return parsed.union(rejects.select("o_orderkey", F.lit("reject"), number, F.concat_ws("; ", "reasons")))


@query(
    "pages_judged_counts",
    """SELECT unnest(['rows', 'rejects', 'rule: no registry number', 'rule: no page']) AS counted, unnest([count(*),
      count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 13 = 0), count(*) FILTER (o_orderkey % 7 = 0),
      count(*) FILTER (o_orderkey % 13 = 0)]) AS n FROM orders""",
)
def pages_judged_counts(spark, sf_dir):
    """What was counted while the halves were written."""
    counts = quarantine.write_judged(numberless_pages(spark, sf_dir), page_rules(), scratch_dir(spark, "judged-pages"))
    return spark.createDataFrame(list(counts.items()), "counted STRING, n BIGINT")


_FACTS = f"""facts AS (SELECT page_id, key, '{PAGE_HOST}/epz/contract/common-info.html?reestrNumber=' || key || '&tab=1'
    AS contract_url, CASE WHEN page_id % 11 <> 0 THEN CAST(o_orderdate::DATE AS VARCHAR) END AS sign_date,
    CASE WHEN page_id % 3 <> 0 THEN c_name ELSE 'Не указан' END AS customer, 'Supplier ' || key AS supplier,
    CASE WHEN page_id % 5 <> 0 THEN cents / 100.0 ELSE 0.0 END AS total_price,
    CASE WHEN page_id % 4 = 0 THEN 'USD' ELSE 'RUB' END AS currency, execution_status
  FROM o JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Исполнение завершено' ELSE 'Исполняется' END
    AS execution_status FROM orders) s ON o.page_id = s.o_orderkey)"""


@query(
    "page_fields",
    _ORDER_CTE
    + f", {_FACTS} SELECT page_id AS o_orderkey, key AS reestr_number, contract_url, sign_date, customer, supplier,"
    " total_price, currency, execution_status FROM facts",
)
def page_fields(spark, sf_dir):
    """Common facts found next to their labels, defaults for the missing ones."""
    return shown(contract_pages.common_facts(common_pages(spark, sf_dir), ["o_orderkey"], "url"))


_ITEMS = """items AS (SELECT page_id AS o_orderkey, i AS item_number, CASE i WHEN 1 THEN 'Бумага офисная ' WHEN 2
    THEN 'Моноблок учебный с клавиатурой ' ELSE 'Стул ' END || key AS name, '17.12.' || i AS okpd2_code,
    '17.12.14.110-0000000' || i AS ktru_code, i * 2.0::DOUBLE AS quantity, (cents + i) / 100.0 AS unit_price,
    (cents + i) * i * 2 / 100.0 AS total_price
  FROM (SELECT *, unnest(range(1, page_id % 3 + 2)) AS i FROM o WHERE page_id % 7 <> 0))"""


@query(
    "page_tables",
    _ORDER_CTE
    + f", {_ITEMS} SELECT o_orderkey, item_number::VARCHAR AS item_number, name, okpd2_code, ktru_code, 'шт' AS unit,"
    " quantity, unit_price, total_price FROM items",
)
def page_tables(spark, sf_dir):
    """Line items of the specification tables."""
    found = contract_pages.line_items(payment_pages(spark, sf_dir), ["o_orderkey"])
    items = found.select("o_orderkey", F.inline("line_items"))
    return shown(items.drop("manufacturer", "country_of_origin", "additional_info"))


_FILES = f"""files AS (SELECT o_orderkey, position, name, url, file_type, marked FROM (
    SELECT page_id AS o_orderkey, 0 AS position, 'Условия' AS name, '{PAGE_HOST}/files/terms.DOCX' AS url,
      'docx' AS file_type, false AS marked FROM o WHERE page_id % 5 <> 0
    UNION ALL SELECT page_id, 1, 'spec.pdf', 'https://files.example.org/spec.pdf', 'pdf', false FROM o
      WHERE page_id % 5 <> 0 AND page_id % 2 = 0
    UNION ALL SELECT page_id, 2, 'Печатная форма ' || key, '{PAGE_HOST}/files/form.pdf', 'pdf', true FROM o
      WHERE page_id % 5 <> 0 AND page_id % 3 = 0))"""


@query(
    "page_attachments",
    _ORDER_CTE
    + f", {_FILES} SELECT o_orderkey, name, url, file_type, CAST(marked AS VARCHAR) AS is_printed_form FROM files",
)
def page_attachments(spark, sf_dir):
    found = contract_pages.attachments(attachment_pages(spark, sf_dir), ["o_orderkey"], PAGE_HOST)
    files = found.select("o_orderkey", F.inline("attachments"))
    return shown(files, "o_orderkey", "name", "url", "file_type", "is_printed_form")


def parsed_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, line items and attachments of every contract; a missing tab leaves an empty list."""
    key = ["o_orderkey"]
    whole = joins.contract_pages(
        contract_pages.common_facts(common_pages(spark, sf_dir), key, "url"),
        contract_pages.line_items(payment_pages(spark, sf_dir), key),
        contract_pages.attachments(attachment_pages(spark, sf_dir), key, PAGE_HOST),
        "o_orderkey",
    )
    form = contract_pages.printed_form(F.col("attachments"), F.col("sign_date"), THRESHOLD_YEAR)
    return whole.withColumn("printed_form", form)


@query(
    "parsed_contracts",
    _ORDER_CTE
    + f""", {_FACTS}, {_ITEMS}, {_FILES},
    item_lists AS (SELECT o_orderkey, count(*) AS items, first(unit_price ORDER BY item_number) AS first_price,
      string_agg(DISTINCT ktru_code, ',' ORDER BY ktru_code) AS ktru_codes,
      coalesce(string_agg(CASE WHEN length(name) > 20 THEN name END, ',' ORDER BY item_number), '') AS long_names
      FROM items GROUP BY ALL),
    file_lists AS (SELECT o_orderkey, count(*) AS files, coalesce(
      first(name ORDER BY position) FILTER (marked), first(name ORDER BY position) FILTER (file_type = 'pdf')) AS form
      FROM files GROUP BY ALL)
    SELECT page_id AS o_orderkey, sign_date, coalesce(items, 0) AS line_items_count, coalesce(files, 0)
      AS attachments_count, CASE WHEN year(sign_date::DATE) >= 2000 THEN form END AS printed_form,
      CAST(coalesce(year(sign_date::DATE) >= 2000 AND form IS NOT NULL, false) AS VARCHAR) AS has_printed_form,
      first_price AS unit_price, coalesce(ktru_codes, '') AS ktru_codes, coalesce(long_names, '') AS long_names
    FROM facts LEFT JOIN item_lists i ON page_id = i.o_orderkey LEFT JOIN file_lists f ON page_id = f.o_orderkey""",
)
def parsed_contracts_summary(spark, sf_dir):
    """Counts, printed form, unit price, codes and long names of the joined tabs."""
    rows = parsed_contracts(spark, sf_dir)
    items = F.col("line_items")
    price = price_functions.unit_price(
        contract_pages.first_item(items, "unit_price"),
        F.col("total_price"),
        contract_pages.first_item(items, "quantity"),
    )
    return shown(
        rows.select(
            "o_orderkey",
            "sign_date",
            F.size("line_items").alias("line_items_count"),
            F.size("attachments").alias("attachments_count"),
            F.col("printed_form.name").alias("printed_form"),
            F.col("printed_form").isNotNull().alias("has_printed_form"),
            price.alias("unit_price"),
            F.array_join(contract_pages.distinct_values(items, "ktru_code"), ",").alias("ktru_codes"),
            F.array_join(contract_pages.long_names(items), ",").alias("long_names"),
        )
    )


@query(
    "analysis_text",
    _ORDER_CTE
    + f""", {_FACTS}, {_ITEMS},
    lines AS (SELECT o_orderkey, string_agg('  - ' || name || ' (KTRU: ' || ktru_code || ') (OKPD2: ' || okpd2_code
      || ') - ' || regexp_replace(format('{{:.2f}}', unit_price), '0$', '') || ' per шт', chr(10) ORDER BY item_number) AS body FROM items
      GROUP BY ALL)
    SELECT page_id AS o_orderkey, 'Contract: ' || key || chr(10) || 'Customer: ' || customer || chr(10) || 'Supplier: '
      || supplier || chr(10) || coalesce('Sign Date: ' || sign_date || ' 00:00:00' || chr(10), '') || 'Total Price: '
      || regexp_replace(format('{{:.2f}}', total_price), '0$', '') || ' ' || currency || chr(10) || 'Execution Status: '
      || execution_status || coalesce(chr(10) || chr(10) || 'Line Items:' || chr(10) || body, '') AS analysis_text
    FROM facts LEFT JOIN lines ON page_id = o_orderkey""",
)
def analysis_text(spark, sf_dir):
    """The text handed to the model for every contract."""
    rows = parsed_contracts(spark, sf_dir)
    return shown(rows.select("o_orderkey", contract_pages.analysis_text(rows).alias("analysis_text")))


@query(
    "item_texts",
    _ORDER_CTE
    + f""", {_FACTS}, {_ITEMS},
    blocks AS (SELECT o_orderkey, string_agg(chr(10) || chr(10) || 'Item: ' || name || chr(10) || 'OKPD2: ' || okpd2_code
      || chr(10) || 'KTRU: ' || ktru_code || chr(10) || 'Unit Price: '
      || regexp_replace(format('{{:.2f}}', unit_price), '0$', ''), '' ORDER BY item_number) AS body FROM items
      GROUP BY ALL)
    SELECT page_id AS o_orderkey, 'Contract: ' || key || chr(10) || 'Customer: ' || customer || chr(10) || 'Supplier: '
      || supplier || chr(10) || 'Total Price: ' || regexp_replace(format('{{:.2f}}', total_price), '0$', '') || ' '
      || currency || coalesce(body, '') || chr(10) AS item_text
    FROM facts LEFT JOIN blocks ON page_id = o_orderkey""",
)
def item_texts(spark, sf_dir):
    """The shorter text of every contract, a block of lines per item."""
    rows = parsed_contracts(spark, sf_dir)
    return rows.select("o_orderkey", contract_pages.short_analysis_text().alias("item_text"))


@query(
    "printed_form_texts",
    _ORDER_CTE
    + f""", {_FACTS}, {_FILES},
    forms AS (SELECT o_orderkey, bool_or(marked OR file_type = 'pdf') AS has_form FROM files GROUP BY ALL)
    SELECT page_id AS o_orderkey, CAST(coalesce(has_form AND year(sign_date::DATE) >= 2000, false) AS VARCHAR) AS has_form,
      CASE WHEN has_form AND year(sign_date::DATE) >= 2000 AND text IS NOT NULL THEN md5(chr(10) || chr(10)
        || 'Printed Form Content:' || chr(10) || text) END AS tail_md5,
      CASE WHEN has_form AND year(sign_date::DATE) >= 2000 THEN coalesce(length(text), 0) ELSE 0 END AS text_chars
    FROM facts LEFT JOIN forms ON page_id = o_orderkey LEFT JOIN documents ON page_id = doc_id""",
)
def printed_form_texts(spark, sf_dir):
    """The whole document text added for contracts with a printed form; here a document per order key."""
    texts = tables.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("o_orderkey"), F.col("text").alias("form_text")
    )
    rows = joins.with_printed_text(parsed_contracts(spark, sf_dir), texts, "o_orderkey").withColumn(
        "form_text", F.when(F.col("printed_form").isNotNull(), F.col("form_text"))
    )
    plain = contract_pages.analysis_text(rows)
    whole = contract_pages.analysis_text(rows, "form_text")
    tail = F.substring(whole, F.length(plain) + 1, F.length(whole))
    return shown(
        rows.select(
            "o_orderkey",
            F.col("printed_form").isNotNull().alias("has_form"),
            F.when(F.col("form_text").isNotNull(), F.md5(tail)).alias("tail_md5"),
            F.coalesce(F.length("form_text"), F.lit(0)).alias("text_chars"),
        )
    )


_PAGE_ROW = "'<tr><td class=\"label\">' || {} || '</td><td>' || {} || '</td></tr>'"


def _sql_price(cents: str) -> str:
    return (
        f"(({cents} // 100) // 1000)::VARCHAR || ' ' || lpad((({cents} // 100) % 1000)::VARCHAR, 3, '0') || ',' ||"
        f" lpad(({cents} % 100)::VARCHAR, 2, '0')"
    )


_COMMON_PAGE = " || ".join(
    [
        "'<html><body><h1>Сведения</h1><table class=\"facts\">'",
        _PAGE_ROW.format("'Дата заключения контракта'", "CASE WHEN page_id % 11 = 0 THEN 'не определена' ELSE dotted END"),
        f"CASE WHEN page_id % 3 <> 0 THEN {_PAGE_ROW.format(chr(39) + 'Заказчик (сокращенно)' + chr(39), 'c_name')} ELSE '' END",
        _PAGE_ROW.format("'Поставщик'", "'Supplier ' || key"),
        f"CASE WHEN page_id % 5 <> 0 THEN {_PAGE_ROW.format(chr(39) + 'ЦЕНА КОНТРАКТА' + chr(39), _sql_price('cents') + ' || ' + chr(39) + ' ₽' + chr(39))} ELSE '' END",
        f"CASE WHEN page_id % 4 = 0 THEN {_PAGE_ROW.format(chr(39) + 'Валюта' + chr(39), chr(39) + 'USD' + chr(39))} ELSE '' END",
        _PAGE_ROW.format("'Статус исполнения'", "s.execution_status"),
        "'</table></body></html>'",
    ]
)
_PROCESSED = "2001-09-01 12:30:00"


@query(
    "raw_records",
    _ORDER_CTE
    + f""", {_FACTS}, {_ITEMS}, {_FILES},
    forms AS (SELECT o_orderkey, coalesce(first(url ORDER BY position) FILTER (marked),
      first(url ORDER BY position) FILTER (file_type = 'pdf')) AS form FROM files GROUP BY ALL),
    written AS (SELECT page_id, {_COMMON_PAGE} AS html FROM o JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F'
      THEN 'Исполнение завершено' ELSE 'Исполняется' END AS execution_status FROM orders) s ON page_id = s.o_orderkey)
    SELECT t.page_id AS o_orderkey, key AS reestr_number, total_price, coalesce(i.n, 0) AS line_items_count,
      coalesce(f.n, 0) AS attachments_count, 80::BIGINT AS score, 'null' AS debug_inside, 'prompt ' || key AS debug_beside,
      length(html) AS html_length, md5(substring(html, 1, 5000)) AS sample_md5,
      CASE WHEN year(sign_date::DATE) >= 2000 THEN form END AS printed_form_path,
      CAST(coalesce(year(sign_date::DATE) >= 2000 AND form IS NOT NULL, false) AS VARCHAR) AS has_printed_form,
      '2001-09-01T12:30:00' AS processing_timestamp
    FROM facts t LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM items GROUP BY ALL) i ON t.page_id = i.o_orderkey
    LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM files GROUP BY ALL) f ON t.page_id = f.o_orderkey
    LEFT JOIN forms g ON t.page_id = g.o_orderkey JOIN written w ON t.page_id = w.page_id""",
)
def raw_records(spark, sf_dir):
    """The nested JSON kept with each result over its real page, read back."""
    rows = (
        parsed_contracts(spark, sf_dir)
        .join(common_pages(spark, sf_dir).select("o_orderkey", "html").hint("merge"), "o_orderkey")
        .withColumns(
            {
                "specs": F.struct(F.lit("item").alias("object_name"), F.concat(F.lit("prompt "), "reestr_number").alias("_debug")),
                "comparison": F.struct(F.lit(80).alias("score")),
            }
        )
    )
    as_of = F.lit(_PROCESSED).cast("timestamp")
    record = rows.select("o_orderkey", contract_pages.raw_record(rows, "html", "specs", "comparison", as_of).alias("record"))
    value = lambda path: F.get_json_object("record", path)
    page = "$.debug_data.parser_html"
    return shown(
        record.select(
            "o_orderkey",
            value("$.contract_info.reestr_number").alias("reestr_number"),
            value("$.contract_info.total_price").cast("double").alias("total_price"),
            value("$.contract_info.line_items_count").cast("bigint").alias("line_items_count"),
            value("$.contract_info.attachments_count").cast("bigint").alias("attachments_count"),
            value("$.comparison_result.score").cast("bigint").alias("score"),
            F.coalesce(value("$.contract_specs._debug"), F.lit("null")).alias("debug_inside"),
            value("$.debug_data.ai_extraction_debug").alias("debug_beside"),
            value(f"{page}.common_info_html_length").cast("bigint").alias("html_length"),
            F.md5(value(f"{page}.common_info_html_sample")).alias("sample_md5"),
            value(f"{page}.printed_form_path").alias("printed_form_path"),
            value(f"{page}.has_printed_form").alias("has_printed_form"),
            value("$.debug_data.processing_timestamp").alias("processing_timestamp"),
        )
    )


@query(
    "search_records",
    """SELECT page_id, url AS search_url, md5(substring(html, 1, 5000)) AS sample_md5, length(html) AS html_length,
      len(regexp_extract_all(html, '<a href=')) AS parsed_contracts_count, page_id * 3 AS total_found,
      '2001-09-01T12:30:00' AS timestamp FROM pages""",
)
def search_records(spark, sf_dir):
    """The nested JSON kept with each search, read back; a page's links stand for the contracts it lists."""
    rows = tables.table(spark, sf_dir, "pages")
    listed = F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0)))
    as_of = F.lit(_PROCESSED).cast("timestamp")
    record = contract_pages.search_record(F.col("html"), F.col("url"), listed, F.col("page_id") * 3, as_of)
    value = lambda name: F.get_json_object("record", f"$.parser.{name}")
    number = lambda name: value(name).cast("bigint").alias(name)
    return shown(
        rows.select("page_id", record.alias("record")).select(
            "page_id",
            value("search_url").alias("search_url"),
            F.md5(value("html_sample")).alias("sample_md5"),
            number("html_length"),
            number("parsed_contracts_count"),
            number("total_found"),
            value("timestamp").alias("timestamp"),
        )
    )


# ---------------------------------------------------------------- from pages to the ceiling

WANTED_CODE = "17.12.14.110-00000002"
SEARCHES = 7
AS_OF_YEAR = 2001
SELECTED, LIMIT = 3, 30


@query(
    "ceiling_from_pages",
    _ORDER_CTE
    + f""", {_FACTS}, {_ITEMS},
    cards AS (SELECT page_id, page_id % {SEARCHES} AS search_id, o_orderdate::DATE AS dated, key FROM o),
    listed AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY dated DESC, key DESC) <= {LIMIT}),
    item_lists AS (SELECT o_orderkey, first(unit_price ORDER BY item_number) AS unit_price,
      bool_or(ktru_code = '{WANTED_CODE}') AS code_match FROM items GROUP BY ALL),
    judged AS (SELECT search_id, l.key, sign_date::DATE AS sign_date, i.unit_price,
        CASE WHEN coalesce(code_match, false) THEN 80 ELSE 50 END AS score
      FROM listed l JOIN facts f ON l.page_id = f.page_id LEFT JOIN item_lists i ON l.page_id = i.o_orderkey),
    scored AS (SELECT *, 10.0::DOUBLE * CASE WHEN score >= 80 THEN 3 ELSE 2 END + score * 0.5::DOUBLE
        + CASE WHEN year(sign_date) >= {AS_OF_YEAR} - 1 THEN 10 WHEN year(sign_date) >= {AS_OF_YEAR} - 3 THEN 5 ELSE 0 END
        + CASE WHEN unit_price IS NOT NULL THEN 5 ELSE 0 END AS selection_score FROM judged),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY selection_score DESC, key) <= {SELECTED}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY unit_price) - 1 AS i,
      count(*) OVER (PARTITION BY search_id) AS n FROM best WHERE unit_price > 0),
    bounds AS (SELECT search_id, max(n) AS n, max(CASE WHEN i = n // 4 THEN unit_price END) AS q1,
      max(CASE WHEN i = (3 * n) // 4 THEN unit_price END) AS q3 FROM ranked GROUP BY search_id),
    kept AS (SELECT r.* FROM ranked r JOIN bounds b ON r.search_id = b.search_id
      WHERE b.n < 3 OR unit_price BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE),
    ends AS (SELECT search_id, sum(CAST(round(unit_price * 100) AS BIGINT)) AS cents, count(*) AS n FROM kept GROUP BY ALL)
    SELECT l.search_id, count(*) AS processed, any_value((e.cents / 100.0::DOUBLE) / e.n) AS ceiling, 'DONE' AS status
    FROM listed l LEFT JOIN ends e ON l.search_id = e.search_id GROUP BY l.search_id""",
)
def ceiling_from_pages(spark, sf_dir):
    """The whole path from pages: cards, the freshest of each search, their contract pages, the score, the ceiling."""
    found = cards.search_cards(result_pages(spark, sf_dir), ["page_id"], PAGE_HOST).where("registry_no <> ''")
    number = F.regexp_extract("registry_no", r"(\d+)", 1)
    dated = found.select(
        F.pmod("page_id", F.lit(SEARCHES)).alias("search_id"), number.alias("reestr_number"), lenient_date(F.col("date")).alias("dated")
    )
    order = [F.desc("dated"), F.desc("reestr_number")]
    listed = topk.top_k(dated, ["search_id"], order, LIMIT, told_by=["reestr_number"])
    rows = listed.join(parsed_contracts(spark, sf_dir), "reestr_number")
    items = F.col("line_items")
    price = price_functions.unit_price(
        contract_pages.first_item(items, "unit_price"), F.col("total_price"), contract_pages.first_item(items, "quantity")
    )
    code = F.coalesce(F.array_contains(contract_pages.distinct_values(items, "ktru_code"), WANTED_CODE), F.lit(False))
    judged = rows.select(
        "search_id",
        "reestr_number",
        "sign_date",
        price.cast("decimal(15,2)").alias("unit_price"),
        scoring.fallback_score(code, F.lit(False)).alias("score"),
    )
    score = scoring.selection_score(
        scoring.fallback_type(F.col("score")), F.col("score"), F.lit(None).cast("boolean"), F.year("sign_date"), F.col("unit_price"), AS_OF_YEAR
    )
    scored = materialized(judged.withColumn("selection_score", score), "from-pages")
    best = topk.top_k(scored, ["search_id"], [F.desc("selection_score"), F.asc("reestr_number")], SELECTED, salted=False)
    ends = prices.small_group_ceiling(best, ["search_id"]).select("search_id", "ceiling")
    whole = scored.groupBy("search_id").agg(F.count("*").alias("processed")).join(ends, "search_id", "left")
    status = scoring.final_status(F.lit(None).cast("string"), F.col("processed"))
    return shown(whole.select("search_id", "processed", "ceiling", status.alias("status")))

"""Contract pages: common facts, line items and attachments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions.dates import page_date
from pricewell.functions.labels import DEFAULT_CURRENCY, MISSING_TEXT
from pricewell.functions.prices import page_price
from pricewell.functions.text import plain_number
from pricewell.schemas import ATTACHMENT, LINE_ITEM, PRINTED_FORM_YEAR, SAMPLE_CHARS
from pricewell.sources.pages import Selector, absolute_url, beside_labels, selected, table_cells, text_of

# Labels of the common facts, patterns of codes and files.
FIELD_LABELS = {
    "sign_date": "Дата заключения контракта",
    "customer": "Заказчик",
    "supplier": "Поставщик",
    "total_price": "Цена контракта",
    "currency": "Валюта",
    "execution_status": "Статус исполнения",
}
LABEL_TAGS = ("span", "div", "td")
ITEM_TABLE = "specification|line-items|payments"
ITEM_LEAST_CELLS = 5
OKPD2_CODE = r"(?i)OKPD2[:\s]*([\d.]+)"
KTRU_CODE = r"(?i)KTRU[:\s]*([\d.\-]+)"
ATTACHMENT_LINK = r"(?i)\.(pdf|docx?|xlsx?)$"
PRINTED_MARKS = ("печатн", "printed")
LONG_NAME = 20


def registry_number(url: Column) -> Column:
    """The registry number in a contract address, null if there is none."""
    return F.nullif(F.regexp_extract(url, "reestrNumber=([^&]+)", 1), F.lit(""))


def tab_url(url: Column, tab: str) -> Column:
    """Address of a sibling tab (``payment-info`` or ``attachments``) of the common facts."""
    return F.replace(url, F.lit("common-info"), F.lit(tab))


def common_facts(pages: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """Common facts of each contract page, with the defaults for missing ones.

    An unreadable sign date stays null.
    """
    found = beside_labels(pages, [*keys, url], list(FIELD_LABELS.values()), LABEL_TAGS)
    facts = found.select(*keys, url, *[F.get("values", F.lit(i)).alias(name) for i, name in enumerate(FIELD_LABELS)])
    missing = F.lit(MISSING_TEXT)
    return facts.select(
        *keys,
        registry_number(F.col(url)).alias("reestr_number"),
        F.col(url).alias("contract_url"),
        page_date(F.col("sign_date")).alias("sign_date"),
        F.coalesce(F.nullif("customer", F.lit("")), missing).alias("customer"),
        F.coalesce(F.nullif("supplier", F.lit("")), missing).alias("supplier"),
        F.coalesce(page_price(F.col("total_price")), F.lit(0.0)).alias("total_price"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        F.coalesce(F.nullif("execution_status", F.lit("")), missing).alias("execution_status"),
    )


def codes_in(text: Column) -> tuple[Column, Column]:
    """The two catalogue codes in a text, null where absent."""
    return tuple(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in (OKPD2_CODE, KTRU_CODE))


def _line_item(cells: Column) -> Column:
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    okpd2, ktru = codes_in(cell(2))
    none = F.lit(None).cast("string")
    return F.struct(
        cell(0).alias("item_number"),
        cell(1).alias("name"),
        okpd2.alias("okpd2_code"),
        ktru.alias("ktru_code"),
        cell(3).alias("unit"),
        page_price(cell(4)).alias("quantity"),
        page_price(cell(5)).alias("unit_price"),
        page_price(cell(6)).alias("total_price"),
        none.alias("manufacturer"),
        none.alias("country_of_origin"),
        none.alias("additional_info"),
    )


def line_items(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The line items of each payments page, as one array per page."""
    found = table_cells(pages, keys, ITEM_TABLE)
    full = F.filter("cells", lambda c: F.size(c) >= ITEM_LEAST_CELLS)
    return found.select(*keys, F.transform(full, _line_item).cast(f"ARRAY<STRUCT<{_as_struct(LINE_ITEM)}>>").alias("line_items"))


def _as_struct(ddl: str) -> str:
    """Schema DDL in the notation of a nested struct."""
    return ", ".join(f"{part.split()[0]}: {part.split()[1]}" for part in ddl.split(", "))


def attachments(pages: DataFrame, keys: Sequence[str], base_url: str) -> DataFrame:
    """The attachments of each attachments page, as one array per page."""
    texts = F.col("texts")
    files = F.filter("hits", lambda e: e["href"].rlike(ATTACHMENT_LINK))

    def attachment(link: Column) -> Column:
        href, text = link["href"], text_of(link, texts)
        name = F.when(text != "", text).otherwise(F.substring_index(href, "/", -1))
        marked = F.lit(False)
        for mark in PRINTED_MARKS:
            marked = marked | F.contains(F.lower(name), F.lit(mark))
        none = F.lit(None)
        return F.struct(
            name.alias("name"),
            F.when(href.startswith("/"), absolute_url(href, F.lit(base_url))).otherwise(href).alias("url"),
            F.lower(F.regexp_extract(href, r"\.([^./]+)$", 1)).alias("file_type"),
            none.cast("bigint").alias("size"),
            none.cast("string").alias("description"),
            marked.alias("is_printed_form"),
        )

    found = selected(pages, keys, [Selector("a", linked=True)]).withColumn("files", files)
    typed = F.transform("files", attachment).cast(f"ARRAY<STRUCT<{_as_struct(ATTACHMENT)}>>")
    return found.select(*keys, typed.alias("attachments"))


def printed_form(files: Column, sign_date: Column, year: int = PRINTED_FORM_YEAR) -> Column:
    """The printed form of a contract of the threshold year or later: the first marked file, else the first pdf."""
    marked = F.get(F.filter(files, lambda f: f["is_printed_form"]), F.lit(0))
    pdf = F.get(F.filter(files, lambda f: f["file_type"] == "pdf"), F.lit(0))
    return F.when(F.year(sign_date) >= year, F.coalesce(marked, pdf))


def distinct_values(items: Column, field: str) -> Column:
    """Sorted distinct non-empty values of a field over the items of one contract."""
    values = F.transform(items, lambda i: F.nullif(i[field], F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def long_names(items: Column) -> Column:
    """Item names long enough to describe the item."""
    return F.transform(F.filter(items, lambda i: F.length(i["name"]) > LONG_NAME), lambda i: i["name"])


def first_item(items: Column, field: str) -> Column:
    return F.get(items, F.lit(0))[field]


def analysis_text(facts: DataFrame, printed_text: str | None = None) -> Column:
    """The text a model analyses: header lines, one line per item, then the printed form."""
    amount = plain_number(F.col("total_price"))
    header = [
        F.concat(F.lit("Contract: "), "reestr_number"),
        F.concat(F.lit("Customer: "), "customer"),
        F.concat(F.lit("Supplier: "), "supplier"),
        F.concat(F.lit("Sign Date: "), F.date_format("sign_date", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Total Price: "), amount, F.lit(" "), "currency"),
        F.concat(F.lit("Execution Status: "), "execution_status"),
    ]

    def optional(value: Column, *parts: Column | str) -> Column:
        joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        return F.when(value.isNotNull() & (value.cast("string") != ""), joined).otherwise(F.lit(""))

    def item_line(item: Column) -> Column:
        price = F.nullif(item["unit_price"], F.lit(0.0))
        return F.concat(
            F.lit("  - "),
            item["name"],
            optional(item["ktru_code"], " (KTRU: ", item["ktru_code"], ")"),
            optional(item["okpd2_code"], " (OKPD2: ", item["okpd2_code"], ")"),
            optional(price, " - ", plain_number(price), " per ", item["unit"]),
            optional(item["manufacturer"], " - Manufacturer: ", item["manufacturer"]),
        )

    listed = F.when(
        F.size("line_items") > 0, F.concat(F.array(F.lit("\nLine Items:")), F.transform("line_items", item_line))
    ).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.array(*header), listed), "\n")
    if printed_text is None:
        return body
    printed = F.concat(F.lit("\n\nPrinted Form Content:\n"), printed_text)
    return F.concat(body, F.coalesce(printed, F.lit("")))


def short_analysis_text() -> Column:
    """The shorter form of the text: header lines, then a block of lines per item."""
    header = [
        F.concat(F.lit("Contract: "), "reestr_number"),
        F.concat(F.lit("Customer: "), "customer"),
        F.concat(F.lit("Supplier: "), "supplier"),
        F.concat(F.lit("Total Price: "), plain_number(F.col("total_price")), F.lit(" "), "currency"),
    ]

    def block(item: Column) -> Column:
        line = lambda label, value: F.concat(F.lit(f"{label}: "), F.nullif(value, F.lit("")))
        price = F.nullif(item["unit_price"], F.lit(0.0))
        # missing parts are null, which the join of the lines leaves out
        return F.concat_ws(
            "\n",
            F.lit(""),
            F.concat(F.lit("Item: "), item["name"]),
            line("OKPD2", item["okpd2_code"]),
            line("KTRU", item["ktru_code"]),
            F.concat(F.lit("Unit Price: "), plain_number(price)),
            line("Manufacturer", item["manufacturer"]),
        )

    lines = F.concat(F.array(*header), F.transform("line_items", block))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def _debug_free(value: Column, schema: T.DataType) -> tuple[Column, Column]:
    """A struct without its ``_debug`` field, and that field, null where there is none."""
    has_debug = isinstance(schema, T.StructType) and "_debug" in schema.fieldNames()
    return (value.dropFields("_debug"), value["_debug"]) if has_debug else (value, F.lit(None).cast("string"))


def search_record(html: Column, url: Column, parsed: Column, total: Column, as_of: Column) -> Column:
    """The nested JSON kept with a search: its address, a sample of the result page and what was found."""
    return F.to_json(
        F.struct(
            F.struct(
                url.alias("search_url"),
                F.substring(html, 1, SAMPLE_CHARS).alias("html_sample"),
                F.coalesce(F.length(html), F.lit(0)).alias("html_length"),
                parsed.alias("parsed_contracts_count"),
                total.alias("total_found"),
                F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            ).alias("parser")
        ),
        {"ignoreNullFields": "false"},
    )


def raw_record(rows: DataFrame, html: str, specs: str, comparison: str, as_of: Column) -> Column:
    """The nested JSON kept with a result: facts, specifications, comparison and a page sample.

    The ``_debug`` fields of the model's answers are kept apart from the answers.
    """
    clean_specs, specs_debug = _debug_free(F.col(specs), rows.schema[specs].dataType)
    clean_comparison, comparison_debug = _debug_free(F.col(comparison), rows.schema[comparison].dataType)
    form = F.col("printed_form")
    return F.to_json(
        F.struct(
            F.struct(
                "reestr_number", "customer", "supplier", "total_price", "currency", "execution_status",
                F.size("line_items").alias("line_items_count"),
                F.size("attachments").alias("attachments_count"),
                form.isNotNull().alias("has_printed_form"),
            ).alias("contract_info"),
            clean_specs.alias("contract_specs"),
            clean_comparison.alias("comparison_result"),
            F.struct(
                F.struct(
                    F.substring(html, 1, SAMPLE_CHARS).alias("common_info_html_sample"),
                    F.coalesce(F.length(html), F.lit(0)).alias("common_info_html_length"),
                    form.isNotNull().alias("has_printed_form"),
                    form["url"].alias("printed_form_path"),
                ).alias("parser_html"),
                specs_debug.alias("ai_extraction_debug"),
                comparison_debug.alias("ai_comparison_debug"),
                F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("processing_timestamp"),
            ).alias("debug_data"),
        ),
        {"ignoreNullFields": "false"},
    )

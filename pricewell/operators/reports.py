"""The three report sheets as DataFrames, and the snapshot updates behind them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions import dates, labels, scoring, text
from pricewell.operators import topk
from pricewell.schemas import PRICE

# Labels of the summary sheet.
PARAMETER_LABELS = [
    "ID поиска", "Дата создания", "Статус", "Объект закупки", "Код КТРУ", "Код ОКПД2", "Регион заказчика",
    "Закон", "Период с", "Период по", "Статусы исполнения", "Лимит контрактов", "Источник данных",
]
RESULT_LABELS = [
    "Всего найдено контрактов", "Обработано контрактов", "Включено в отчет", "Принято для расчета НМЦК",
    "Идентичные совпадения", "Однородные товары", "Нет совпадения", "Расчетное значение НМЦК", "Время выполнения",
]
# Headers of the detail and comparison sheets.
DETAIL_HEADERS = [
    "№", "Реестровый номер", "Дата подписания", "Тип совпадения", "Цена за единицу", "Валюта", "Оценка ИИ",
    "Производитель (целевой)", "Производитель (найденный)", "Совпадение производителя", "Контракт 2025+",
    "Принят для НМЦК", "Ссылка на контракт",
]
COMPARISON_HEADERS = ["Характеристика", "Целевое значение", "Фактическое значение", "Статус совпадения", "Вес"]


def result_counts(results: DataFrame, keys: Sequence[str] = ("search_id",)) -> DataFrame:
    """Contracts of each search in total, accepted, and by match type."""
    kind = F.col("match_type")
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("accepted_for_nmc").alias("accepted"),
        F.count_if(kind == "IDENTICAL").alias("identical"),
        F.count_if(kind == "HOMOGENEOUS").alias("homogeneous"),
        F.count_if(kind == "NO_MATCH").alias("no_match"),
    )


def with_final_values(requests: DataFrame, finals: DataFrame, as_of: Column) -> DataFrame:
    """The requests with their final values, as a new snapshot stamped ``as_of``.

    ``finals`` has one row per finished search: found_total, processed_count,
    nmc_value, selected_contract_ids, runtime_ms and a given error message.
    """
    replaced = ["status", "error_message", *[c for c in finals.columns if c != "id"]]
    kept = requests.drop(*[c for c in replaced if c != "status"])
    processed = F.col("processed_count")
    given = F.col("given_error")
    return (
        kept.withColumnRenamed("status", "__status")
        .join(finals.withColumn("given_error", F.col("error_message")).drop("error_message"), "id", "left")
        .withColumn(
            "status",
            F.when(processed.isNull(), F.col("__status")).otherwise(scoring.final_status(given, processed)),
        )
        .withColumn("error_message", scoring.final_error(given, processed))
        .withColumn("updated_at", F.when(processed.isNotNull(), as_of))
        .drop("__status", "given_error")
    )


def summary_rows(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Label-value rows per search: its parameters, then its results."""
    joined = requests.join(counts.withColumnRenamed("search_id", "id"), "id", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("string")
    nmc = F.nullif(F.col("nmc_value"), F.lit(0).cast(PRICE))
    runtime = F.nullif(F.col("runtime_ms"), F.lit(0))
    values = [
        F.col("id"),
        F.date_format("created_at", "dd.MM.yyyy HH:mm"),
        F.col("status"),
        F.col("object_name"),
        F.col("ktru_code"),
        F.coalesce(F.nullif("okpd2_code", F.lit("")), F.lit(labels.MISSING_TEXT)),
        F.col("customer_region"),
        F.col("law"),
        dates.date_text(F.col("date_from")),
        dates.date_text(F.col("date_to")),
        F.array_join("execution_statuses", ", "),
        F.col("limit_contracts").cast("string"),
        F.col("input_source"),
        zero("found_total"),
        zero("processed_count"),
        zero("total"),
        zero("accepted"),
        zero("identical"),
        zero("homogeneous"),
        zero("no_match"),
        F.coalesce(F.concat(text.money_text(nmc), F.lit(" RUB")), F.lit(labels.NOT_CALCULATED)),
        F.coalesce(F.concat(runtime.cast("string"), F.lit(" мс")), F.lit(labels.NOT_MEASURED)),
    ]
    rows = [
        F.struct(F.lit(i).alias("row_no"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(zip(PARAMETER_LABELS + RESULT_LABELS, values), start=1)
    ]
    return joined.select(F.col("id").alias("search_id"), F.inline(F.array(*rows)))


def detail_rows(results: DataFrame) -> DataFrame:
    """One display row per contract, numbered newest first within its search."""
    newest = topk.numbered(
        results,
        ["search_id"],
        # a day of a busy search is split further by the start of its ids
        [(F.col("created_date"), True), (F.substring("contract_id", 1, 2), False)],
        [F.desc("created_date"), F.asc("contract_id")],
        "seq",
    )
    blank = F.lit("")
    price = F.nullif(F.col("unit_price"), F.lit(0).cast(PRICE))
    return newest.select(
        "search_id",
        F.col("seq"),
        F.col("registry_no"),
        F.coalesce(dates.date_text(F.col("sign_date")), blank).alias("signed"),
        F.col("match_type"),
        F.coalesce(text.money_text(price), blank).alias("unit_price"),
        F.col("currency"),
        F.col("ai_score"),
        F.coalesce("target_manufacturer", blank).alias("manufacturer_target"),
        F.coalesce("manufacturer", blank).alias("manufacturer_found"),
        labels.yes_no_unspecified(F.col("manufacturer_match")).alias("manufacturer_match"),
        labels.yes_no(F.col("is_recent")).alias("is_recent"),
        labels.yes_no(F.col("accepted_for_nmc")).alias("accepted_for_nmc"),
        F.col("contract_url"),
    )


def comparison_rows(results: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the accepted contracts that have any, each under its contract's header."""
    header = F.concat(F.lit("Контракт: "), "registry_no", F.lit(" - "), "match_type")
    accepted = results.filter("accepted_for_nmc").select(*keys, header.alias("contract_header"))
    blank = F.lit("")
    return rows.join(accepted, list(keys)).select(
        *keys,
        "contract_header",
        "name",
        F.coalesce("target_value", blank).alias("target_value"),
        F.coalesce("actual_value", blank).alias("actual_value"),
        "match_status",
        "weight",
    )

"""Display labels and the codes behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of laws and execution statuses with their codes.
LAW_CODES = {"44-ФЗ": "fz44", "223-ФЗ": "fz223", "94-ФЗ": "fz94"}
DEFAULT_LAW_CODE = "fz44"
STATUS_CODES = {
    "Исполнение завершено": "EXECUTION_COMPLETED",
    "Исполняется": "EXECUTION_IN_PROGRESS",
    "Расторгнут": "TERMINATED",
}

# Report texts.
YES, NO, UNSPECIFIED = "Да", "Нет", "Не указано"
MISSING_TEXT = "Не указан"
NOT_CALCULATED = "Не рассчитано"
NOT_MEASURED = "Не измерено"
DEFAULT_CURRENCY = "RUB"


# Separators no label contains.
BETWEEN, WITHIN = "\x1e", "\x1f"


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant map column, written as one text so that long maps stay cheap to plan."""
    text = BETWEEN.join(f"{key}{WITHIN}{value}" for key, value in mapping.items())
    return F.str_to_map(F.lit(text), F.lit(BETWEEN), F.lit(WITHIN))


def literal_array(values: list[str]) -> Column:
    """A constant array of texts, likewise."""
    return F.split(F.lit(BETWEEN.join(values)), BETWEEN)


def law_code(law: Column) -> Column:
    """Law label to code; anything unknown counts as the default law."""
    return F.coalesce(F.try_element_at(literal_map(LAW_CODES), law), F.lit(DEFAULT_LAW_CODE))


def status_codes(labels: Column) -> Column:
    """Status labels to codes; unknown labels are dropped."""
    codes = literal_map(STATUS_CODES)
    return F.filter(F.transform(labels, lambda s: F.try_element_at(codes, s)), lambda s: s.isNotNull())


def yes_no(flag: Column) -> Column:
    """Two-valued rendering: null reads as no."""
    return F.when(flag, F.lit(YES)).otherwise(F.lit(NO))


def yes_no_unspecified(flag: Column) -> Column:
    """Three-valued rendering."""
    return F.when(flag.isNull(), F.lit(UNSPECIFIED)).otherwise(yes_no(flag))

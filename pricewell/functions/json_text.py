"""Nested values as indented JSON text, as a model's prompts show them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that JSON text writes in another way.
SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
CONTROLS = {chr(i): SHORT_ESCAPES.get(chr(i), f"\\u{i:04x}") for i in range(32)}


def quoted(text: Column) -> Column:
    """A text in quotes; letters of all scripts stay as they are."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(c[1])), CONTROLS.items(), plain)
    safe = F.when(F.rlike(text, F.lit(r"[\x00-\x1f]")), escaped).otherwise(plain)
    return F.concat(F.lit('"'), safe, F.lit('"'))


def _float(value: Column) -> Column:
    """The shortest decimal that reads back as the same number: plain from 0.0001 to below 1e16, else with exponent."""
    java = F.abs(value).cast("string")
    mantissa = F.substring_index(java, "E", 1)
    point = F.length(F.substring_index(mantissa, ".", 1))
    exponent = F.when(F.contains(java, F.lit("E")), F.substring_index(java, "E", -1).cast("int")).otherwise(0) + point - 1
    raw = F.replace(mantissa, F.lit("."), F.lit(""))
    lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))  # 0.00123 has its first digit behind zeros
    given = F.rtrim(F.ltrim(raw, F.lit("0")), F.lit("0"))
    at = exponent - lead
    # older runtimes write a digit too many for some numbers
    fewer = F.round(F.concat(F.substring(given, 1, 1), F.lit("."), F.substring(given, F.lit(2), F.length(given))).try_cast("decimal(20,18)"), 15)
    same = F.concat(fewer.cast("string"), F.lit("E"), at.cast("string")).try_cast("double") == F.abs(value)
    shorter = F.rtrim(F.replace(fewer.cast("string"), F.lit("."), F.lit("")), F.lit("0"))
    digits = F.when((F.length(given) > 16) & (fewer < 10) & same, shorter).otherwise(given)
    n = F.length(digits)
    whole = F.concat(F.rpad(digits, F.greatest(at + 1, n), "0"))
    large = F.concat(F.substring(whole, F.lit(1), at + 1), F.lit("."), F.when(n > at + 1, F.substring(digits, at + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -at - 1), digits)
    rest = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    power = F.concat(F.lit("e"), F.when(at < 0, "-").otherwise("+"), F.lpad(F.abs(at).cast("string"), F.greatest(F.lit(2), F.length(F.abs(at).cast("string"))), "0"))
    shown = F.when(F.abs(value) == 0, F.lit("0.0")).when((at >= 0) & (at < 16), large).when((at < 0) & (at >= -4), small)
    shown = shown.otherwise(F.concat(F.substring(digits, 1, 1), rest, power))
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    infinite = F.when(value > 0, F.lit("Infinity")).otherwise("-Infinity")
    return F.when(F.isnan(value), F.lit("NaN")).when(F.abs(value) == float("inf"), infinite).otherwise(F.concat(sign, shown))


def _block(items: Column, ends: str, step: int, depth: int) -> Column:
    """Items on lines of their own between two brackets; none gives the bare brackets."""
    inner, outer = "\n" + " " * step * (depth + 1), "\n" + " " * step * depth
    full = F.concat(F.lit(ends[0] + inner), F.array_join(items, "," + inner), F.lit(outer + ends[1]))
    return F.when(F.size(items) == 0, F.lit(ends)).otherwise(full)


def indented(value: Column, kind: T.DataType, step: int = 2, depth: int = 0) -> Column:
    """A value of any type as JSON text, indented by ``step`` blanks a level; the type says how to walk it.

    Structs keep the order of their fields, maps that of their entries; keys of maps become texts. Null is ``null``, at any
    depth. Decimals are written in full, dates and times as texts, binary values as base64 texts. A variant has no
    type to walk by: cast it to one first.
    """
    walk = lambda v, t: indented(v, t, step, depth + 1)
    if isinstance(kind, T.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(": "), walk(value[f.name], f.dataType)) for f in kind.fields]
        text = _block(F.array(*fields), "{}", step, depth) if fields else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        text = _block(F.transform(value, lambda x: walk(x, kind.elementType)), "[]", step, depth)
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(": "), walk(e["value"], kind.valueType))
        text = _block(F.transform(F.map_entries(value), entry), "{}", step, depth)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = _float(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = quoted(F.base64(value))
    elif isinstance(kind, T.VariantType):
        raise TypeError("cast a variant to a type first")
    else:
        text = quoted(value.cast("string"))
    return F.when(value.isNull(), F.lit("null")).otherwise(text)

"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.session import materialized

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits of a filter of ids, as a power of two: at most 2 ** (bits - 6) words are broadcast, however many ids there are.
ID_FILTER_BITS = 25


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """At most ``most`` rows, the first by a hash of a column; fewer where the rows are few.

    The hash cuts nearly all other rows off where they are, so some ``2 * most`` rows are gathered
    in all, however many rows and partitions there are.
    """
    total = rows.count()
    if total <= most:
        return rows
    span = 1 << 40
    place = F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(span))
    near = rows.withColumn("__place", place).where(F.col("__place") < int(min(1.0, 2 * most / total) * span))
    return near.orderBy("__place", by).limit(most).drop("__place")


def sent_to_python(docs: DataFrame, carried: list[str], text_col: str) -> tuple[DataFrame, str]:
    """The columns for a function over texts and the name of the text among them; a carried text is sent once."""
    if text_col in carried and isinstance(docs.schema[text_col].dataType, T.StringType):
        return docs.select(*carried), text_col
    return docs.select(*carried, whole_text(text_col).alias("__text")), "__text"


def key_of(column: str) -> Column:
    """A key for equality joins in which null matches null."""
    return F.struct(F.col(column).isNull().alias("none"), F.coalesce(F.col(column), F.lit(0)).alias("id"))


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """The schema with the fields at its end; a field of the same name is replaced."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def _filter_place(id_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long")).bitwiseAND((1 << ID_FILTER_BITS) - 1)


def id_filter(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A table of bits of fixed size in which each id, null too, has set one."""
    places = ids.select(_filter_place(id_col).alias("place"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("__bits")
    return materialized(places.groupBy(F.shiftright("place", 6).alias("__word")).agg(bits), "id-filter")


def parted_by_filter(rows: DataFrame, bits: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be in the filter, and those whose id surely isn't; no row is shuffled.

    The fuller the filter, the more rows are among the first, which are told apart exactly by a join.
    """
    place = _filter_place(id_col)
    marked = rows.withColumn("__place", place).withColumn("__at", F.shiftright("__place", 6)).join(
        F.broadcast(bits), F.col("__at") == F.col("__word"), "left"
    )
    may_be = F.expr("coalesce(shiftrightunsigned(__bits, cast(__place & 63 as int)) & 1L, 0L) = 1")
    return marked.where(may_be).select(*rows.columns), marked.where(~may_be).select(*rows.columns)


def rows_with_ids(docs: DataFrame, ids: DataFrame, how: str, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is (``left_semi``) or is not (``left_anti``) among the ids; null matches null.

    Only the rows that pass a filter of the ids are shuffled, the others stay where they are.
    """
    ids = materialized(ids.select(id_col).distinct(), "ids")
    wanted = ids.select(key_of(id_col).alias("__key"))
    may_be, others = parted_by_filter(docs, id_filter(ids, id_col), id_col)
    told = may_be.withColumn("__key", key_of(id_col)).join(wanted, "__key", how).select(*docs.columns)
    return told if how == "left_semi" else others.unionByName(told)


def kept_in_worker(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks.

    Functions travel to the workers by value, so a module's own variables begin anew with each task.
    A worker keeps one such thing: what an earlier operator left there goes when the next one begins.
    """
    kept = sys.__dict__.setdefault("_kept_in_worker", {})
    if key not in kept:
        kept.clear()
        pa.default_memory_pool().release_unused()
        kept[key] = make()
    return kept[key]


def text_ranges(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about so many bytes."""
    return byte_batches(pc.binary_length(texts).to_pylist(), most)


def byte_batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with about so many bytes; a larger row is a range of its own."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)

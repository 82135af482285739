"""Tables written in the order of their pages, so that a page is read from the files that hold it.

Files hold neighbouring rows in order. An index has one row a file: where in the order it begins, how many rows it
holds and its last row's order columns. A page by number is found by the positions, a page behind a known row by
the last rows; either reads the files that overlap it, however far down it is, and ranks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a file.
FILE_ROWS = 100_000
#: (column, whether it descends). Null is the least value, as Spark sorts it.
Order = Sequence[tuple[str, bool]]


def _sorting(order: Order) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order]


def write(rows: DataFrame, path: str, order: Order, file_rows: int = FILE_ROWS) -> None:
    """Writes rows and index below ``path``. The order columns must tell all rows apart."""
    spark = rows.sparkSession
    by = _sorting(order)
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    last = F.max_by(F.struct(*[F.col(c) for c, _ in order]), F.col("_metadata.row_index")).alias("last")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n"), last)
    numbers = [F.regexp_extract("name", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)")]
    before = F.sum("n").over(W.orderBy(*numbers).rowsBetween(W.unboundedPreceding, -1))  # one row a file
    files.select("file", "n", "last", F.coalesce(before, F.lit(0)).alias("start")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def total(spark: SparkSession, path: str) -> int:
    return _index(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page(spark: SparkSession, path: str, skip: int, limit: int) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of the order, with their ``position`` from zero, in any order."""
    held = _index(spark, path).where((F.col("start") < skip + limit) & (F.col("start") + F.col("n") > skip)).collect()
    return _rows(spark, path, {r.file: r.start for r in held}, skip, limit)


def _rows(spark: SparkSession, path: str, starts: dict[str, int], skip: int, limit: int) -> DataFrame:
    stored = spark.read.parquet(f"{path}/rows")
    if not starts:
        return stored.withColumn("position", F.lit(0).cast("bigint")).limit(0)
    some = spark.read.schema(stored.schema).parquet(*starts)
    position = reduce(
        lambda c, f: F.when(F.col("_metadata.file_path") == f, F.col("_metadata.row_index") + starts[f]).otherwise(c), starts, F.lit(None).cast("bigint")
    )
    return some.withColumn("position", position).where(F.col("position").between(skip, skip + limit - 1))


def _behind(row: dict, order: Order, at: str = "") -> Column:
    """Whether the order columns come behind those of a row."""
    found = F.lit(False)
    for c, down in reversed(list(order)):
        mine, its = F.col(f"{at}{c}"), F.lit(row[c])
        if row[c] is None:
            beyond = F.lit(False) if down else mine.isNotNull()
        else:
            beyond = (mine < its) | mine.isNull() if down else F.coalesce(mine > its, F.lit(False))
        found = F.coalesce(beyond, F.lit(False)) | (mine.eqNullSafe(its) & found)
    return found


def page_behind(spark: SparkSession, path: str, order: Order, row: dict, limit: int) -> DataFrame:
    """The ``limit`` rows that come behind a row given by its order columns, whether it is still there or not."""
    index = _index(spark, path)
    first = index.where(_behind(row, order, "last.")).orderBy("start").first()
    if first is None:
        return _rows(spark, path, {}, 0, 0)
    here = _rows(spark, path, {first.file: first.start}, first.start, first.n)
    skip = first.start + first.n - here.where(_behind(row, order)).count()  # rows of this file only
    return page(spark, path, skip, limit)

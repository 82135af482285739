"""A table of versions that is updated in place: a repeated or half-written batch changes nothing.

A batch writes its rows into the folder of its version, whole: what an earlier try left there goes. It counts
from the moment its commit marker stands beside the rows, and is not written again after that. A reader takes
the committed versions only, and of each key the row of the latest one. ``compacted`` writes what a reader
sees as one version, before which nothing is read any more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators.topk import first_per_key

#: Folders that rows are put in by a hash of the search, so that the results of one are read from one of them.
BUCKETS = 64
MARKER = re.compile(r"^(\d+)(-base)?$")


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, path: str) -> list[int]:
    """The versions to be read, from the latest compacted one."""
    store, folder = _folder(spark, f"{path}/commits")
    if not store.exists(folder):
        return []
    found = [m for x in store.listStatus(folder) if (m := MARKER.match(x.getPath().getName()))]
    start = max((int(m[1]) for m in found if m[2]), default=0)
    return sorted({int(m[1]) for m in found if int(m[1]) >= start})


def _mark(spark: SparkSession, path: str, name: str) -> None:
    store, marker = _folder(spark, f"{path}/commits/{name}")
    store.create(marker, False).close()  # an existing one is an error: two writers of one version


def bucket_of(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def upsert(
    rows: DataFrame,
    path: str,
    version: int,
    keys: Sequence[str],
    order: Sequence[Column],
    before_commit: Callable[[], None] | None = None,
    base: bool = False,
) -> bool:
    """Puts rows into the table as a version; of rows with the same keys the first in the given order.

    Rows of older versions with the same keys are replaced, others stay. Versions count from 1 and may be committed in any
    order. Returns whether anything was done: a committed version is left as it is. ``before_commit`` runs when all is
    written and nothing is seen yet.
    """
    spark = rows.sparkSession
    if version < 1:
        raise ValueError("versions count from 1")
    if version in committed(spark, path) or version < min(committed(spark, path), default=1):
        return False
    once = first_per_key(rows, list(keys), list(order)).withColumn("bucket", bucket_of(F.col(keys[0])))
    rebalanced = once.hint("rebalance", F.col("bucket"))
    rebalanced.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={version}")
    if before_commit:
        before_commit()
    _mark(spark, path, f"{version}-base" if base else str(version))
    return True


def snapshot(spark: SparkSession, path: str, keys: Sequence[str], schema: str, first_key=None) -> DataFrame:
    """One row per key, of the latest committed version, with ``version``. Null keys are keys like others.

    ``first_key`` reads one value of the first key, from its folder of each version only.
    """
    versions = committed(spark, path)
    if not versions:
        return spark.createDataFrame([], f"{schema}, version INT")
    folders = [f"{path}/rows/version={v}" for v in versions]
    rows = spark.read.option("basePath", f"{path}/rows").schema(f"{schema}, version INT, bucket INT").parquet(*folders)
    if first_key is not None:
        value = F.lit(first_key)
        rows = rows.where((F.col("bucket") == bucket_of(value)) & (F.col(keys[0]) == value))
    rows = rows.drop("bucket")
    if len(versions) == 1:
        return rows
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("__row"))
    return latest.select(*keys, "__row.*").select(*rows.columns)


def compacted(spark: SparkSession, path: str, keys: Sequence[str], schema: str) -> int | None:
    """Writes the snapshot as a new version that replaces all before it; none where there is at most one."""
    versions = committed(spark, path)
    if len(versions) < 2:
        return None
    rows = snapshot(spark, path, keys, schema).drop("version")
    upsert(rows, path, versions[-1] + 1, keys, [F.lit(0)], base=True)
    return versions[-1] + 1

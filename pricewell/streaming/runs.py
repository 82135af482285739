"""Running a stream over everything available and reading its result as a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pricewell.session import scratch_dir


@contextmanager
def few_state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside split their state into two parts a core, if the session would split it further.

    Every part costs the same in every micro-batch, however few rows come; bounded batches need no more of them.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _until_empty(spark: SparkSession, writer: DataStreamWriter, drain: bool) -> None:
    """Runs until no input is left; ``drain`` asks a source that says step by step how much there is until it has no more."""
    if not drain:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    with few_state_partitions(spark):
        query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def appended(stream: DataFrame, name: str, out: str | None = None, drain: bool = False) -> DataFrame:
    """Appends a stream to a parquet table until no input is left.

    With the same ``out`` a later run goes on where an earlier one ended.
    """
    spark = stream.sparkSession
    out = out or scratch_dir(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/table")
    _until_empty(spark, writer.option("checkpointLocation", f"{out}/checkpoint").outputMode("append"), drain)
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def latest_per_key(stream: DataFrame, keys: Sequence[str], name: str, out: str | None = None, drain: bool = False) -> DataFrame:
    """Runs an updating stream until no input is left; the last row of each key.

    Each micro-batch writes only its changed keys, into a folder of its own that a
    repeated batch overwrites. With the same ``out`` a later run goes on where an earlier one ended.
    """
    spark = stream.sparkSession
    out = out or scratch_dir(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").outputMode("update")
    _until_empty(spark, writer, drain)
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{out}/table")
    last = F.max_by(F.struct(*values), F.col("epoch")).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, "last.*")

"""Good rows and rejects with their reasons, written in one pass over the input."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.session import scratch_dir


def judged(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``reasons``, the names of the rules a row breaks, and ``accepted``: none. A rule that gives null is kept."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("reasons", broken).withColumn("accepted", F.size("reasons") == 0)


def _observed(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("accepted")).alias("rejects")]
    counts += [F.count_if(F.array_contains("reasons", name)).alias(f"rule: {name}") for name in rules]
    seen = Observation()
    return rows.observe(seen, *counts), seen


def write_judged(rows: DataFrame, rules: Mapping[str, Column], path: str) -> dict[str, int]:
    """Writes the rows to ``path`` with good rows and rejects apart; the numbers of rows, of rejects and of each rule.

    The input is computed once: both halves are partitions of one write, and the numbers are counted while it runs.
    """
    watched, seen = _observed(judged(rows, rules), rules)
    watched.write.mode("overwrite").partitionBy("accepted").parquet(path)
    return dict(seen.get)


def read_judged(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the rejects with their ``reasons``."""
    both = spark.read.schema(f"{schema}, reasons ARRAY<STRING>, accepted BOOLEAN").parquet(path)
    columns = T.StructType.fromDDL(schema).names
    return both.where("accepted").select(*columns), both.where("NOT accepted").select(*columns, "reasons")


def stream_judged(
    stream: DataFrame, rules: Mapping[str, Column], name: str, told: Callable[[int, dict[str, int]], None] | None = None
) -> str:
    """The same for a stream until no input is left: each micro-batch has a folder of its own that a repeat overwrites.

    Returns the folder for ``read_judged``. ``told`` is called with each micro-batch's number and counts.
    """
    out = scratch_dir(stream.sparkSession, name)

    def write(batch: DataFrame, epoch: int) -> None:
        counts = write_judged(batch, rules, f"{out}/table/epoch={epoch}")
        if told:
            told(epoch, counts)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return f"{out}/table"

"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pricewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Extra settings are given as keyword arguments with ``__`` for the dots.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may go
    without one and then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="pricewell-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# The scratch folders this driver has handed out and not dropped yet.
_handed_out: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the scratch root; ``drop_scratch`` removes it."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Removes the scratch folders of this driver, once the results that read them are written or collected."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _handed_out:
        path = jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        path.getFileSystem(conf).delete(path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the scratch folder: computed once, however often they are read.

    The table survives the loss of executors and cuts the lineage.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Session, shared storage and the few numeric helpers used everywhere."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "queuemill", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the jobs are written for (clusters bring their own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; only a local session may fall back to /tmp."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="queuemill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write once, read back: reused results survive the loss of executors and carry no lineage. Options are the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Row-heavy work on fewer files than there are cores would leave most of them idle: such a table is dealt out. Larger ones are
    read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def rounded(value: Column, digits: int = 6) -> Column:
    """Half-up rounding without a negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def blank_to_null(value: Column) -> Column:
    """An empty string counts as absent in every decision field."""
    return F.nullif(value, F.lit(""))


def present(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def ratio(num: Column, den: Column) -> Column:
    """NULL over nothing."""
    return F.try_divide(num.cast("double"), den.cast("double"))

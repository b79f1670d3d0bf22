"""Tables that a job writes for itself, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local session (tests, notebooks) gets a fresh local folder, and a cluster,
    whose executors would not see each other's files there, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the stages before. Readers
    get real sizes, so that adaptive joins choose between broadcasting and splitting skewed keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    """For jobs run within: settings of the session, whose own ones come back."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """For jobs run within: so many rows go to Python at a time, as it holds a batch whole and ten thousand large values are too much for a worker.
    The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return settings(spark, {name: min(rows, before) if before > 0 else rows})


def dealt(df: DataFrame, name: str, parts: int) -> Iterator[DataFrame]:
    """`df` written under the shared folder in `parts` parts of about the same size, by a hash of its rows, and read back part by part."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    rows = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    rows.repartition("_part").write.option("compression", "zstd").partitionBy("_part").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    for k in range(parts):
        yield held.where(F.col("_part") == k).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at_rest(df: DataFrame, name: str, key: str, buckets: int = 64, order: str | None = None) -> DataFrame:
    """`df` as a table in buckets of `key`, sorted within them, under the shared folder. Tables of as many buckets of a key are joined by it without a shuffle."""
    spark = df.sparkSession
    full = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).sortBy(order or key).option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/{full}").saveAsTable(full)
    return spark.table(full)

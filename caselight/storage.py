"""Where intermediate tables live between stages of one job."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_WAREHOUSE_KEY = "spark.sql.warehouse.dir"
_PARTS_KEY = "spark.sql.shuffle.partitions"
_MERGE_KEY = "spark.sql.adaptive.coalescePartitions.enabled"
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` names it; where that is unset it is a folder below
    ``spark.sql.warehouse.dir``, which tables need to be shared anyway. The rule
    is the same on every master.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get(_WAREHOUSE_KEY).rstrip("/") + "/_scratch"


def use_checkpoints(spark: SparkSession) -> None:
    """Point RDD checkpoints (boosting cuts lineage with them) at the shared folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark) + "/rdd")


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/caselight-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{_SCOPE.get() or _application_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scoped(spark: SparkSession) -> Iterator[None]:
    """What is written within is deleted at the end, so nothing that still reads
    from there may leave: store the result first."""
    folder = scratch_path(spark, "job")
    before = _SCOPE.set(folder)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        delete(spark, folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete ``path`` in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now. It does so once
    the driver's garbage collector finds them unused, which a driver with little
    to do may put off until the executors' disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written between stages. Call it when
    no result that still reads from there is needed."""
    delete(spark, _application_dir(spark))


@contextmanager
def dealt_to(spark: SparkSession, parts: int) -> Iterator[None]:
    """What runs within shuffles to ``parts`` parts, if that is more than the
    session's number; so what a task holds need not grow with the table."""
    if parts <= int(spark.conf.get(_PARTS_KEY)):
        yield
        return
    wanted = {_PARTS_KEY: str(parts), _MERGE_KEY: "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts the lineage, survives lost executors, keeps column pruning, and gives
    later joins a true size to plan with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_parts(df: DataFrame, name: str, part: str, values: Sequence[int]) -> dict[int, DataFrame]:
    """Write ``df`` once, partitioned by ``part``, and read each of ``values`` as a
    table of its own: a filter on the whole would plan joins by the whole's size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(part).parquet(path)
    schema = df.drop(part).schema
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for value in values:
        at = f"{path}/{part}={value}"
        there = system.exists(spark._jvm.org.apache.hadoop.fs.Path(at))
        out[value] = spark.read.schema(schema).parquet(at) if there else spark.createDataFrame([], schema)
    return out

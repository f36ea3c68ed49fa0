"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def build_session(app: str = "tidemark", cores: str | int = "*", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A local session with the settings the operators expect. On a cluster pass your own session."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    return b.getOrCreate()


def pin_runtime(spark: SparkSession) -> SparkSession:
    """All dates and times in the data are UTC: the entry of every registered query sets the session's zone so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def bounded_listing(spark: SparkSession) -> Iterator[None]:
    """List files with a few tasks a core, also those of streams that run inside.

    Spark starts up to 10,000 tasks, one a folder, and each of them reads the whole Hadoop configuration again, which takes longer than
    listing a small folder.
    """
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path on the shared storage the cluster names in spark.checkpoint.dir.

    A local session without that setting gets one temporary folder of its own, where driver and workers are one
    machine. On a cluster there is no safe default: other executors would not see the files, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a table written to the shared scratch folder.

    For results that several branches of one job read: they are computed once, the lineage ends there, and
    the branches see real sizes when Spark picks their joins. A lost executor only re-reads files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(
    app: str = "tallyguard", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings every job relies on (UTC, AQE, RocksDB state)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder on a cluster. Only where it is
    unset and the master is local is a temporary folder chosen and recorded.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("tallyguard.scratch", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="tallyguard-")
        spark.conf.set("tallyguard.scratch", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Arrow batches have ``rows`` rows at most, for tables of long texts.

    Spark's default of 10,000 rows is made for narrow ones; with texts a batch of it takes
    tens of megabytes in the executor and again in each Python worker. A smaller setting
    of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


_open_scopes: list[list[str]] = []


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a reused intermediate to the shared folder and read it back.

    Cuts the lineage once, so many consumers do not recompute it and a lost
    executor does not lose it.
    """
    path = scratch_path(df.sparkSession, label)
    for scope in _open_scopes:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Remove what ``settle`` writes inside the block when the block ends.

    Only for a block that has written its result elsewhere: tables settled inside
    cannot be read afterwards. Folders go through the file system of their path.
    """
    scope: list[str] = []
    _open_scopes.append(scope)
    try:
        yield
    finally:
        _open_scopes.remove(scope)
        for path in scope:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's scratch space, wherever it is stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

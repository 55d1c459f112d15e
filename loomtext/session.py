"""Session factory and the folders that jobs share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE, Arrow."""
    b = (
        SparkSession.builder.master(master)
        .appName("loomtext")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run on one machine."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if set_dir is None and sc._jsc.sc().getCheckpointDir().isDefined():
        set_dir = sc._jsc.sc().getCheckpointDir().get()
    if set_dir is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "/tmp/checkpoints/loomtext"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(set_dir)
    return set_dir


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loomtext-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames that are made within leave no shuffle files when they have run; by default these stay until the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_scopes: list[list[str]] = []


@contextmanager
def stores_removed(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end; by default it stays until the driver ends."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = workspace(df.sparkSession, name)
    if _scopes:
        _scopes[-1].append(path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint, for small tables."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)

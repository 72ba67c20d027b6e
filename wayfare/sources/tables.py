"""Intermediate tables in the folder that driver and executors share, and deleting them."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Open(threading.local):
    """The scopes that this thread has open, each with the paths that were made in it."""

    def __init__(self):
        self.scopes: list[list[str]] = []
        self.made: list[dict[tuple, DataFrame]] = []


_OPEN = _Open()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="wayfare-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str = "table") -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN.scopes:
        _OPEN.scopes[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df from a written table: what follows reads only the columns it needs, and plans stay small."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """make(), which the open scope runs a single time for a key: its other readers get the same table. Without a scope it is run each time."""
    if not _OPEN.made:
        return make()
    made = _OPEN.made[-1]
    if key not in made:
        made[key] = make()
    return made[key]


def known(key: tuple) -> DataFrame | None:
    """What the open scope has made for the key, if anything."""
    return _OPEN.made[-1].get(key) if _OPEN.made else None


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df as a written lookup table. With at most so many rows it is sent to all tasks, so that the rows it is joined to stay where they are; a larger one is joined as Spark sees fit."""
    table = written(df)
    return F.broadcast(table) if table.count() <= most else table


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """The paths that are made inside; all of them are deleted at its end, also after a failure."""
    _OPEN.scopes.append([])
    _OPEN.made.append({})
    made = _OPEN.scopes[-1]
    try:
        yield made
    finally:
        _OPEN.scopes.pop()
        _OPEN.made.pop()
        for path in made:
            delete(spark, path)


@contextlib.contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Inside, a stage whose code has a method that Java would leave uncompiled (over 8,000 bytes, as rows of many features and their models have) is run operator by operator, in small methods."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives; if it wrote tables on the way, its result is written too and they are deleted."""
    with compiled(spark), scope(spark) as made:
        df = make()
        if not made:
            return df
        path = new_path(spark, "result")
        made.remove(path)  # it outlives this scope, but not one around it
        df.write.option("compression", "zstd").parquet(path)
    if _OPEN.scopes:
        _OPEN.scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)

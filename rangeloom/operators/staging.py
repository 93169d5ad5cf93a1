"""Intermediate tables in the folder that driver and executors share.

A staged table cuts the lineage, so a lost executor costs one stage and not the
whole job, and gives the optimiser the size of its files: joins against it broadcast only
below ``spark.sql.autoBroadcastJoinThreshold`` and are otherwise shuffled on
both sides, where adaptive execution can split a skewed partition. Tables as long as the points are joined
as ``shuffled``, since files say little of rows in memory.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Paths that the open scopes, the innermost last, have staged.
_SCOPES: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ONE_MACHINE = re.compile(r"local(\[.*\])?")


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where that is unset, a session of one machine sets it to a new local folder; a cluster has no such folder, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not _ONE_MACHINE.fullmatch(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rangeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rangeloom-{spark.sparkContext.applicationId}"


def _hadoop_path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    target, files = _hadoop_path(spark, path)
    files.deleteOnExit(target)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the scratch folder and read it again; what was shuffled for it is deleted from the disks."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    if _SCOPES:
        _SCOPES[-1].append(path)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins whose sides are both as long as a point table, which are shuffled and sorted whatever size the optimiser expects.

    It goes by the bytes of the files: rows of a compressed column or of an exploded array take many times that in a broadcast, which the driver holds.
    """
    return df.hint("merge")


def scoped(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, staged; every table that was staged on the way to it is deleted."""
    _SCOPES.append([])
    try:
        out = stage(make(), label)
    finally:
        made = _SCOPES.pop()
    own = _PATHS[out]
    for path in made:
        if path != own:
            target, files = _hadoop_path(out.sparkSession, path)
            files.delete(target, True)
    if _SCOPES:
        _SCOPES[-1].append(own)
    return out


def release(*staged: DataFrame) -> None:
    """Delete the files of tables that ``stage`` has made and whose readers have all run."""
    for df in staged:
        path = _PATHS.pop(df, None)
        if path is not None:
            target, files = _hadoop_path(df.sparkSession, path)
            files.delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Checkpoints and files in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one set on the context. A temporary folder of this
    machine serves only a session that runs in one process on it; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        folder = os.path.join(tempfile.gettempdir(), "scrubline-checkpoints")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def checkpoint(df: DataFrame, narrow: bool = False, joined: bool = False) -> DataFrame:
    """Cut the lineage: rows go to the shared folder, so a lost executor loses nothing. A ``narrow`` table, of few bytes a row, is
    written in as many files as the session has cores, however many partitions it was shuffled to. One that comes out of a
    join is ``joined``: its rows are dealt out once more, since a task that ran many partitions of a join would hold the memory of all."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    cores = max(1, context.defaultParallelism)
    return (df.repartition(cores) if joined else df.coalesce(cores) if narrow else df).checkpoint(eager=True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def opened_folder(spark: SparkSession, path: str) -> str | None:
    """Make the folder of a path by :func:`own_folder`, and return its URI, with which Python workers open it through ``pyarrow.fs``; None where
    they can't, as with a store that only Spark's readers know."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    uri = f"{uri.getScheme()}://{uri.getRawAuthority() or ''}{uri.getRawPath()}"
    try:
        system, inside = fs.FileSystem.from_uri(uri)
        system.create_dir(inside)
    except (OSError, ValueError, NotImplementedError):
        return None
    return uri


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`own_folder`."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

"""Cutting a plan's lineage on shared storage."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without it gets a temporary folder, which goes when Python ends;
    elsewhere a folder of one machine would lose rows, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all machines share.")
        found = tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


_MADE: dict[str, object] = {}


def remove_at_end(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when Python ends, on whatever file system it is."""
    if not _MADE:
        atexit.register(remove_made)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    _MADE[path] = (found, found.getFileSystem(spark._jsc.hadoopConfiguration()))
    return path


def remove_made() -> None:
    """Remove what ``remove_at_end`` was told; tables that still read it must not be asked any more."""
    while _MADE:
        _, (place, system) = _MADE.popitem()
        # The JVM may have gone first; a folder that stays is the caller's to clear.
        with contextlib.suppress(Exception):
            system.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)

"""Tables written to the folder that driver and executors share, so that later steps don't depend on any executor."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The folder of this process, where none is set and none is needed by others.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in this process alone, a temporary folder takes its place and is
    removed at exit. Executors on other machines would not see it, so that on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get("folder")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wayfare-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        _own["folder"] = found
    return found


#: Paths of tables written within the innermost :func:`scratch` that is open in this thread or task.
_open: ContextVar[list[str] | None] = ContextVar("open_scratch", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/wayfare/{name}-{uuid.uuid4().hex}"
    if (paths := _open.get()) is not None:
        paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that is not needed any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def append(df: DataFrame, path: str) -> DataFrame:
    """Add ``df`` to the table at a path and read what was added."""
    part = f"{path}/part={uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(part)
    return df.sparkSession.read.schema(df.schema).parquet(part)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes within are removed at its end: what is needed later is to be written elsewhere, not left lazy."""
    paths: list[str] = []
    token = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            remove(spark, path)

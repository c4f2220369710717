"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir of the session.

    Only where that is unset, as in tests on one machine, a temporary folder of our own is used; on a cluster,
    whose machines don't share one, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share, for the master is {master}")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quillon-"))
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/quillon"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


def stash(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back.

    This cuts lineage: whatever executor is lost later, the rows are read, not computed again. Within
    ``scratch`` the table goes with it, unless it is ``kept``.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if _SCRATCH and not kept:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stashed in it: for whoever writes a result in it that doesn't read them any more."""
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stash`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"{shared_folder(spark).split(':', 1)[-1].lstrip('/')}/" in folder:
            _delete(spark, folder)

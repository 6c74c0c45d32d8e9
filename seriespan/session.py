"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings that affect results; leave sizing to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster job fails, because
    executors do not see each other's disks. Only where the driver is the sole machine (unit
    tests) a temporary folder stands in, and goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="seriespan-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it from there.

    Cuts the lineage of results that many later steps use, survives the loss of
    executors, and gives the planner real sizes to choose joins by. Only for results
    much smaller than the data.
    """
    path = f"{_settled(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _settled(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/settled/{spark.sparkContext.applicationId}"


def clear_settled(spark: SparkSession) -> None:
    """Delete what this application has settled, once no result that reads it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_settled(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

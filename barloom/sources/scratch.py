"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a finished job's shuffle files are deleted at once; without it they stay until the driver happens to collect garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where it is unset and all runs on one machine, a fresh folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table there: what several branches of a plan read is worked out once, and survives lost executors.

    Nothing reads the shuffle files of the job that wrote it, so they go with it.
    """
    session = df.sparkSession
    path, before = f"{shared_folder(session)}/{name}-{uuid.uuid4().hex}", session.conf.get(CLEANED, "false")
    session.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        session.conf.set(CLEANED, before)
    return session.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete tables of saved(), once nothing reads them any more."""
    for table in tables:
        session = table.sparkSession
        for folder in {path.rpartition("/")[0] for path in table.inputFiles()}:
            at = session._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

"""Tables in the shared folder that the cluster names: computed once, read many times, lineage cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset and Spark runs in this process alone, a temporary one;
    on a cluster an executor's own disk would not be seen by the others, so there it has to be set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders that this driver has made and not deleted.
_made: list[str] = []


def fresh_place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; :func:`forget_all` deletes it."""
    path = f"{scratch_dir(spark)}/tidewatch/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, outlives executors, and cuts the lineage. ``options`` go to the writer."""
    path = fresh_place(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Deletes a table made by :func:`written` that nothing will read again."""
    for name in df.inputFiles()[:1]:
        delete(df.sparkSession, name.rsplit("/", 1)[0])


def forget_all(spark: SparkSession) -> None:
    """Deletes every folder that this driver has made here: for the end of a job, when no result of it will be read any more."""
    while _made:
        delete(spark, _made.pop())

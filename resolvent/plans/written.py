"""Tables written once and read again: they cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a folder of its own that goes when Python
    ends; on a cluster that is an error, as executors couldn't see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="resolvent-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join, both sides of which are shuffled: for rows that grow with the input.

    Spark takes exploded rows, and columns that pack well in files, for much smaller than they are, and would broadcast them through the driver.
    """
    return df.hint("merge")


#: Where the written tables are that someone still holds.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back. What no result reads later goes by discard(); the rest is left to the owner of that folder."""
    path = f"{shared_folder(df.sparkSession)}/resolvent/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again: all that was made of them is written."""
    for t in tables:
        if path := _WRITTEN.pop(t, None):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

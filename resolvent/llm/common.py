"""What the operators share: the shared folder, written intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import shared_folder

#: Words everywhere in this subpackage: maximal runs of anything but these six ASCII characters.
#: bytes.split() without arguments splits UTF-8 at exactly this set.
SPACE = " \t\n\x0b\x0c\r"

#: A key of a join is heavy if it has more than 1 / HEAVY of all rows, and more than LIGHT rows: fewer than HEAVY keys are, whatever the table.
HEAVY, LIGHT = 4_000, 1_000


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that reach Python, by bytes and by rows, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Where the written intermediate tables are that someone still holds.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back.

    Every executor can read it again after another is lost. A table that the caller's result reads
    lazily is left for whoever owns the shared folder to clear; others go by discard().
    """
    path = f"{shared_folder(df.sparkSession)}/resolvent/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing will read again: all that was made of them is written."""
    for t in tables:
        if t is not None and (path := _WRITTEN.pop(t, None)):
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def heavy(counts: DataFrame, keys: list[str], count: str, rows: int) -> DataFrame | None:
    """The heavy keys of a table of keys and their rows, `rows` in all: fewer than HEAVY. None if there are none."""
    found = materialize(counts.where(F.col(count) > max(LIGHT, rows // HEAVY)).select(*keys), "heavy")
    if found.isEmpty():
        discard(found)
        return None
    return found


def join_split(left: DataFrame, right: DataFrame, keys: list[str], heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are unique. Rows of heavy keys stay where they are: of right, fewer than HEAVY rows are broadcast for them."""
    if heavy is None:
        return left.join(right, keys, how)
    few = F.broadcast(heavy)
    light = left.join(few, keys, "left_anti").join(right, keys, how)
    return light.unionByName(left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how))


def plain(docs: DataFrame, *own: str) -> DataFrame:
    """docs with all columns but doc_id, text and those in own named by their place, so that no name can clash or needs quotes.

    `.toDF(*docs.columns)` gives the names back.
    """
    keep = {"doc_id", "text", *own}
    return docs.toDF(*[c if c in keep else f"column_{k}" for k, c in enumerate(docs.columns)])


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The two columns that an operator reads, so that no other column of docs can clash with its own."""
    return plain(docs, *more).select(F.col("doc_id"), F.col("text").cast("string").alias("text"), *more)


def bucket(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo modulus: how the folds are dealt."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus

"""The ledger as versioned snapshots: a commit writes its folders and then claims the next revision's marker, which only one writer can.

A marker lists the folders of every table, so a revision shares with the one before what it didn't write.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.written import written

#: Parts of a merged table that can be written by themselves.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed the revision first."""


class Store:
    """Tables of a run under one path, in any file system that Spark reaches.

    A snapshot counts once its marker exists. Markers are created without overwrite, so of two
    writers from one revision, one gets a Conflict; nothing of the winner is touched.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def revision(self) -> int:
        markers = self._path(f"{self.path}/_markers")
        if not self._fs.exists(markers):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(markers) if s.getPath().getName().isdigit()), default=0)

    def read(self, table: str, revision: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in sorted(set(self._manifest(revision or self.revision())[table].values()))])

    def _manifest(self, revision: int) -> dict[str, dict[str, str]]:
        """table -> bucket -> folder of a revision; a table that was written whole has the bucket "" alone."""
        if not revision:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/_markers/{revision}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _claim(self, manifest: dict[str, dict[str, str]], base: int) -> int:
        try:
            out = self._fs.create(self._path(f"{self.path}/_markers/{base + 1}"), False)
        except Exception as e:
            raise Conflict(f"revision {base + 1} is taken") from e
        out.writeUTF(json.dumps(manifest))
        out.close()
        return base + 1

    def _begin(self, base: int) -> str:
        if self.revision() != base:
            raise Conflict(f"revision {self.revision()} is not {base}")
        return f"rev={base + 1}-{uuid.uuid4().hex}"

    def commit(self, tables: dict[str, DataFrame], base: int) -> int:
        """Writes these tables whole as the revision after base; others stay as they are. Conflict if base isn't the latest, or stops being so."""
        where = self._begin(base)
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{where}/{name}")
        return self._claim(self._manifest(base) | {name: {"": f"{where}/{name}"} for name in tables}, base)

    def merge(self, table: str, updates: DataFrame, keys: list[str], base: int, kept: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> int:
        """Writes a revision of one table in which updates replace the rows of their keys and add the others.

        kept(old, new) says, by functions from a column's name to the stored and the new one, which stored rows an update doesn't
        replace. Rows are dealt by their keys over BUCKETS buckets, and only buckets with an update are
        written again; a table that isn't bucketed yet is written whole. updates have a row per key
        and the table's columns. Keys are compared null-safe. Without updates the revision has the same folders.
        """
        where, manifest = self._begin(base), self._manifest(base)
        folders, columns = manifest.get(table, {}), updates.columns
        at = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(BUCKETS)).cast("int")
        dealt = written(updates.withColumn("bucket", at), "updates")  # read twice
        touched = {str(r.bucket) for r in dealt.select("bucket").distinct().collect()}  # BUCKETS at most
        old = sorted({f for b, f in folders.items() if not b or b in touched})
        if not touched and "" not in folders:
            return self._claim(manifest, base)
        if old:
            found = self.spark.read.parquet(*[f"{self.path}/{x}" for x in old]).select(columns).withColumn("bucket", at)
            x, y = found.select(F.struct("*").alias("old")), dealt.select(F.struct("*").alias("new"))
            same = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in (*keys, "bucket")]
            keep = F.lit(False) if kept is None else kept(lambda c: F.col(f"old.{c}"), lambda c: F.col(f"new.{c}"))
            stays = F.col("new").isNull() | (F.col("old").isNotNull() & F.coalesce(keep, F.lit(False)))
            dealt = x.join(y, functools.reduce(lambda a, b: a & b, same), "full").select(F.when(stays, F.col("old")).otherwise(F.col("new")).alias("r")).select("r.*")
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{where}/{table}")
        whole = set(map(str, range(BUCKETS))) if "" in folders else touched
        have = {s.getPath().getName().removeprefix("bucket=") for s in self._fs.listStatus(self._path(f"{self.path}/{where}/{table}")) if s.isDirectory()}
        fresh = {b: f"{where}/{table}/bucket={b}" for b in whole & have}
        return self._claim(manifest | {table: {b: f for b, f in folders.items() if b} | fresh}, base)

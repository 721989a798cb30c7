"""Shared identifiers: who shares one, and what the sharing means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdict


def shared_ids(held: DataFrame) -> DataFrame:
    """(ordinal, db, id, name) -> db, id, n, distinct names, for ids held by more than one feature."""
    return held.groupBy("db", "id").agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("name"))).alias("n_names"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).where("n > 1")


def pairs(held: DataFrame) -> DataFrame:
    """Pairs of different names on one id, compared: names are collapsed first, so a much-shared id costs its names squared, not its holders."""
    names = held.groupBy("db", "id", F.trim("name").alias("name")).agg(F.count("*").alias("n"))
    a, b = names.select("db", "id", F.col("name").alias("a")), names.select("db", "id", F.col("name").alias("b"))
    both = a.join(b, ["db", "id"]).where("a < b")
    return verdict.judged(both, "a", "b").select("db", "id", "a", "b", "v.verdict", "v.conflicts")


def severity(held: DataFrame, class_level: DataFrame) -> DataFrame:
    """db, id, n, severity: duplicate-name, class-id-shared (with evidence in class_level: ordinal, db, id) or collision."""
    evidence = class_level.select("ordinal", "db", "id").distinct().withColumn("known", F.lit(True))
    rows = held.join(evidence, ["ordinal", "db", "id"], "left").groupBy("db", "id").agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("name"))).alias("n_names"), F.coalesce(F.bool_or("known"), F.lit(False)).alias("known")).where("n > 1")
    return rows.select("db", "id", "n", F.when(F.col("n_names") == 1, "duplicate-name").when(F.col("known"), "class-id-shared").otherwise("collision").alias("severity"))

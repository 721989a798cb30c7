"""Where outside files and services are: settings of the session, else a default that must be there."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "spark.resolvent."
#: Whether sources may go to the network or start processes; off unless the session says so.
OUTSIDE = PREFIX + "outside.enabled"


def there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def asset(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """The setting spark.resolvent.<name> as it is given, else the default if it exists, else None."""
    found = spark.conf.get(PREFIX + name, None)
    if found:
        return found
    return default if default and there(spark, default) else None


def outside_allowed(spark: SparkSession) -> bool:
    return (spark.conf.get(OUTSIDE, None) or "false").lower() == "true"

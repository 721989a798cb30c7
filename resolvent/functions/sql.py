"""The functions for use in Spark SQL: scalars as SQL UDFs, which Catalyst inlines, and spellings as a table function (Spark's Arrow ones can't stand in a lateral join)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .variants import variants

#: SQL functions: their arguments, type and body, the same rules as functions.ids has for columns.
SCALARS = {
    "pad_hmdb": ("x STRING", "STRING", "CASE WHEN trim(x) RLIKE '(?i)^HMDB0*[0-9]+$' THEN concat('HMDB', lpad(regexp_extract(trim(x), '(?i)^HMDB0*([0-9]+)$', 1), greatest(7, length(regexp_extract(trim(x), '(?i)^HMDB0*([0-9]+)$', 1))), '0')) ELSE x END"),
    "with_chebi": ("x STRING", "STRING", "CASE WHEN startswith(upper(x), 'CHEBI:') THEN x ELSE concat('CHEBI:', x) END"),
    "present": ("x STRING", "STRING", "CASE WHEN trim(x) NOT IN ('', 'NA', 'null', 'None') THEN trim(x) END"),
    "canonical_id": ("db STRING, x STRING", "STRING", "CASE db WHEN 'hmdb' THEN pad_hmdb(present(x)) WHEN 'chebi' THEN with_chebi(present(x)) ELSE present(x) END"),
    "feature_id": ("n BIGINT", "STRING", "concat('M', lpad(CAST(n AS STRING), greatest(4, length(CAST(n AS STRING))), '0'))"),
}


class _Spellings:
    def eval(self, name: str):
        yield from enumerate(variants(name))


def register(spark: SparkSession) -> None:
    """Makes SCALARS and the table function spellings(name) -> position, variant known to a session; once more changes nothing."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f'CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}')
    spark.udtf.register("spellings", F.udtf(_Spellings, returnType="position int, variant string"))

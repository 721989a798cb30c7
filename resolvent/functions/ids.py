"""Identifier columns: canonical accessions, base ids of model species, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_HMDB = "(?i)^HMDB0*([0-9]+)$"


def pad_hmdb(c: Column) -> Column:
    """HMDB accessions with seven digits at least; anything else as it is."""
    digits = F.regexp_extract(F.trim(c), _HMDB, 1)
    return F.when(digits == "", c).otherwise(F.concat(F.lit("HMDB"), F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0"))))


def chebi(c: Column) -> Column:
    """With the CHEBI: prefix."""
    return F.when(F.upper(c).startswith("CHEBI:"), c).otherwise(F.concat(F.lit("CHEBI:"), c))


def missing(c: Column) -> Column:
    """Null for what counts as no value: empty, NA, null, None."""
    return F.when(~c.isin("", "NA", "null", "None"), c)


def canonical(db: Column, c: Column) -> Column:
    c = missing(F.trim(c))
    return F.when(db == "hmdb", pad_hmdb(c)).when(db == "chebi", chebi(c)).otherwise(c)


def with_canonical(df: DataFrame, db: str, raw: str, out: str) -> DataFrame:
    """df with canonical(db, raw) as `out`, for tables of many rows: in steps, so that the value is cleaned and its digits found once."""
    clean, digits = F.col(f"_{out}_clean"), F.col(f"_{out}_digits")
    rows = df.withColumn(f"_{out}_clean", missing(F.trim(raw))).withColumn(f"_{out}_digits", F.when(F.col(db) == "hmdb", F.regexp_extract(clean, _HMDB, 1)))
    padded = F.concat(F.lit("HMDB"), F.lpad(digits, F.greatest(F.lit(7), F.length(digits)), F.lit("0")))
    value = F.when(digits != "", padded).when((F.col(db) == "chebi") & ~F.upper(clean).startswith("CHEBI:"), F.concat(F.lit("CHEBI:"), clean)).otherwise(clean)
    return rows.withColumn(out, value).drop(f"_{out}_clean", f"_{out}_digits")


def canonical_list(db: Column, ids: Column) -> Column:
    """Canonical, blanks dropped, each once, in the order given."""
    return F.array_distinct(F.array_compact(F.transform(ids, lambda x: canonical(db, x))))


def listed(c: Column) -> Column:
    """An annotation as an array: one id, or a JSON list of ids; null and blanks give none."""
    many = F.when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return F.filter(F.coalesce(many, F.expr("cast(array() as array<string>)")), lambda x: F.coalesce(x, F.lit("")) != "")


def ambiguous(targets: Column) -> Column:
    """Of a map namespace -> ids, the namespaces with more than one."""
    return F.map_filter(targets, lambda _, v: F.size(v) > 1)


def base_id(species: Column, compartment: Column) -> Column:
    """A species id without its compartment: by the compartment's own name, else _x or _xx, else one last letter."""
    cut = F.regexp_replace(F.substring(species, F.lit(1), F.length(species) - F.length(compartment)), "_+$", "")
    by_name = (compartment != "") & species.endswith(compartment) & (F.length(species) > F.length(compartment))
    suffix = F.regexp_extract(species, "^(.+?)_([a-z]{1,2})$", 1)
    return F.when(by_name, F.coalesce(F.nullif(cut, F.lit("")), species)).when(suffix != "", suffix).otherwise(F.regexp_replace(species, "[a-z]$", ""))


def repaired(c: Column) -> Column:
    """Without trailing _ and -; null if nothing changes or nothing is left."""
    out = F.regexp_replace(c, "[_-]+$", "")
    return F.when((out != c) & (out != ""), out)


def feature_id(ordinal: Column) -> Column:
    n = ordinal.cast("string")
    return F.concat(F.lit("M"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0")))


def fingerprint(offenders: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(offenders), "|"), 256), 1, 16)

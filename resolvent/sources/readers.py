"""Connectors: name lists, tables with a preamble, ledgers, models and recorded payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.written import written
from ..vocab import NO_RECORDS

LEDGER_SCHEMA = 2


def column(found: DataFrame, name: str | None = None) -> DataFrame:
    """A column of a sheet as text, the first one by default, without nulls: the one column `name`."""
    return found.select(F.col("`" + (name or found.columns[0]).replace("`", "``") + "`").cast("string").alias("name")).where("name is not null")


def names(found: DataFrame, column: str, start: int = 0) -> DataFrame:
    """A column of names as features: blanks dropped, ordinals from `start` in the order of the rows' own number.

    `found` needs a unique `row` column for the order; only it is sorted. The ranges are written
    before they are counted and numbered, so both see the same ones, and no single task numbers them all.
    """
    kept = found.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) != "").select("row", F.col(column).cast("string").alias("name"))
    ranged = written(kept.repartitionByRange("row").withColumn("part", F.spark_partition_id()), "ranges")
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = offsets.alias("a").join(offsets.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    w = Window.partitionBy("part").orderBy("row")
    k = F.col("before") + F.row_number().over(w) - 1 + start
    return ranged.join(before, "part").select(k.alias("ordinal"), ids.feature_id(k).alias("feature_id"), "name")


def table(spark: SparkSession, path: str, sep: str = "\t", header_row: int = 0) -> DataFrame:
    """A delimited file whose header is on line `header_row`; the lines above, and empty ones, are dropped.

    Lines are numbered within the parts that Spark reads a file in; the header must be in the first.
    A value doesn't go over the end of its line.
    """
    if not header_row:
        return spark.read.csv(path, sep=sep, header=True)
    lines = spark.read.text(path).withColumn("k", F.monotonically_increasing_id())
    head = lines.where(F.col("k") == header_row).first()["value"].rstrip("\r").split(sep)
    rows = lines.where((F.col("k") > header_row) & (F.rtrim("value") != "")).select(F.from_csv(F.regexp_replace("value", "\r$", ""), ", ".join(f"c{k} string" for k in range(len(head))), {"sep": sep}).alias("c"))
    return rows.select("c.*").toDF(*head)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON ledger of any known version, upgraded: one row per feature.

    Version 1 keeps plain flag names in `_flags` and base ids with a dangling mark; both are mended.
    """
    entry = "struct<original_name: string, final_class: string, confidence: string, accepted: map<string, string>, gem_mam: array<string>, _flags: array<string>, flags: map<string, struct<raised: array<struct<ts: string, tool: string, evidence: string>>>>>"
    raw = spark.read.schema(f"schema_version int, revision int, entries map<string, {entry}>").option("multiLine", True).json(path)
    rows = raw.select(F.coalesce("schema_version", F.lit(1)).alias("was"), F.coalesce("revision", F.lit(0)).alias("revision"), F.explode("entries").alias("feature_id", "e"))
    mended = F.transform("e.gem_mam", lambda x: F.coalesce(ids.repaired(x), x))
    raised = F.coalesce(F.map_keys("e.flags"), F.col("e._flags"), F.expr("cast(array() as array<string>)"))
    return rows.select("feature_id", "e.original_name", "e.final_class", "e.confidence", "e.accepted", mended.alias("mam"), F.array_sort(raised).alias("flags"), "revision", F.lit(LEDGER_SCHEMA).alias("schema_version"), (F.col("was") < LEDGER_SCHEMA).alias("migrated"))


def model(spark: SparkSession, path: str) -> DataFrame:
    """Species of a JSON model in model order; annotations may be one id or a list."""
    notes = F.from_json(F.get_json_object("x", "$.annotation"), "map<string, string>")
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.metabolites"), "array<string>")).alias("ordinal", "x"))
    text = lambda k: F.get_json_object("x", f"$.{k}")
    return raw.select("ordinal", text("id").alias("species_id"), F.coalesce(text("compartment"), F.lit("")).alias("compartment"), text("name").alias("name"), text("formula").alias("formula"), text("charge").cast("int").alias("charge"), *[ids.listed(notes[k]).alias(d) for d, k in (("kegg", "kegg.compound"), ("hmdb", "hmdb"), ("chebi", "chebi"))])


_SPECIES = "_id string, _name string, _compartment string, `_fbc:chemicalFormula` string, `_fbc:charge` int, annotation string"
_TERM = r"identifiers\.org/%s[/:]([^\"'<>\s]+)"


def model_xml(spark: SparkSession, path: str) -> DataFrame:
    """Species of an SBML model: id, name, compartment, formula, charge, and ids from the links of its annotation."""
    raw = spark.read.format("xml").option("rowTag", "species").schema(_SPECIES).load(path)
    links = lambda kind: F.array_distinct(F.regexp_extract_all(F.coalesce("annotation", F.lit("")), F.lit(_TERM % kind), F.lit(1)))
    return raw.select(F.col("_id").alias("species_id"), F.coalesce("_compartment", F.lit("")).alias("compartment"), F.col("_name").alias("name"), F.col("`_fbc:chemicalFormula`").alias("formula"), F.col("`_fbc:charge`").alias("charge"), *[links(k).alias(d) for d, k in (("kegg", r"kegg\.compound"), ("hmdb", "hmdb"), ("chebi", "chebi"))])


_PROPERTIES = "PropertyTable struct<Properties: array<struct<CID: bigint, MolecularFormula: string, InChIKey: string, IUPACName: string, MonoisotopicMass: string>>>"
_SYNONYMS = "InformationList struct<Information: array<struct<CID: bigint, Synonym: array<string>>>>"


_NO_NAMES = "cast(array() as array<string>)"


def compound(payloads: DataFrame, key: str = "query") -> DataFrame:
    """query or cid, properties, synonyms (JSON) -> the first record, its mass as a number, and 25 names at most; found = false on a miss."""
    p = F.get(F.from_json("properties", _PROPERTIES)["PropertyTable"]["Properties"], F.lit(0))
    s = F.get(F.from_json("synonyms", _SYNONYMS)["InformationList"]["Information"], F.lit(0))["Synonym"]
    found = p.isNotNull()
    return payloads.select(
        key, found.alias("found"), p["CID"].cast("string").alias("pubchem"), p["InChIKey"].alias("inchikey"), p["MolecularFormula"].alias("formula"), p["IUPACName"].alias("iupac"),
        p["MonoisotopicMass"].try_cast("double").alias("mass"), F.when(found, F.slice(F.coalesce(s, F.expr(_NO_NAMES)), 1, 25)).otherwise(F.expr(_NO_NAMES)).alias("names"),
    )


# Keys of a term's facts, in the order they are tried.
FORMULA_KEYS = ["generalized_empirical_formula", "formula", "Formula"]
MASS_KEYS, INCHIKEY_KEYS = ["monoisotopic_mass", "mass"], ["inchi_key_string", "inchikey"]


def term(payloads: DataFrame) -> DataFrame:
    """id, payload (JSON of a ChEBI term) -> id with its prefix, found, names (label, then synonyms), formula, mass, inchikey: of each fact the first key that isn't empty, of a list the first value."""
    one = F.get_json_object("payload", "$._embedded.terms[0]")
    facts = F.from_json(F.get_json_object(one, "$.annotation"), "map<string, string>")

    def fact(keys: list[str]) -> Column:
        values = [F.when(facts[k].startswith("["), F.get(F.from_json(facts[k], "array<string>"), F.lit(0))).otherwise(facts[k]) for k in keys]
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])

    said = F.concat(F.array(F.get_json_object(one, "$.label")), F.coalesce(F.from_json(F.get_json_object(one, "$.synonyms"), "array<string>"), F.expr(_NO_NAMES)))
    names = F.filter(said, lambda x: F.coalesce(x, F.lit("")) != "")
    return payloads.select(ids.chebi(F.trim("id")).alias("id"), one.isNotNull().alias("found"), F.when(one.isNotNull(), names).otherwise(F.expr(_NO_NAMES)).alias("names"), fact(FORMULA_KEYS).alias("formula"), fact(MASS_KEYS).try_cast("double").alias("mass"), fact(INCHIKEY_KEYS).alias("inchikey"))


def fetch(asked: DataFrame, records: dict[str, DataFrame], failed: DataFrame | None = None) -> DataFrame:
    """asked(db, id) -> db, id, found, names, formula, note, error, by the records (id, names, formula) of each database.

    An id without a record is a row with found = false, and so is one of `failed` (db, id, error),
    whose answer couldn't be had. hmdb has no records; any other database is an error.
    """
    asked = asked.select(F.lower("db").alias("db"), "id").where("id is not null").distinct()
    known = None
    for db, df in records.items():
        part = df.select(F.lit(db).alias("db"), "id", "names", "formula")
        known = part if known is None else known.unionByName(part)
    out = asked.join(known, ["db", "id"], "left")
    out = out.join(failed, ["db", "id"], "left") if failed is not None else out.withColumn("error", F.lit(None).cast("string"))
    error = F.when(~F.col("db").isin(*records, "hmdb"), F.concat(F.lit("unsupported db "), "db")).otherwise(F.col("error"))
    out = out.withColumn("error", error).withColumn("names", F.when(F.col("error").isNull(), F.col("names")))
    return out.select("db", "id", F.col("names").isNotNull().alias("found"), F.coalesce("names", F.expr(_NO_NAMES)).alias("names"), F.when(F.col("names").isNotNull(), F.col("formula")).alias("formula"), F.when(F.col("db") == "hmdb", F.lit(NO_RECORDS)).alias("note"), "error")


def dblink(lines: Column, key: str) -> Column:
    """The trimmed value of the first line `key:` of a record's links; null without one."""
    return F.trim(F.regexp_replace(F.get(F.filter(lines, lambda x: x.startswith(f"{key}:")), F.lit(0)), f"^{key}:", ""))


def term_search(payloads: DataFrame) -> DataFrame:
    """query, payload (JSON search answer) -> hits with an id, exact names first, else in order."""
    docs = F.from_json("payload", "response struct<docs: array<struct<label: string, obo_id: string>>>")["response"]["docs"]
    hits = payloads.select("query", F.posexplode(docs).alias("pos", "d")).where("coalesce(d.obo_id, '') <> ''")
    exact = F.lower(F.trim("d.label")) == F.lower(F.trim("query"))
    w = Window.partitionBy("query").orderBy(exact.desc(), "pos")
    return hits.select("query", F.col("d.obo_id").alias("chebi"), F.col("d.label").alias("name"), exact.alias("exact"), F.row_number().over(w).alias("place"))


def model_label(path: str) -> str:
    """The file's name up to its first dot."""
    return path.rsplit("/", 1)[-1].split(".")[0]


def model_label_of(path: Column) -> Column:
    """model_label of a column of paths."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)

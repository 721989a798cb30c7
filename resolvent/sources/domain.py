"""The domain tables as a deterministic projection of the generated tables.

Features come from `part`, candidates from `lineitem`, decisions from `events`, model species from
`customer`, cross-references from `orders`. Each function reads only the columns it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.written import shuffled
from ..vocab import NAMESPACES, PRIMARY, SOURCES, TIERS, VERDICTS

NAMES = [
    "Taurochenodeoxycholic acid", "Urocortisol", "Tetrahydrocortisol", "LysoPC(P-16:0)", "1-Acyl-sn-glycero-3-phosphocholine", "LysoPC(16:0)",
    "LysoPC(16:0/0:0)", "LysoPC(18:2/0:0)", "nLc4Cer", "Lc3Cer", "15-HETE", "5,15-DiHETE", "N1-Acetylspermine", "N1-Acetylspermidine",
    "TMAO(trimethylamine N-oxide)", "Butyryl carnitine", "2-PG/3-PG", "Phosphoenolpyruvate=PEP", "Creatine monohydrate", "Tributyl phosphate",
    "Trifluoroacetic acid", "Diethyl phthalate", "4-Nitrophenol", "Lauryl sulfate", "α-Ketoglutaric acid", "β-Alanine",
    "4-(Dimethylamino)benzoic acid", "Glucose 6-phosphate", "  D-Glucose ", "Glycochenodeoxycholic acid",
]
FORMULAS = ["C6H12O6", "C2H7NO3S", "C24H50NO7P", "C26H43NO5", "C20H32O3", "C16H32O2", "C10H26N4", "c5h11no2s", "RCO2", "HO4C4H5"]
RATIONALES = [
    "", "ok", "guess", "exact name match", "reviewed against its record", " see the note ", "a typo in the name, spelled right in the record",
    "BridgeDb promotes the PubChem id", "isomer pair, told apart by its record", "an antibiotic drug by its record", "dietary, from plants",
    "HMDB backfill (BridgeDb)", "re-bridge of the id", "mobile phase additive",
]
ACTIONS = {"view": "backcheck", "signup": "accept", "purchase": "auto_accept", "error": "exclude", "click": "isomer_guard"}
ORIGINS = ["endogenous", "diet", "drug", "industrial", "additive", "martian"]
RELATIONS = ["exact", "class-proxy", "isomer-surrogate", "model-scope-absent", "id-gap"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, feature_id, name"""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, pick(NAMES, F.floor(k / 2) % len(NAMES))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select(k.alias("ordinal"), ids.feature_id(k).alias("feature_id"), name.alias("name"))


def candidates(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """ordinal, seq, source, db, raw_id, id (canonical, null if missing), note, formula, query (the name or `db:id` that was asked for, or empty); placed: and file, row, the place in the table, as seq can repeat."""
    n = F.col("l_suppkey") * 20 + F.col("l_partkey") % 20
    text = n.cast("string")
    padded = lambda k: F.lpad(text, F.greatest(F.lit(k), F.length(text)), F.lit("0"))
    even = F.col("l_linenumber") % 2 == 0
    which = F.col("l_suppkey") % 5
    raw = (
        F.when(F.col("l_orderkey") % 50 == 0, F.lit("NA"))
        .when(which == 0, F.concat(F.lit("C"), padded(5)))
        .when(which == 1, F.concat(F.lit("HMDB"), F.when(even, padded(5)).otherwise(padded(7))))
        .when(which == 2, F.when(even, F.concat(F.lit("CHEBI:"), text)).otherwise(text))
        .when(which == 3, text)
        .otherwise(F.concat(F.lit("KEY"), text, F.lit("-N")))
    )
    order = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4) + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    line = F.col("l_linenumber")
    asked = F.when(line == 7, "").when(line == 3, F.concat(F.lit("chebi:"), text)).otherwise(pick(NAMES, (F.col("l_suppkey") * 7 + F.col("l_partkey")) % len(NAMES)))
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), pick(SOURCES, order).alias("source"),
        pick(NAMESPACES, which).alias("db"), raw.alias("raw_id"), pick(NAMES, (F.col("l_suppkey") + F.col("l_partkey")) % len(NAMES)).alias("note"),
        F.when(~even, pick(FORMULAS, F.col("l_suppkey") % len(FORMULAS))).alias("formula"), asked.alias("query"),
        *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []),
    )
    return ids.with_canonical(rows, "db", "raw_id", "id")


#: Which ids were found and not accepted: the hmdb ids of some features, the primary ids of others, all of a few.
UNACCEPTED = "ordinal % 11 = 3 and db = 'hmdb' or ordinal % 31 = 5 and db in ('kegg', 'hmdb') or ordinal % 37 = 6"


def accepted(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """ordinal, db, id: the candidate of least (seq, id) per namespace; some features are pending, some ids weren't accepted, a few were made up. found: candidates() that are there already."""
    best = (candidates(spark, sf_dir) if found is None else found).where("id is not null and ordinal % 9 <> 8").where(f"not ({UNACCEPTED})").groupBy("ordinal", "db").agg(F.min(F.struct("seq", "id")).alias("b"))
    return best.select("ordinal", "db", F.when((F.col("db") == "kegg") & (F.col("ordinal") % 17 == 0), F.lit("C99999")).otherwise(F.col("b.id")).alias("id"))


def derive_class(kegg: Column, hmdb: Column, structure: Column) -> Column:
    return F.when(kegg.isNotNull(), PRIMARY[0]).when(hmdb.isNotNull(), PRIMARY[1]).when(structure, "structure-only").otherwise("unmapped")


def entries(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """One row per feature: ids by namespace, final_class, confidence, origin, relation, curated rationale, model species."""
    wide = (accepted(spark, sf_dir) if held is None else held).groupBy("ordinal").pivot("db", NAMESPACES).agg(F.min("id"))
    k = F.col("ordinal")
    rows = shuffled(features(spark, sf_dir)).join(wide, "ordinal", "left")
    structure = F.coalesce(*NAMESPACES[2:]).isNotNull()
    final = F.when(k % 9 == 8, F.lit(None)).when(k % 23 == 0, "xenobiotic-excluded").when(k % 19 == 0, "exogenous").otherwise(derive_class(F.col("kegg"), F.col("hmdb"), structure))
    relation = F.when(k % 6 < 5, pick(RELATIONS, k % 6))
    return rows.select(
        "ordinal", "feature_id", "name", *NAMESPACES, final.alias("final_class"), F.when(k % 8 < 7, pick(TIERS, k % 8)).alias("confidence"),
        F.when(k % 4 != 3, pick(ORIGINS, F.floor(k / 4) % len(ORIGINS))).alias("origin"), relation.alias("relation"),
        F.when(k % 3 == 0, "chosen because its chain matches").otherwise("short").alias("rationale"),
        F.when(relation.isin("exact", "class-proxy", "isomer-surrogate"), F.concat(F.lit("MAM"), F.lpad((F.floor(k / 2) % 400).cast("string"), 5, "0"))).alias("mam"), (k % 3 == 0).alias("curated"),
    )


def decisions(spark: SparkSession, sf_dir: str, held: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """events: a stream of the events in place of their table. ordinal, seq, ts, action, db, id, verdict, db_resolution, rationale; two ids of three are the accepted one of their namespace."""
    k = F.col("event_id")
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    rows = (read(spark, sf_dir, "events") if events is None else events).select(
        F.col("user_id").alias("ordinal"), k.alias("seq"), "ts", action.alias("action"), pick(NAMESPACES, k % 5).alias("db"),
        pick(RATIONALES, k % len(RATIONALES)).alias("rationale"), F.col("props"),
    )
    held = (accepted(spark, sf_dir) if held is None else held).withColumnRenamed("id", "held")
    check = F.col("action") == "backcheck"
    return rows.join(held, ["ordinal", "db"], "left").select(
        "ordinal", "seq", "ts", "action", "db", F.when((F.col("seq") % 3 != 0) & F.col("held").isNotNull(), F.col("held")).otherwise(F.concat(F.lit("X"), F.col("seq"))).alias("id"),
        F.when(check, pick(VERDICTS, F.col("seq") % 4)).alias("verdict"), F.when(check, F.when(F.col("seq") % 7 == 0, "class").otherwise("species")).alias("db_resolution"), "rationale", "props",
    )


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, species_id, compartment, name, formula, charge, mass, kegg, hmdb, chebi"""
    k = F.col("c_custkey")
    b = F.floor(k / 3)
    text = b.cast("string")
    place = pick(["c", "m", "e"], k % 3)
    xref = (b * 5).cast("string")
    return read(spark, sf_dir, "customer").select(
        k.alias("ordinal"), F.concat(F.lit("MAM"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0")), F.when(k % 2 == 0, "_").otherwise(""), place).alias("species_id"),
        F.when(k % 5 != 4, place).otherwise("").alias("compartment"), F.when(k % 4 != 1, F.concat(pick(NAMES, b % len(NAMES)), F.when(b >= len(NAMES), F.concat(F.lit(" "), (b % 40).cast("string"))).otherwise(""))).otherwise("").alias("name"),
        F.when(k % 7 != 3, pick(FORMULAS, b % len(FORMULAS))).alias("formula"), (k % 3 - 1).cast("int").alias("charge"), (F.col("c_acctbal") + 1100.0).alias("mass"),
        F.when(b % 2 == 0, F.concat(F.lit("C"), F.lpad(xref, F.greatest(F.lit(5), F.length(xref)), F.lit("0")))).alias("kegg"),
        F.when(b % 3 == 0, F.concat(F.lit("HMDB"), F.lpad(xref, F.greatest(F.lit(7), F.length(xref)), F.lit("0")))).alias("hmdb"),
        F.when(b % 5 == 0, F.concat(F.lit("CHEBI:"), xref)).alias("chebi"),
    )


#: Reasons that calls on the model are given, from too short to full.
REASONS = ["fits", "its chain fits", "the only one of its class in the model", "reviewed against its record"]


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ordinal, mam (array of ids), relation, rationale: a call on the model for every feature, and some for none."""
    k = F.col("p_partkey")
    base = lambda c: F.concat(F.lit("MAM"), F.lpad((1 + c % 40).cast("string"), 5, "0"))
    in_c = F.concat(F.lit(" "), base(k), F.when((1 + k % 40) % 2 == 0, "_c ").otherwise("c "))
    none = F.expr("cast(array() as array<string>)")
    mam = F.when(k % 5 == 0, none).when(k % 5 == 2, F.array(in_c)).when(k % 5 == 3, F.array(base(k), base(k + 7))).when(k % 10 == 4, F.array(base(k), F.concat(F.lit("MAM9"), k.cast("string")))).otherwise(F.array(base(k)))
    return read(spark, sf_dir, "part").select(F.when(k % 41 == 0, -k).otherwise(k).alias("ordinal"), mam.alias("mam"), pick([*RELATIONS, "same as"], F.floor(k / 2) % 6).alias("relation"), pick(REASONS, F.floor(k / 7) % 4).alias("rationale"))


def ledgers(spark: SparkSession, sf_dir: str, run: int = 100) -> DataFrame:
    """run, value: JSON ledgers of `run` features each with their candidates, decisions and flags; every second one of version 1, with flags as bare names and dangling base ids. Candidates of equal seq stand as in their table."""
    of = lambda df, by, *c: df.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct(*by, F.to_json(F.struct(*c)).alias("x")))), lambda x: F.parse_json(x["x"])).alias("x"))
    c = of(candidates(spark, sf_dir, placed=True), ["seq", "file", "row"], "source", *[F.when(F.col("db") == d, F.col("id")).alias(d) for d in NAMESPACES], "formula", F.col("note").alias("name"), "query").withColumnRenamed("x", "candidates")
    d = of(decisions(spark, sf_dir), ["seq"], "action", "rationale", F.col("ts").cast("string").alias("ts"), "db", "id").withColumnRenamed("x", "decisions")
    k, at = F.col("ordinal"), F.expr(f"ordinal div {run}")
    old, digits = at % 2 == 1, at.cast("string")
    flags = F.array_compact(F.array(F.when(k % 3 == 0, "class_level_id"), F.when(k % 5 == 0, "old_flag")))
    records = F.map_from_entries(F.transform(flags, lambda x: F.struct(x, F.struct(F.array(F.struct(F.lit("before").alias("ts"))).alias("raised")))))
    held = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(x).alias("k"), F.col(x).alias("v")) for x in NAMESPACES])), lambda _, v: v.isNotNull())
    none = F.from_json(F.lit("[]"), "array<variant>")
    e = entries(spark, sf_dir).join(c, "ordinal", "left").join(d, "ordinal", "left").select(
        "ordinal", F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), F.lit("0")).alias("run"), "feature_id",
        F.struct(
            F.col("name").alias("original_name"), "final_class", "confidence", "origin", held.alias("accepted"), F.coalesce("candidates", none).alias("candidates"), F.coalesce("decisions", none).alias("decisions"),
            F.when(F.col("mam").isNotNull(), F.array(F.when(old, F.concat("mam", F.lit("_"))).otherwise(F.col("mam")))).alias("gem_mam"), F.when(old, flags).alias("_flags"), F.when(~old, records).alias("flags"), "ordinal",
        ).alias("e"),
    )
    whole = e.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "e"))).alias("entries"), F.max("ordinal").alias("o"))
    return whole.select("run", F.to_json(F.struct(F.when(F.expr(f"o div {run}") % 2 == 1, 1).otherwise(2).alias("schema_version"), F.col("run").alias("made_by"), "entries")).alias("value"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_db, src_id, hmdb: cross-references, some of them to several accessions or in several spellings."""
    c = F.col("o_custkey")
    text, target = c.cast("string"), F.floor(F.col("o_orderkey") / 4).cast("string")
    padded = lambda x, k: F.lpad(x, F.greatest(F.lit(k), F.length(x)), F.lit("0"))
    kind = c % 4
    return read(spark, sf_dir, "orders").select(
        F.when(kind == 0, "kegg").when(kind == 1, "chebi").when(kind == 2, "pubchem").otherwise("inchikey").alias("src_db"),
        F.when(kind == 0, F.concat(F.lit("C"), padded(text, 5))).when((kind == 1) & (c % 3 == 0), F.concat(F.lit("CHEBI:"), text)).when(kind < 3, text).otherwise(F.concat(F.lit("KEY"), text, F.lit("-N"))).alias("src_id"),
        F.concat(F.lit("HMDB"), F.when(F.col("o_orderkey") % 2 == 0, padded(target, 5)).otherwise(padded(target, 7))).alias("hmdb"),
    )


def compound_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, properties, synonyms: recorded answers about a compound, as JSON; of some there is no answer, or no names."""
    k = F.col("p_partkey")
    text = k.cast("string")
    properties = F.concat(F.lit('{"PropertyTable":{"Properties":[{"CID":'), text, F.lit(',"MolecularFormula":"'), pick(FORMULAS, k % len(FORMULAS)), F.lit('","InChIKey":"KEY'), text, F.lit('-N","IUPACName":"'), F.col("p_name"), F.lit('","MonoisotopicMass":"'), (k % 900 + 100).cast("string"), F.lit('.0634"}]}}'))
    names = F.transform(F.sequence(F.lit(1), (k % 40 + 1).cast("int")), lambda i: F.concat(F.lit('"name '), i.cast("string"), F.lit('"')))
    synonyms = F.concat(F.lit('{"InformationList":{"Information":[{"CID":'), text, F.lit(',"Synonym":['), F.array_join(names, ","), F.lit("]}]}}"))
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("query"), k.alias("cid"), F.when(k % 7 != 0, properties).alias("properties"), F.when(k % 5 != 0, synonyms).alias("synonyms"))


def term_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, payload: recorded answers about a ChEBI term, as JSON, with the formula under any of its keys; some are empty."""
    k = F.col("p_partkey")
    text = k.cast("string")
    formula = F.concat(F.lit('"'), pick(["generalized_empirical_formula", "formula", "Formula", "other"], k % 4), F.lit('":'), F.when(k % 2 == 0, F.concat(F.lit('["'), pick(FORMULAS, k % len(FORMULAS)), F.lit('","X"]'))).otherwise(F.concat(F.lit('"'), pick(FORMULAS, k % len(FORMULAS)), F.lit('"'))))
    facts = F.concat(F.lit("{"), formula, F.lit(',"monoisotopic_mass":["'), (k % 900 + 100).cast("string"), F.lit('.5"],"inchikey":'), F.when(k % 3 == 0, "[]").otherwise(F.concat(F.lit('["KEY'), text, F.lit('-N"]'))), F.lit("}"))
    term = F.concat(F.lit('{"label":"'), F.col("p_name"), F.lit('","synonyms":["'), F.col("p_brand"), F.lit('",""],"annotation":'), facts, F.lit("}"))
    payload = F.when(k % 11 == 0, F.lit('{"_embedded":{"terms":[]}}')).when(k % 13 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"_embedded":{"terms":['), term, F.lit("]}}")))
    return read(spark, sf_dir, "part").select(F.when(k % 2 == 0, text).otherwise(F.concat(F.lit("CHEBI:"), text)).alias("id"), payload.alias("payload"))


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, payload: recorded search answers, as JSON, for every distinct name of a feature; some hits are without an id."""
    c = candidates(spark, sf_dir).where("source = 'chebi-ols4' and id is not null").drop("query").join(features(spark, sf_dir).select("ordinal", F.col("name").alias("query")), "ordinal")
    chebi = F.when(F.col("db") == "inchikey", "").when(F.col("db") == "chebi", F.col("id")).otherwise(F.concat(F.lit("CHEBI:"), (F.col("seq") % 1000).cast("string")))
    docs = c.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("note").alias("label"), chebi.alias("obo_id")))).alias("docs"))
    return docs.select("query", F.to_json(F.struct(F.struct("docs").alias("response"))).alias("payload"))

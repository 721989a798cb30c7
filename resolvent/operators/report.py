"""Coverage, intersections, before and after, provenance and source annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import ids, names
from ..plans.written import written
from ..vocab import CAUSES, CLASSES, EXCLUDED, MAPPED_RELATIONS, NAMESPACES, PRIMARY, ROUTES
from .resolve import ACCEPTING, allocate, reason_category


def coverage(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """metric, value, denom, pct: every class of the vocabulary and `pending`, with zero where there is none; metrics; model relations.

    The entries are read once: they are counted by class and relation, and a few rows go on.
    """
    counts = entries.groupBy("final_class", "relation").agg(F.count("*").alias("n"), F.count("kegg").alias("kegg"), F.count("hmdb").alias("hmdb"))
    cls, rel, n = F.col("final_class"), F.col("relation"), F.col("n")
    some = lambda condition: F.when(F.coalesce(condition, F.lit(False)), n).otherwise(0)
    cases = {
        "#total": n, "primary_usable": some(cls.isin(PRIMARY)), "has_kegg": F.col("kegg"), "has_hmdb": F.col("hmdb"), "gem_mapped": some(rel.isin(MAPPED_RELATIONS)),
        "gem_species_level": some(rel == "exact"), "exogenous": some(cls == "exogenous"), "xenobiotic_excluded": some(cls == EXCLUDED),
    }
    own = [F.struct(F.concat(F.lit("class:"), F.when(cls.isin(CLASSES), cls).otherwise("pending")).alias("metric"), n.alias("value")), F.struct(F.concat(F.lit("gem_relation:"), rel).alias("metric"), n.alias("value"))]
    rows = counts.select(F.explode(F.array(*own, *[F.struct(F.lit(k).alias("metric"), v.cast("long").alias("value")) for k, v in cases.items()])).alias("x")).select("x.*").where("metric is not null")
    none = spark.createDataFrame([(c, 0) for c in [*(f"class:{c}" for c in [*CLASSES, "pending"]), *cases]], "metric string, value long")
    summed = rows.unionByName(none).groupBy("metric").agg(F.sum("value").alias("value"))
    total = F.max(F.when(F.col("metric") == "#total", F.col("value"))).over(Window.partitionBy(F.lit(0)))  # a row per metric
    out = summed.withColumn("denom", total).where("metric <> '#total'")
    return out.select("metric", "value", "denom", F.coalesce(F.round(F.try_divide(100.0 * F.col("value"), "denom"), 1), F.lit(0.0)).alias("pct"))


def membership(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per analysable feature, the least id of each namespace, accepted or candidate, and has_ columns."""
    kept = entries.where(F.coalesce("final_class", F.lit("pending")) != EXCLUDED).select("ordinal", "feature_id", *NAMESPACES)
    held = kept.select("ordinal", F.expr("stack(5, %s) as (db, id)" % ", ".join(f"'{d}', {d}" for d in NAMESPACES))).where("id is not null")
    least = held.unionByName(candidates.where("id is not null").select("ordinal", "db", "id")).groupBy("ordinal").pivot("db", NAMESPACES).agg(F.min("id"))
    out = kept.select("ordinal", "feature_id").join(least, "ordinal", "left")
    return out.select("feature_id", *NAMESPACES, *[F.col(d).isNotNull().alias(f"has_{d}") for d in NAMESPACES])


def intersections(members: DataFrame) -> DataFrame:
    """Features per exact combination of namespaces."""
    has = [f"has_{d}" for d in NAMESPACES]
    return members.groupBy(*has).agg(F.count("*").alias("n"), F.min("feature_id").alias("first"))


def totals(members: DataFrame) -> DataFrame:
    """namespaces, size, n, kind: the features that have all of a set of namespaces, for every set that some feature has. One pass: the exact combinations, at most 32, are rolled up by a cube."""
    has = [f"has_{d}" for d in NAMESPACES]
    rolled = members.groupBy(*has).agg(F.count("*").alias("c")).cube(*has).agg(F.sum("c").alias("n"))
    inclusive = rolled.where(" and ".join(f"coalesce({h}, true)" for h in has))  # of each namespace those that have it, or all
    size = sum(F.coalesce(h, F.lit(False)).cast("int") for h in has)
    kind = F.when(size == 0, "total").when(size == len(has), "all_five").when(size == 1, "with_id").otherwise("intersection")
    return inclusive.select(F.concat_ws(";", *[F.when(F.col(h), F.lit(d)) for h, d in zip(has, NAMESPACES)]).alias("namespaces"), size.alias("size"), "n", kind.alias("kind"))


def most_common(said: DataFrame) -> DataFrame:
    """list, value, ordinal -> list, value, n, first, rank: per list the commonest first, of equals the one that came first."""
    w = Window.partitionBy("list").orderBy(F.col("n").desc(), "first")
    return said.groupBy("list", "value").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).withColumn("rank", F.row_number().over(w))


def improvement(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """metric, baseline, after: features with an id per namespace, with a primary one and in the model, by the first pass alone and at the end; and the classes at the end."""
    first = candidates.where("id is not null and source = 'metaboanalyst'").groupBy("ordinal").pivot("db", NAMESPACES).agg(F.lit(True)).select("ordinal", *[F.coalesce(d, F.lit(False)).alias(f"b_{d}") for d in NAMESPACES])
    union = membership(entries, candidates).select("feature_id", *[F.col(f"has_{d}") for d in NAMESPACES])
    rows = entries.join(first, "ordinal", "left").join(union, "feature_id", "left")
    yes = lambda c: F.count_if(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False)))
    any_first, in_model, cls = F.col("b_kegg") | F.col("b_hmdb"), F.col("mam").isNotNull(), F.col("final_class")
    pairs = [("primary", yes(any_first), yes(cls.isin(PRIMARY))), *[(d, yes(f"b_{d}"), yes(f"has_{d}")) for d in NAMESPACES], ("model", yes(in_model & any_first), yes(in_model))]
    pairs += [(f"class:{c}", F.lit(0).cast("long"), yes(cls == c)) for c in ("structure-only", "exogenous", EXCLUDED)]
    one = rows.agg(F.array(*[F.struct(F.lit(m).alias("metric"), b.alias("baseline"), a.alias("after")) for m, b, a in pairs]).alias("x"))
    return one.select(F.explode("x").alias("x")).select("x.*")


def master(entries: DataFrame, candidates: DataFrame, decisions: DataFrame, states: DataFrame, model: str) -> DataFrame:
    """The master table, one row per feature: name and normal form, class, origin, tier, ids, model result, open flags, and how many candidates and decisions there are. Absent values are empty."""
    open_ = states.where("state = 'open'").groupBy("ordinal").agg(F.array_join(F.array_sort(F.collect_set("flag")), ";").alias("flags"))
    n_candidates, n_decisions = (df.groupBy("ordinal").agg(F.count("*").alias(c)) for df, c in ((candidates, "n_candidates"), (decisions, "n_decisions")))
    rows = names.normalized(entries, "name", "n").join(open_, "ordinal", "left").join(n_candidates, "ordinal", "left").join(n_decisions, "ordinal", "left")
    blank = lambda c, name=None: F.coalesce(F.col(c), F.lit("")).alias(name or c)
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    cause = F.when(~F.col("relation").isin(MAPPED_RELATIONS), F.col("relation"))
    return rows.select(
        "feature_id", F.col("name").alias("original_name"), blank("n.normalized", "normalized"), blank("final_class"), blank("origin"), blank("confidence"), *[blank(d) for d in NAMESPACES],
        F.when(F.col("relation").isNotNull(), model).otherwise("").alias("gem_model"), blank("mam", "gem_mam"), blank("relation", "gem_relation"), F.coalesce(cause, F.lit("")).alias("gem_cause"), blank("flags"), none("n_candidates"), none("n_decisions"),
    )


def logics(decisions: DataFrame) -> DataFrame:
    """Per entity, of the rationales of accepting decisions: the first, the first that is no bridging or backfill, and the first that is or names hmdb."""
    low = F.lower("rationale")
    bridged = F.col("rationale").contains("re-bridge")
    first = lambda c: F.min(F.when(c, F.struct("seq", "rationale")))["rationale"]
    own = decisions.where(F.col("action").isin(ACCEPTING)).withColumn("rationale", F.coalesce("rationale", F.lit("")))
    return own.groupBy("ordinal").agg(first(F.lit(True)).alias("first_logic"), first(~bridged & ~F.col("rationale").contains("backfill")).alias("kegg_logic"), first(low.contains("hmdb") | bridged | low.contains("backfill")).alias("hmdb_logic"))


def is_name(query: Column) -> Column:
    """Whether a query is a name: not empty, and not an id after its namespace."""
    return (query != "") & ~query.rlike(f"^({'|'.join(NAMESPACES)}):")


def recovered(entries: DataFrame, candidates: DataFrame, decisions: DataFrame, db: str) -> DataFrame:
    """Features with an id of a namespace of which the first pass had none at all: by which name, record, route and logic it was found."""
    had = candidates.where((F.col("source") == "metaboanalyst") & (F.col("db") == db) & F.col("id").isNotNull()).select("ordinal").distinct()
    found = candidates.where((F.col("source") != "metaboanalyst") & (F.col("db") == db)).groupBy("ordinal", "id").agg(F.min(F.struct("seq", "source", "query", "note")).alias("c"))
    rows = entries.where(f"{db} is not null").withColumn("id", F.col(db)).join(had, "ordinal", "left_anti").join(found, ["ordinal", "id"], "left").join(logics(decisions), "ordinal", "left")
    rows = names.normalized(rows.select("ordinal", "feature_id", "name", "id", "c", f"{db}_logic", "first_logic"), "name", "n")
    route = F.coalesce(*[F.when(F.col("c.source") == k, F.lit(v)) for k, v in ROUTES.items()], F.col("c.source"), F.lit("?"))
    logic = F.col("kegg_logic") if db == "kegg" else F.coalesce("hmdb_logic", "first_logic")
    return rows.select("ordinal", "feature_id", F.col("name").alias("original_name"), F.coalesce(F.when(is_name(F.col("c.query")), F.col("c.query")), "n.normalized", F.lit("")).alias("harmonized_name"), "id", F.coalesce("c.note", F.lit("")).alias("note"), route.alias("route"), F.coalesce(logic, F.lit("")).alias("logic"))


def cause(original: Column, logic: Column, route: Column) -> Column:
    """Why the first pass missed a name, by the logic and the route that found it, else by its form."""
    low, o = F.lower(logic), original
    typo, short, form, synonym, combined, vendor = map(F.lit, CAUSES)
    return (
        F.when(low.contains(V.TYPO), typo)
        .when(F.lower(route).contains(V.VENDOR_ROUTE) | low.contains(V.VENDOR_LOGIC), vendor)
        .when(low.rlike("|".join(V.COMBINED)) | o.contains("/"), combined)
        .when(o.rlike(V.SHORT_AFTER_EQUALS) | names.strip(o).rlike(V.SHORT_ALONE) | o.rlike(V.SHORT_IN_BRACKETS), short)
        .when((F.lower(o).contains("carnitine") & o.contains(" ")) | o.rlike(V.HYPHENATED_PHOSPHATE) | o.startswith(V.MISSPELT_START), form)
        .otherwise(synonym)
    )


def causes(recovered: DataFrame) -> DataFrame:
    """place, cause, n, and the first and last feature, of the recovered ones; in report order."""
    rows = recovered.select("feature_id", cause(F.col("original_name"), F.col("logic"), F.col("route")).alias("cause"))
    place = F.coalesce(*[F.when(F.col("cause") == c, F.lit(k)) for k, c in enumerate(CAUSES)])
    return rows.groupBy("cause").agg(F.count("*").alias("n"), F.min("feature_id").alias("first"), F.max("feature_id").alias("last")).select(place.alias("place"), "cause", "n", "first", "last")


def _ids(columns: list[str]) -> Column:
    return F.concat_ws(";", *[F.when(F.col(d).isNotNull(), F.concat(F.lit(f"{d}:"), d)) for d in columns])


def set_apart(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Exogenous entries that are kept and those that are excluded: category, ids, whether the model has the former, and the reason."""
    rows = entries.where(F.col("final_class").isin("exogenous", EXCLUDED)).join(history, "ordinal", "left").withColumn("reason", F.coalesce("last_call", "last_rationale", F.lit("")))
    in_model = F.when(F.col("final_class") == "exogenous", F.when(F.col("mam").isNotNull(), "in-model").when(~F.col("relation").isin(MAPPED_RELATIONS), F.col("relation")).otherwise(""))
    return rows.select("feature_id", F.col("name").alias("original_name"), "final_class", reason_category(F.col("origin"), F.col("name"), F.col("reason")).alias("category"), _ids(["kegg", "hmdb", "chebi", "pubchem"]).alias("ids"), in_model.alias("gem_xref"), "reason")


def unmapped(entries: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries without a primary id: the queries that were tried, the structure ids there are, and the first logic."""
    tried = candidates.where("query <> ''").groupBy("ordinal").agg(F.array_join(F.array_sort(F.collect_set("query")), " | ").alias("tried"))
    rows = entries.where(F.col("final_class").isin("structure-only", "unmapped")).join(tried, "ordinal", "left").join(logics(decisions), "ordinal", "left")
    reason = F.coalesce(F.nullif("first_logic", F.lit("")), F.lit("no KEGG/HMDB returned by any source"))
    return rows.select("feature_id", F.col("name").alias("original_name"), F.coalesce("tried", F.lit("")).alias("harmonized_names_tried"), "final_class", _ids(["chebi", "pubchem", "inchikey"]).alias("structure_ids"), reason.alias("reason"))


def model_curation(entries: DataFrame, species: DataFrame, model: str) -> DataFrame:
    """The model's answer for each entry that has one or should have: species, relation, names, whether it was curated, and why."""
    relation = F.coalesce("relation", F.when(F.col("mam").isNotNull(), "unspecified").when(F.col("final_class").isin(*PRIMARY, "exogenous"), "not-evaluated"))
    rows = entries.withColumn("relation", relation).where("relation is not null").join(species.select(F.col("base").alias("mam"), F.array_join("names", ";").alias("gem_name")), "mam", "left")
    has = F.col("relation") != "not-evaluated"
    return rows.select("feature_id", F.col("name").alias("original_name"), F.when(has, model).otherwise("").alias("model"), F.coalesce("mam", F.lit("")).alias("mam"), "relation", F.coalesce("gem_name", F.lit("")).alias("gem_name"), F.when(F.col("curated"), "yes").otherwise("no").alias("curated"), F.when(has, F.col("rationale")).otherwise("").alias("rationale"))


ANNOTATION = ["final_class", "origin", "confidence", *NAMESPACES, "gem_mam", "gem_relation"]


def annotate(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Source rows with ten ID_ columns of the last feature of the same trimmed, lower-cased name, and whether there is one. Absent values are empty."""
    named = entries.withColumnsRenamed({"mam": "gem_mam", "relation": "gem_relation"})
    last = named.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.max(F.struct("ordinal", *ANNOTATION)).alias("e"))
    return rows.withColumn("key", F.lower(F.trim(column))).join(last, "key", "left").select(*rows.columns, *[F.coalesce(F.col(f"e.{d}"), F.lit("")).alias(f"ID_{d}") for d in ANNOTATION], F.col("e").isNotNull().alias("ID_matched"))


def best_column(rows: DataFrame, columns: list[str], entries: DataFrame) -> DataFrame:
    """Which column's values overlap the ledger's names most; the first of equals."""
    known = entries.select(F.lower(F.trim("name")).alias("key")).distinct()
    parts = [rows.select(F.lit(k).alias("place"), F.lit(c).alias("column"), F.lower(F.trim(F.col(c).cast("string"))).alias("key")) for k, c in enumerate(columns)]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    counts = long.join(known.withColumn("hit", F.lit(1)), "key", "left").groupBy("place", "column").agg(F.count("hit").alias("overlap"))
    return counts.select("column", "overlap", (F.rank().over(Window.orderBy(F.col("overlap").desc(), "place")) == 1).alias("chosen"))


def reassemble(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """kegg and hmdb by precedence: accepted, else recovered elsewhere, else the exact source; blank if excluded."""
    def best(db: str, exact: bool):
        op = "=" if exact else "<>"
        return candidates.where(f"id is not null and db = '{db}' and source {op} 'metaboanalyst'").groupBy("ordinal").agg(F.min(F.struct("seq", "id"))["id"].alias(f"{db}_{int(exact)}"))

    out = entries
    for db in ("kegg", "hmdb"):
        out = out.join(best(db, True), "ordinal", "left").join(best(db, False), "ordinal", "left")
    pick = lambda db: F.when(F.coalesce(F.col("final_class"), F.lit("")) == EXCLUDED, "").otherwise(F.coalesce(db, f"{db}_0", f"{db}_1", F.lit("")))
    return out.select("feature_id", pick("kegg").alias("kegg"), pick("hmdb").alias("hmdb"))


def next_step(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    counts = entries.agg(F.count("*").alias("n"), F.count_if(F.col("final_class").isNull()).alias("pending")).join(F.broadcast(candidates.agg(F.count("*").alias("c"))))
    return counts.select("n", "pending", F.when(F.col("n") == 0, "ingest_names").when(F.col("c") == 0, "exact_match").when(F.col("pending") > 0, "gather_evidence").otherwise("model_or_finalize").alias("step"))


#: Namespaces that lead to an hmdb accession, and classes that may gain one.
BACKFILL_FROM = ["inchikey", "kegg", "chebi", "pubchem"]
GAINING = ["KEGG-mapped", "structure-only", "exogenous"]


def backfill(entries: DataFrame, candidates: DataFrame, bridge: DataFrame) -> DataFrame:
    """ordinal, targets, ambiguous: the hmdb accessions that entries without one may take, in order.

    First those of its own candidates, in order, then what the bridge knows for its ids: per
    namespace the accepted id, else that of the first candidate. ambiguous: for one of these ids the
    bridge knows several.
    """
    gaps = entries.where(F.col("final_class").isin(GAINING)).where("hmdb is null")
    first = candidates.where(F.col("id").isNotNull() & F.col("db").isin(BACKFILL_FROM)).groupBy("ordinal", "db").agg(F.min(F.struct("seq", "id"))["id"].alias("candidate"))
    accepted = gaps.select("ordinal", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(d).alias("db"), F.col(d).alias("accepted")) for k, d in enumerate(BACKFILL_FROM)])).alias("x")).select("ordinal", "x.*")
    asked = accepted.join(first, ["ordinal", "db"], "left").select("ordinal", "place", "db", F.coalesce("accepted", "candidate").alias("id")).where("id is not null")
    keyed = bridge.select(F.col("src_db").alias("db"), ids.canonical(F.col("src_db"), F.col("src_id")).alias("id"), ids.pad_hmdb(F.col("hmdb")).alias("target")).distinct()
    met = asked.join(keyed, ["db", "id"]).groupBy("ordinal", "place").agg(F.array_sort(F.collect_set("target")).alias("t"))
    bridged = met.groupBy("ordinal").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"])).alias("bridged"), F.bool_or(F.size("t") > 1).alias("ambiguous"))
    own = candidates.where("db = 'hmdb' and id is not null").join(gaps.select("ordinal"), "ordinal", "left_semi").groupBy("ordinal", "id").agg(F.min("seq").alias("seq"))
    own = own.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "id"))), lambda x: x["id"]).alias("own"))
    none = F.expr("cast(array() as array<string>)")
    out = gaps.select("ordinal").join(own, "ordinal", "left").join(bridged, "ordinal", "left")
    return out.select("ordinal", F.array_distinct(F.concat(F.coalesce("own", none), F.coalesce("bridged", none))).alias("targets"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def backfilled(entries: DataFrame, candidates: DataFrame, bridge: DataFrame) -> DataFrame:
    """ordinal, outcome, target: what each entry without an accession gains. No accession goes to two entries, nor one that another entry has; where the bridge is ambiguous nothing is taken."""
    found = written(backfill(entries, candidates, bridge), "backfill")
    taken = entries.where("hmdb is not null").select(F.col("hmdb").alias("target")).distinct()
    options = found.where("not ambiguous").select("ordinal", F.posexplode("targets").alias("place", "target"))
    free = options.join(taken, "target", "left_anti").groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("targets"))
    got = allocate(free.select(F.lit(0).cast("long").alias("run"), "ordinal", "targets")).select("ordinal", "target")
    outcome = F.when(F.col("ambiguous"), "ambiguous").when(F.col("target").isNotNull(), "gained").when(F.size("targets") > 0, "taken by another").otherwise("nothing found")
    return found.join(got, "ordinal", "left").select("ordinal", outcome.alias("outcome"), "target")

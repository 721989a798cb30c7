"""Names to identifiers: exact lookup, clean-up, class and decision rules, crosswalks, allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, names, verdict
from ..plans.written import discard, shuffled, written
from ..vocab import CLASS_OF_ORIGIN, CLASSES, EXCLUDED, INDIRECT, LEGACY_CLASSES, NAMESPACES, ORIGINS, PRIMARY, REASON_WORDS


ACCEPTING = ["accept", "auto_accept"]
#: Databases that are asked by name.
ASKED = ["kegg", "pubchem", "chebi"]


def ingest(found: DataFrame) -> DataFrame:
    """feature_id, name, its normal form, tags of non-biological classes."""
    return names.normalized(found, "name", "n").select("feature_id", "name", "n.*", names.contaminant_tags(F.col("name")).alias("tags"))


def name_index(candidates: DataFrame) -> DataFrame:
    """name -> first id of each namespace that the exact-match source gave; names trimmed and lower-cased."""
    rows = candidates.where("source = 'metaboanalyst' and id is not null").select(F.lower(F.trim("note")).alias("key"), "db", "seq", "id")
    first = rows.groupBy("key", "db").agg(F.min(F.struct("seq", "id")).alias("b"))
    return first.groupBy("key").pivot("db", NAMESPACES).agg(F.first("b.id"))


def exact_match(features: DataFrame, index: DataFrame) -> DataFrame:
    """Each distinct name is looked up once, then joined back to all features that carry it."""
    keyed = features.withColumn("key", F.lower(F.trim("name")))
    hits = keyed.select("key").distinct().join(index, "key", "left")
    return keyed.join(hits, "key").select("feature_id", "name", *NAMESPACES, F.when(F.coalesce(*NAMESPACES).isNull(), "no_match").otherwise("match").alias("status"))


def substring_search(terms: DataFrame, records: DataFrame, most: int = 6) -> DataFrame:
    """The first `most` records, by position, whose name contains the term; none for an empty term.

    A term's first three characters, or all of a shorter one, are an equi-join key against the runs
    of characters of the names, so no pair without it is looked at. Each distinct name is looked at once, and
    of the positions that carry it the first `most` are all that any term can return. Runs are many times the size that Spark
    takes them for, so they are never broadcast.
    """
    low = F.lower("record")
    runs = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))
    asked = terms.where("term <> ''").distinct().select("term", F.substring(F.lower("term"), 1, 3).alias("gram"), F.least(F.length("term"), F.lit(3)).alias("size"))
    alike = Window.partitionBy("record").orderBy("position")
    first = written(records.distinct().withColumn("place", F.row_number().over(alike)).where(F.col("place") <= most), "records")
    distinct, found = first.where("place = 1").select("record"), None
    for n in (1, 2, 3):
        grams = distinct.select("record", F.explode(F.array_distinct(runs(n))).alias("gram"))
        met = asked.where(F.col("size") == n).join(grams.hint("merge"), "gram").where(low.contains(F.lower("term"))).select("term", "record")
        found = met if found is None else found.unionByName(met)
    at = Window.partitionBy("term").orderBy("position")
    return found.join(first.drop("place").hint("merge"), "record").withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= most).select("term", "rank", "position", "record")


def fetch_records(asked: DataFrame, records: DataFrame) -> DataFrame:
    """asked(db, id) left join records(db, id, names, formula): misses are rows with found = false; hmdb has no source."""
    out = asked.distinct().join(records, ["db", "id"], "left")
    found = F.col("names").isNotNull()
    return out.select("db", "id", found.alias("found"), F.coalesce(F.size("names"), F.lit(0)).alias("n_names"), F.element_at("names", 1).alias("first_name"), F.when(~found & (F.col("db") == "hmdb"), "not available").when(~found, "not found").alias("note"))


def bridge_xref(queries: DataFrame, bridge: DataFrame) -> DataFrame:
    """query_id, db, id -> the canonical HMDB accessions that the bridge knows, each once, in order; ambiguous if several."""
    keyed = bridge.select(F.col("src_db").alias("db"), ids.canonical(F.col("src_db"), F.col("src_id")).alias("id"), ids.pad_hmdb(F.col("hmdb")).alias("target"))
    found = queries.withColumn("id", ids.canonical(F.col("db"), F.col("id"))).join(keyed, ["db", "id"], "left").groupBy("query_id", "db", "id").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return found.select("query_id", "db", "id", F.array_join("targets", ";").alias("targets"), F.element_at(F.concat("targets", F.array(F.lit(None).cast("string"))), 1).alias("first"), (F.size("targets") > 1).alias("ambiguous"))


def upsert_candidates(candidates: DataFrame) -> DataFrame:
    """One row per (ordinal, source, db, id): the last value of each other column that isn't empty."""
    last = lambda c: F.max(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("seq", c)))[c]
    return candidates.where("id is not null").groupBy("ordinal", "source", "db", "id").agg(F.min("seq").alias("first_seq"), last("note").alias("note"), last("formula").alias("formula"), F.count("*").alias("n"))


def route(asked: DataFrame, unbacked: DataFrame) -> DataFrame:
    """What recording each decision would do: action, class, tier, origin and warnings.

    asked: ordinal, feature_id, name, an id per namespace, and the class, confidence and origin asked
    for, any of them null; unbacked: the ordinals with an id that no candidate has. A class outside
    the vocabulary and an id without a candidate are refused. Without ids, an excluded, unmapped or
    exogenous entry is settled as such; otherwise the class follows from the ids where none is given.
    """
    cls = F.coalesce(*[F.when(F.col("final_class") == old, F.lit(new)) for old, new in LEGACY_CLASSES.items()], F.col("final_class"))
    rows = asked.join(unbacked.select("ordinal").distinct().withColumn("unbacked", F.lit(True)), "ordinal", "left").withColumn("cls", cls)
    has_ids = F.coalesce(*NAMESPACES).isNotNull()
    suggested = F.when(F.col("cls") == EXCLUDED, F.coalesce(names.contaminant_origin(F.col("name")), F.lit("contaminant")))
    derived = F.when(F.col("kegg").isNotNull(), PRIMARY[0]).when(F.col("hmdb").isNotNull(), PRIMARY[1]).when(has_ids, "structure-only").otherwise("unmapped")
    kind = F.when(~F.col("cls").isin(CLASSES), "unknown").when(~has_ids & F.col("cls").isin(EXCLUDED, "unmapped"), "terminal").when(~has_ids & (F.col("cls") == "exogenous"), "tagged").when(F.col("unbacked"), "unbacked").otherwise("mapped")
    rows = rows.select("*", kind.alias("kind"), F.coalesce("origin", suggested).alias("given"), F.coalesce("cls", derived).alias("got"), names.has_locant(F.col("name")).alias("locant"))
    implied = F.coalesce(*[F.when(F.col("given") == o, F.lit(c)) for o, c in CLASS_OF_ORIGIN.items()])
    kind, cls, got, given = F.col("kind"), F.col("cls"), F.col("got"), F.col("given")
    kept = (kind == "mapped") & got.isin(*PRIMARY, "structure-only", "exogenous")
    warnings = F.array(
        F.when(~given.isin(ORIGINS), "origin not recognized"),
        F.when(implied != cls, "origin implies another class"),
        F.when(kept & (F.size(names.contaminant_tags(F.col("name"))) > 0), "kept under a non-biological name"),
        F.when(((kind == "tagged") | kept) & (got == "exogenous") & given.isNull(), "exogenous without origin"),
        F.when(kept & F.col("locant") & (F.coalesce("confidence", F.lit("M2")) != "M1"), "locant by a route that isn't exact"),
    )
    refused = kind.isin("unknown", "unbacked")
    default = F.when(kind == "terminal", F.when(cls == EXCLUDED, "X").otherwise("U")).when(kind == "tagged", "M4").otherwise("M2")
    origin = F.when((kind == "mapped") & given.isNull() & got.isin(*PRIMARY, "structure-only"), "endogenous").otherwise(given)
    return rows.select(
        "feature_id", F.when(refused, F.concat(F.lit("refused: "), F.when(kind == "unknown", "unknown class").otherwise("id without a candidate"))).when(kind == "terminal", "exclude").otherwise("accept").alias("action"),
        F.when(~refused, got).alias("routed_class"), F.when(~refused, F.coalesce("confidence", default)).alias("tier"), F.when(~refused, origin).alias("routed_origin"),
        F.when(refused, "").otherwise(F.array_join(F.array_compact(warnings), "; ")).alias("warnings"),
    )


def fabricated(accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accepted ids that no candidate of the feature has."""
    return accepted.join(candidates.where("id is not null").select("ordinal", "db", "id").distinct(), ["ordinal", "db", "id"], "left_anti")


def risky(features: DataFrame) -> DataFrame:
    """Exact matches that need a second look: acronyms, combined names, single capitalised words."""
    out = names.normalized(features, "name", "n").select("feature_id", "name", F.col("n.flags").alias("flags"))
    return out.where(F.arrays_overlap("flags", F.array(F.lit("abbrev_parenthetical"), F.lit("combined_name"))) | F.trim("name").rlike("^[A-Z][a-z]+$")).select("feature_id", "name", F.array_join("flags", ";").alias("flags"))


def risky_matches(matched: DataFrame) -> DataFrame:
    """feature_id, name, match -> those whose matched record's name means another compound or a class: verdict and the axes of conflict. Each pair of names is compared once."""
    pairs = verdict.judged(matched.select("name", "match").distinct(), "name", "match")
    found = pairs.where(F.col("v.verdict").isin("conflict", "class-level")).select("name", "match", F.col("v.verdict").alias("verdict"), F.array_join("v.conflicts", ";").alias("conflicts"))
    return matched.select("feature_id", "name", "match").distinct().join(found, ["name", "match"])


def backchecked(held: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of accepted ids (ordinal, db, id), those that were held against their own record."""
    return held.join(decisions.where("action = 'backcheck'").select("ordinal", "db", "id").distinct(), ["ordinal", "db", "id"], "left_semi")


def harmonized_queries(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """ordinal, db, queries: for kegg, pubchem and chebi, the names that their sources were asked for, in order, and the normal form, each once."""
    asked = candidates.where((F.col("query") != "") & ~F.col("query").rlike(f"^({'|'.join(NAMESPACES)}):"))
    asked = asked.select("ordinal", "seq", "query", F.explode(F.array(*[F.when(F.col("source").contains(d), F.lit(d)) for d in ASKED])).alias("db")).where("db is not null")
    own = names.normalized(entries.select("ordinal", "name"), "name", "n").select("ordinal", F.lit(None).cast("long").alias("seq"), F.col("n.normalized").alias("query"), F.explode(F.array(*map(F.lit, ASKED))).alias("db"))
    first = asked.unionByName(own.where("query <> ''")).groupBy("ordinal", "db", "query").agg(F.min(F.coalesce("seq", F.lit(2**62))).alias("seq"))
    return first.groupBy("ordinal", "db").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "query"))), lambda x: x["query"]), " | ").alias("queries"))


def accept_warnings(held: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """ordinal, warning, db, id, detail for accepted ids (ordinal, name, db, id) that their own kind of check can't see through.

    shared: features of other names hold the id. unchecked: a kegg id that came by search or bridge
    and was never held against its record.
    """
    by_id = held.groupBy("db", "id").agg(F.count_distinct(F.lower(F.trim("name"))).alias("n")).where("n > 1")
    shared = held.join(by_id, ["db", "id"]).select("ordinal", F.lit("shared").alias("warning"), "db", "id", F.concat((F.col("n") - 1).cast("string"), F.lit(" other names")).alias("detail"))
    kegg = held.where("db = 'kegg'").select("ordinal", "db", "id")
    by = candidates.where((F.col("db") == "kegg") & F.col("source").isin(INDIRECT)).groupBy("ordinal", "id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("detail"))
    unchecked = kegg.join(by, ["ordinal", "id"]).join(backchecked(kegg, decisions), ["ordinal", "db", "id"], "left_anti")
    return shared.unionByName(unchecked.select("ordinal", F.lit("unchecked").alias("warning"), "db", "id", "detail"))


def name_warnings(held: DataFrame, candidates: DataFrame) -> DataFrame:
    """ordinal, name, db, id, match, verdict, conflicts: accepted ids that came under a name of another compound or of a class.

    Normal forms are written, one per distinct name: as join keys they would be computed anew in every condition on them.
    """
    normal = written(names.normalized(held.select("name").distinct(), "name", "n").select("name", F.col("n.normalized").alias("normal")), "normal")
    named = held.join(normal, held["name"].eqNullSafe(normal["name"])).select("ordinal", F.col("normal").alias("name"), "db", "id")
    met = written(named.join(candidates.where("id is not null and note <> ''").select("ordinal", "db", "id", F.col("note").alias("match")).distinct(), ["ordinal", "db", "id"]), "met")
    judged = risky_matches(met.select(F.lit(None).cast("string").alias("feature_id"), "name", "match")).drop("feature_id")
    return met.join(judged, ["name", "match"])


def first_hit(asked: DataFrame, index: DataFrame, order: list[str]) -> DataFrame:
    """asked(key, db, id) against index(db, id, base): all bases of the first namespace, in the given order, that has any."""
    place = F.coalesce(*[F.when(F.col("db") == d, F.lit(k)) for k, d in enumerate(order)])
    hits = asked.where(F.col("db").isin(order)).join(shuffled(index.distinct()), ["db", "id"]).groupBy("key", "db").agg(F.array_sort(F.collect_set("base")).alias("bases"))
    best = hits.groupBy("key").agg(F.min(F.struct(place.alias("place"), "db", "bases")).alias("b"))
    return best.select("key", F.col("b.db").alias("via"), F.col("b.bases").alias("bases"))


def crosswalk(accepted: DataFrame, species: DataFrame) -> DataFrame:
    """ordinal, via and the model's base ids, by kegg, else hmdb, else chebi."""
    index = species.select("base", F.explode(F.array(*[F.struct(F.lit(d).alias("db"), F.col(d).alias("id")) for d in ("kegg", "hmdb", "chebi")])).alias("x")).where("x.id is not null").select("x.db", "x.id", "base")
    out = first_hit(accepted.select(F.col("ordinal").alias("key"), "db", "id"), index, ["kegg", "hmdb", "chebi"])
    return out.select(F.col("key").alias("ordinal"), "via", F.array_join("bases", ";").alias("bases"), F.size("bases").alias("n_bases"))


def allocate_single(asked: DataFrame) -> DataFrame:
    """ordinal, target (one per ordinal): a target goes to the first that asks, the others get none."""
    w = Window.partitionBy("target").orderBy("ordinal")
    return asked.withColumn("given", F.row_number().over(w) == 1)


#: Pairs of a run up to which one task goes through them in order.
IN_ORDER = 1_000_000


def _in_order(found: pd.DataFrame) -> pd.DataFrame:
    """One run's entries in ordinal order; each takes its first target that is still there."""
    taken, got = set(), {}
    for k, target in zip(*(found.sort_values(["ordinal", "place"])[c].tolist() for c in ("ordinal", "target"))):
        if k not in got and target not in taken:
            taken.add(target)
            got[k] = target
    return pd.DataFrame({"run": found["run"].iloc[0], "ordinal": list(got), "target": list(got.values())})


def allocate(asked: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """run, ordinal, targets (array, in order) -> run, ordinal, target: in ordinal order, each takes its first target that none before it took.

    Runs are independent. One of up to in_order pairs is gone through in order by one task, however long its chains.
    In a larger one, entries settle in rounds: each proposes to the first target it has left, and a
    target drops all that come after the least ordinal that proposes to it. As every target ranks by
    ordinal, what is left in the end is what the order would have given. Each round is two
    aggregations and a join over the pairs that are left, written down; what it read is deleted.
    """
    pairs = written(asked.select("run", "ordinal", F.posexplode("targets").alias("place", "target")).groupBy("run", "ordinal", "target").agg(F.min("place").alias("place")), "asked")
    sizes = written(pairs.groupBy("run").agg(F.count("*").alias("n")), "runs")
    small = pairs.join(sizes.where(F.col("n") <= in_order), "run", "left_semi")
    got = small.groupBy("run").applyInPandas(_in_order, pairs.select("run", "ordinal", "target").schema)
    if not sizes.where(F.col("n") > in_order).isEmpty():
        got = got.unionByName(_in_rounds(pairs.join(sizes.where(F.col("n") > in_order), "run", "left_semi")))
    return asked.select("run", "ordinal").join(got, ["run", "ordinal"], "left")


def _in_rounds(pairs: DataFrame) -> DataFrame:
    pairs = written(pairs, "asked")
    n = pairs.count()
    while True:
        first = pairs.groupBy("run", "ordinal").agg(F.min(F.struct("place", "target")).alias("f")).select("run", "ordinal", F.col("f.target").alias("target"))
        holder = first.groupBy("run", "target").agg(F.min("ordinal").alias("holder"))
        left = written(pairs.join(holder, ["run", "target"], "left").where("holder is null or ordinal <= holder").drop("holder"), "asked")
        m = left.count()
        if m == n:
            return first
        discard(pairs)
        pairs, n = left, m


def latest(events: DataFrame, by: str = "ordinal") -> DataFrame:
    """Per entity: the last rationale, that of the last call (a decision that sets a class), the first accepting action, the last action, and how many events there were."""
    accepting = F.when(F.col("action").isin(ACCEPTING), F.struct("seq", "action"))
    call = F.when(F.col("action").isin("exclude", *ACCEPTING), F.struct("seq", "rationale"))
    return events.groupBy(by).agg(F.max(F.struct("seq", "rationale"))["rationale"].alias("last_rationale"), F.max(call)["rationale"].alias("last_call"), F.min(accepting)["action"].alias("first_accept"), F.max(F.struct("seq", "action"))["action"].alias("last_action"), F.count("*").alias("n"))


def bounded_history(events: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("ordinal", "action").orderBy(F.col("seq").desc())
    return events.withColumn("age", F.row_number().over(w)).where(F.col("age") <= most).select("ordinal", "action", "seq", "age")


def reason_category(origin: Column, name: Column, reason: Column) -> Column:
    """Recorded origin unless endogenous, else what the name's class implies, else the first category with a word in the reason, else unspecified."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    said = [F.when(low.rlike("|".join(words)), F.lit(category)) for category, words in REASON_WORDS.items()]
    return F.coalesce(F.nullif(origin, F.lit("endogenous")), names.contaminant_origin(name), *said, F.lit("unspecified"))


def indirect_unchecked(entries: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries whose kegg id came by search or bridge and was never held against its own record."""
    e = entries.where("kegg is not null and coalesce(confidence, '') <> 'M1'").select("ordinal", "feature_id", F.col("kegg").alias("id"))
    c = candidates.where(F.col("source").isin(INDIRECT) & (F.col("db") == "kegg")).select("ordinal", "id").distinct()
    d = decisions.where("action = 'backcheck' and db = 'kegg'").select("ordinal", "id").distinct()
    return e.join(c, ["ordinal", "id"], "left_semi").join(d, ["ordinal", "id"], "left_anti")

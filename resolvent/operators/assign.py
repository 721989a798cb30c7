"""The model's answer for entries: calls made by hand, the crosswalk's own, and how the two are kept together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, verdict
from ..plans.written import shuffled, written
from ..vocab import CAVEATS, MAPPED_RELATIONS, RELATIONS
from . import resolve, species

#: Least letters of a reason, and of one for a species that stands in for the compound.
REASON, FULL_REASON = 8, 20
RESULT = ["ordinal", "label", "mam", "relation", "rationale", "names", "curated"]
_NONE = "cast(array() as array<string>)"


def assign(asked: DataFrame, entries: DataFrame, index: DataFrame, searched: DataFrame, stored: DataFrame) -> DataFrame:
    """What committing each call would do: ordinal, action, mam, names, relation, rationale, caveat, warnings.

    asked: ordinal, mam (array of base or species ids), relation, rationale, one call per entry, taken in the order
    of ordinals; entries: ordinal, name; index: species.index() of the model; searched: ordinal, base of the
    species that searches for the entry gave; stored: RESULT of this model before the calls.

    Refused, by the first that holds: an entry or a relation that isn't known, a relation that needs a species
    without one or the other way round, a reason of under 8 letters, a species that the model
    lacks. Warnings: a species that no search of the entry gave (where there was one); `exact` for a
    pool; a name that conflicts, or is a class where `exact` is claimed; a thin reason for a
    stand-in; `exact` for a species that another entry has as `exact` by then.
    """
    asked = asked.withColumn("mam", F.filter(F.transform(F.coalesce("mam", F.expr(_NONE)), lambda x: F.trim(x)), lambda x: x != "")).withColumn("why", F.length(F.trim(F.coalesce("rationale", F.lit("")))))
    normal = names.normalized(entries.select("name").distinct(), "name", "n").select("name", names.query_name(F.col("n.normalized"), F.col("name")).alias("said"))
    known = shuffled(entries).join(written(normal, "normal"), "name").select("ordinal", "said")
    each = asked.select("ordinal", "relation", F.posexplode("mam").alias("place", "id"))
    looked = species.lookup(each.select("id").distinct(), index).select("id", "base")
    one = shuffled(each).join(looked, "id").join(shuffled(index.select("base", F.col("name").alias("gem_name"), "pool")), "base", "left").join(shuffled(known), "ordinal", "left")
    tried = searched.select("ordinal", "base").distinct()
    one = one.join(shuffled(tried.withColumn("met", F.lit(True))), ["ordinal", "base"], "left").join(shuffled(tried.groupBy("ordinal").agg(F.count("*").alias("n_met"))), "ordinal", "left")
    one = written(one, "called")
    judged = verdict.judged(one.where("said is not null and coalesce(gem_name, '') <> ''").select("said", "gem_name").distinct(), "said", "gem_name").select("said", "gem_name", "v.verdict", "v.conflicts")
    rows = shuffled(one).join(written(judged, "judged"), ["said", "gem_name"], "left")
    exact = F.col("relation") == "exact"
    of = F.when((F.col("verdict") == "conflict") & (F.col("relation") != "isomer-surrogate"), F.concat(F.lit("conflict: "), "base", F.lit(" on "), F.array_join("conflicts", ","))).when((F.col("verdict") == "class-level") & exact, F.concat(F.lit("class level: "), "base"))
    mine = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("place", "base")))), lambda x: x["base"])
    summed = rows.groupBy("ordinal").agg(
        F.array_sort(F.collect_list(F.struct("place", "base", F.coalesce("gem_name", F.lit("")).alias("name"), of.alias("said")))).alias("x"), F.min(F.when(F.col("base").isNull(), F.struct("place", "id")))["id"].alias("missing"),
        mine(F.col("n_met").isNotNull() & F.col("met").isNull()).alias("unmet"), mine(F.coalesce("pool", F.lit(False)) & exact).alias("pools"),
    )
    calls = asked.join(shuffled(known.select("ordinal", F.lit(True).alias("there"))), "ordinal", "left").join(shuffled(summed), "ordinal", "left")
    mapped, given = F.col("relation").isin(MAPPED_RELATIONS), F.size("mam") > 0
    refusal = (
        F.when(F.col("there").isNull(), "unknown entry").when(~F.coalesce(F.col("relation").isin(RELATIONS), F.lit(False)), "unknown relation").when(mapped & ~given, "the relation needs a species")
        .when(given & ~mapped, "the relation carries no species").when(F.col("why") < REASON, "the reason is too short").when(F.col("missing").isNotNull(), F.concat(F.lit("not in the model: "), "missing"))
    )
    calls = written(calls.withColumn("refusal", refusal).withColumn("bases", F.transform("x", lambda x: x["base"])), "calls")
    elsewhere = _held_exactly(calls, stored)
    thin = F.when(F.col("relation").isin("isomer-surrogate", "class-proxy") & (F.col("why") < FULL_REASON), F.array(F.lit("thin reason for a stand-in"))).otherwise(F.expr(_NONE))
    about = lambda label, c: F.transform(F.coalesce(c, F.expr(_NONE)), lambda b: F.concat(F.lit(f"{label}: "), b))
    warnings = F.concat(about("not among the searched", F.col("unmet")), about("pool formula", F.col("pools")), F.coalesce(F.array_compact(F.transform("x", lambda x: x["said"])), F.expr(_NONE)), thin, about("exact elsewhere", F.col("elsewhere")))
    ok = F.col("refusal").isNull()
    return calls.join(shuffled(elsewhere), "ordinal", "left").select(
        "ordinal", F.when(ok, "assigned").otherwise(F.concat(F.lit("refused: "), "refusal")).alias("action"), F.when(ok, F.coalesce("bases", F.expr(_NONE))).alias("mam"), F.when(ok, F.coalesce(F.transform("x", lambda x: x["name"]), F.expr(_NONE))).alias("names"),
        "relation", "rationale", F.when(ok, F.coalesce(*[F.when(F.col("relation") == r, F.lit(c)) for r, c in CAVEATS.items()])).alias("caveat"), F.when(ok, warnings).otherwise(F.expr(_NONE)).alias("warnings"),
    )


def _held_exactly(calls: DataFrame, stored: DataFrame) -> DataFrame:
    """ordinal, elsewhere: species of accepted `exact` calls that another entry has as `exact` when the call is made.

    Calls are made in the order of ordinals, and each replaces its entry's stored result. So per
    species four extremes say it: of stored results that no call replaces the least and the greatest ordinal, of those that one
    replaces the greatest (those after a call still stand), and of calls the least.
    """
    new = calls.where("refusal is null").select("ordinal", "relation", "bases")
    old = stored.where("relation = 'exact'").select("ordinal", F.explode("mam").alias("base")).join(shuffled(new.select("ordinal", F.lit(True).alias("called"))), "ordinal", "left")
    made = new.where("relation = 'exact'").select("ordinal", F.explode(F.array_distinct("bases")).alias("base"))
    k, called = F.col("ordinal"), F.col("called").isNotNull()
    held = old.groupBy("base").agg(F.min(F.when(~called, k)).alias("least"), F.max(F.when(~called, k)).alias("most"), F.max(F.when(called, k)).alias("last"))
    held = held.join(made.groupBy("base").agg(F.min(k).alias("first")), "base", "full")
    clash = (F.col("least") != k) | (F.col("most") != k) | (F.col("last") > k) | (F.col("first") < k)
    return shuffled(made).join(held, "base").where(clash).groupBy("ordinal").agg(F.array_sort(F.collect_set("base")).alias("elsewhere"))


def results(assigned: DataFrame, label: str) -> DataFrame:
    """RESULT of the calls that assign() doesn't refuse: curated."""
    return assigned.where("action = 'assigned'").select("ordinal", F.lit(label).alias("label"), "mam", "relation", "rationale", "names", F.lit(True).alias("curated"))


def crosswalked(entries: DataFrame, index: DataFrame, label: str) -> DataFrame:
    """RESULT of entries (ordinal, kegg, hmdb, chebi) by their ids: `exact`, `class-proxy` where a species is a pool, or `id-gap`; not curated."""
    held = entries.select("ordinal", F.explode(F.array(*[F.struct(F.lit(d).alias("db"), F.col(d).alias("id")) for d in ("kegg", "hmdb", "chebi")])).alias("x")).select("ordinal", "x.*").where("id is not null")
    met = resolve.crosswalk(held, index).select("ordinal", "via", F.posexplode(F.split("bases", ";")).alias("place", "base")).join(shuffled(index.select("base", "name", "pool")), "base")
    found = met.groupBy("ordinal", "via").agg(F.array_sort(F.collect_list(F.struct("place", "base", F.coalesce("name", F.lit("")).alias("name")))).alias("x"), F.bool_or("pool").alias("pool"))
    out = entries.select("ordinal").join(shuffled(found), "ordinal", "left")
    hit, none = F.col("via").isNotNull(), F.expr(_NONE)
    return out.select(
        "ordinal", F.lit(label).alias("label"), F.when(hit, F.transform("x", lambda x: x["base"])).otherwise(none).alias("mam"), F.when(~hit, "id-gap").when(F.col("pool"), "class-proxy").otherwise("exact").alias("relation"),
        F.when(hit, F.concat(F.lit("by its id of "), "via")).otherwise(F.lit("no id of it in the model")).alias("rationale"), F.when(hit, F.transform("x", lambda x: x["name"])).otherwise(none).alias("names"), F.lit(False).alias("curated"),
    )


def kept(old: Callable[[str], Column], new: Callable[[str], Column]) -> Column:
    """For Store.merge(): a stored result made by hand stays if the new one isn't."""
    return old("curated") & ~new("curated")

"""Flags as views over the ledger's tables, and the audit's checks as one table of offenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, verdict
from ..plans.written import written
from ..vocab import CLASS_OF_ORIGIN, FLAGS, FUZZY, KEPT, NAMESPACES, ORIGINS, PRIMARY, TIERS, TRIVIAL_RATIONALES
from . import collide, resolve


def held(entries: DataFrame) -> DataFrame:
    """ordinal, name, db, id of every accepted id."""
    return entries.select("ordinal", "name", F.expr("stack(5, %s) as (db, id)" % ", ".join(f"'{d}', {d}" for d in NAMESPACES))).where("id is not null")


def class_level(decisions: DataFrame) -> DataFrame:
    return decisions.where("action = 'backcheck' and (verdict = 'class-level' or db_resolution = 'class')").select("ordinal", "db", "id").distinct()


def class_evidence(entries: DataFrame, candidates: DataFrame, decisions: DataFrame, raised: DataFrame) -> DataFrame:
    """ordinal, db, id of accepted ids that the run itself shows to be class-level.

    Shown by a back-check, by the name of a candidate with that id, or, for all ids of an entry, by
    its class_level_id flag. Each distinct name is looked at once.
    """
    named = candidates.where("id is not null and note <> ''").select("ordinal", "db", "id", "note")
    # written, since Spark would infer the condition for the candidates' side of the join too
    generic = written(verdict.featured(named, "note").where("f.resolution = 'class'").select(F.col("name").alias("note")), "generic")
    flagged = raised.where("flag = 'class_level_id'").select("ordinal").distinct()
    return class_level(decisions).unionByName(named.join(generic, "note").select("ordinal", "db", "id")).unionByName(held(entries).join(flagged, "ordinal", "left_semi").select("ordinal", "db", "id")).distinct()


def conditions(entries: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """ordinal, flag: the condition of each known flag where it holds now. evidence: class_evidence()."""
    ids_held = held(entries)
    redecided = decisions.where("action in ('accept', 'exclude')").select("ordinal").distinct()
    never = entries.select("ordinal").join(redecided, "ordinal", "left_anti")
    backchecks = decisions.where("action = 'backcheck'")
    sev = collide.severity(ids_held, evidence).where("severity = 'collision'").select("db", "id")
    named = lambda df, flag: df.select("ordinal", F.lit(flag).alias("flag")).distinct()
    parts = [
        named(never, "auto_accept_review"),
        named(never, "isomer_token_conflict"),
        named(backchecks.where("verdict = 'conflict'").join(ids_held.select("ordinal", "db", "id"), ["ordinal", "db", "id"], "left_semi"), "id_name_conflict"),
        named(class_level(decisions).join(ids_held.select("ordinal", "db", "id"), ["ordinal", "db", "id"], "left_semi"), "class_level_id"),
        named(ids_held.join(sev, ["db", "id"], "left_semi"), "shared_id_collision"),
        named(entries.where("hmdb is null"), "hmdb_backfill_conflict"),
        named(entries.where("kegg is not null and mam is null and coalesce(relation, 'id-gap') = 'id-gap'"), "id_gap_try_generic_kegg"),
        named(entries.where((F.size(names.contaminant_tags(F.col("name"))) > 0) & F.col("final_class").isin(KEPT)), "possible_xenobiotic"),
    ]
    return reduce(DataFrame.unionByName, parts)


def flag_states(raised: DataFrame, acknowledged: DataFrame, holding: DataFrame) -> DataFrame:
    """ordinal, flag, state: acknowledged, open while the condition holds (or the flag is unknown), else self_resolved."""
    a, h = acknowledged.select("ordinal", "flag").distinct().withColumn("a", F.lit(True)), holding.withColumn("h", F.lit(True))
    rows = raised.select("ordinal", "flag").distinct().join(a, ["ordinal", "flag"], "left").join(h, ["ordinal", "flag"], "left")
    known = F.col("flag").isin(list(FLAGS))
    return rows.select("ordinal", "flag", F.when(F.col("a"), "acknowledged").when(F.col("h") | ~known, "open").otherwise("self_resolved").alias("state"))


def flag_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("flag").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("open", "acknowledged", "self_resolved")])


#: How an id that is shared at class level ends among the offenders.
SOFT = "(class-level)"
#: Level of a check that has offenders; of id_collisions, if one of them isn't SOFT.
LEVELS = {
    "anti_fabrication": "fail", "confidence_present": "warn", "class_confidence_consistency": "fail", "w_tier_not_primary": "fail", "verify_before_fuzzy": "warn",
    "isomer_locant_safety": "warn", "id_backcheck": "fail", "id_name_conflicts": "fail", "id_collisions": "fail", "hmdb_backfill_conflicts": "warn",
    "contaminant_consistency": "warn", "origin_coherence": "fail", "flagged_auto_accepts_reviewed": "warn", "id_gap_generic_kegg": "warn", "gem_resolution_recorded": "warn",
    "gem_surrogate_documented": "warn", "rationale_quality": "warn", "no_pending": "warn", "gem_crosswalk_ran": "warn", "finalize_artifacts": "warn",
}


def offenders(spark: SparkSession, entries: DataFrame, candidates: DataFrame, decisions: DataFrame, states: DataFrame, evidence: DataFrame, artifacts: DataFrame, required: list[str]) -> DataFrame:
    """check, offender: everything that the twenty checks object to. Ids shared at class level are objected to as such."""
    fid = entries.select("ordinal", "feature_id")
    e = entries
    open_ = states.where("state = 'open'").join(fid, "ordinal")
    one = lambda check, df, *c: df.select(F.lit(check).alias("check"), F.concat(*c).alias("offender"))
    me = F.col("feature_id")
    lit = F.lit
    primary, kept = F.col("final_class").isin(PRIMARY), F.col("final_class").isin(KEPT)
    looked_at = candidates.where("source <> 'metaboanalyst' and formula is not null").select("ordinal").unionByName(decisions.where("action in ('backcheck', 'isomer_guard')").select("ordinal")).distinct()
    tags = e.select(kept.alias("k"), F.explode(names.contaminant_tags(F.col("name"))).alias("tag")).withColumn("k", F.coalesce("k", lit(False)))
    implied = F.coalesce(*[F.when(F.col("origin") == o, lit(c)) for o, c in CLASS_OF_ORIGIN.items()])
    severity = collide.severity(held(e), evidence)
    trivial = decisions.where("action in ('accept', 'auto_accept', 'exclude')").withColumn("r", F.lower(F.trim(F.coalesce("rationale", lit("")))))
    mams = e.where("mam is not null and relation = 'exact'").groupBy("mam").agg(F.count("*").alias("n")).where("n > 1")
    untouched = e.agg(F.count_if(F.coalesce(primary, lit(False))).alias("p"), F.count("mam").alias("m"), F.count("relation").alias("r")).where("p > 0 and m = 0 and r = 0")
    needed = spark.createDataFrame([(x,) for x in required], "path string")
    case = lambda check, condition, *c: F.when(F.coalesce(condition, lit(False)), F.struct(lit(check).alias("check"), F.concat(*c).alias("offender")))
    rel, conf, cls, origin = F.col("relation"), F.col("confidence"), F.col("final_class"), F.col("origin")
    locant = names.has_locant(F.col("name"))
    own = [  # what an entry's own row tells, in one pass
        case("confidence_present", cls.isNotNull() & ~F.coalesce(conf.isin(TIERS), lit(False)), me),
        case("class_confidence_consistency", primary & conf.isin("W", "X", "U"), me, lit(":"), cls, lit("/"), conf),
        case("w_tier_not_primary", primary & (conf == "W"), me),
        case("isomer_locant_safety", kept & (conf != "M1") & locant, me),
        case("contaminant_consistency", kept & (F.size(names.contaminant_tags(F.col("name"))) > 0), me, lit(":kept-analysable")),
        case("origin_coherence", (cls == "exogenous") & origin.isNull(), me, lit(":exogenous-untagged")),
        case("origin_coherence", ~origin.isin(ORIGINS), me, lit(":invalid-origin["), origin, lit("]")),
        case("origin_coherence", implied != cls, me, lit(":"), origin, lit("->"), implied, lit("!="), cls),
        case("gem_resolution_recorded", (primary | (cls == "exogenous")) & (F.coalesce(rel, lit("id-gap")) == "id-gap"), me, F.when(rel.isNull(), ":no-relation").otherwise(":id-gap-unresolved")),
        case("gem_surrogate_documented", rel.isin("isomer-surrogate", "class-proxy") & (F.length(F.trim("rationale")) < 20), me, lit(":"), rel, lit("-undocumented")),
        case("no_pending", F.coalesce(cls, lit("")) == "", me),
    ]
    of_flag = {"id_name_conflict": "id_name_conflicts", "isomer_token_conflict": "id_name_conflicts", "hmdb_backfill_conflict": "hmdb_backfill_conflicts", "auto_accept_review": "flagged_auto_accepts_reviewed", "id_gap_try_generic_kegg": "id_gap_generic_kegg"}
    check_of = F.coalesce(*[F.when(F.col("flag") == f, lit(c)) for f, c in of_flag.items()])
    parts = [
        e.select(F.explode(F.array_compact(F.array(*own))).alias("x")).select("x.check", "x.offender"),
        open_.where(F.col("flag").isin(list(of_flag))).select(check_of.alias("check"), F.concat(me, F.when(check_of == "id_name_conflicts", F.concat(lit(":"), F.col("flag"))).otherwise("")).alias("offender")),
        one("anti_fabrication", resolve.fabricated(held(e).select("ordinal", "db", "id"), candidates).join(fid, "ordinal"), me, lit(":"), "db", lit("="), "id"),
        one("verify_before_fuzzy", e.where(cls.isNotNull() & conf.isin(FUZZY)).join(looked_at, "ordinal", "left_anti"), me),
        one("id_backcheck", resolve.indirect_unchecked(e, candidates, decisions), me, lit(":kegg="), "id"),
        one("id_collisions", severity.where("severity <> 'duplicate-name'"), "db", lit(":"), "id", F.when(F.col("severity") == "collision", "").otherwise(SOFT)),
        one("contaminant_consistency", tags.groupBy("tag").agg(F.bool_or("k").alias("a"), F.bool_or(~F.col("k")).alias("b")).where("a and b"), lit("class["), "tag", lit("]:excluded+kept")),
        one("gem_surrogate_documented", mams, "mam", lit(":exact-shared")),
        one("rationale_quality", trivial.where(F.col("r").isin(TRIVIAL_RATIONALES) | (F.length("r") < 4)).select("ordinal").distinct().join(fid, "ordinal"), me),
        one("gem_crosswalk_ran", untouched, lit("no entry was looked up in the model")),
        one("finalize_artifacts", needed.join(artifacts, "path", "left_anti"), "path"),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit(spark: SparkSession, entries: DataFrame, found: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """One row per check: level, offenders, their fingerprint, whether an acknowledgement (check, fingerprint) fits, and whether one fits no longer.

    The fingerprint adds up hashes of the offenders, so that it can be formed over any number of
    them in any order. Without entries there is nothing to check: one row says so.
    """
    if entries.isEmpty():
        return spark.createDataFrame([("ingest", "warn", 0, "", False, False)], "check string, level string, n long, fingerprint string, acknowledged boolean, stale boolean")
    levels = spark.createDataFrame(list(LEVELS.items()), "check string, on_hit string")
    part = F.conv(F.substring(F.md5("offender"), 1, 15), 16, 10).cast("decimal(38,0)")
    sums = found.groupBy("check").agg(F.count("*").alias("n"), F.count_if(F.col("offender").endswith(SOFT)).alias("soft"), F.sum(part).cast("string").alias("s"))
    sums = sums.select("check", "n", "soft", F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s"), 256), 1, 16).alias("fingerprint"))
    rows = levels.join(sums, "check", "left").join(acknowledged.withColumnRenamed("fingerprint", "of"), "check", "left")
    n = F.coalesce("n", F.lit(0))
    level = F.when(n == 0, "pass").when((F.col("check") == "id_collisions") & (F.col("soft") == n), "warn").otherwise(F.col("on_hit"))
    fits = F.coalesce(F.col("of") == F.col("fingerprint"), F.lit(False))
    warned = level == "warn"
    return rows.select("check", level.alias("level"), n.cast("long").alias("n"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), (warned & fits).alias("acknowledged"), (warned & F.col("of").isNotNull() & ~fits).alias("stale"))


def acknowledge(checks: DataFrame, asked: DataFrame, least: int = 12) -> DataFrame:
    """check, outcome, fingerprint of each request (check, why): only a warn can be acknowledged, with a reason of `least` characters, for the offenders of now."""
    rows = asked.join(checks.select("check", "level", "fingerprint"), "check", "left")
    outcome = (
        F.when(F.col("level").isNull(), "unknown check").when(F.col("level") == "fail", "a failure can only be mended").when(F.col("level") == "pass", "it passes")
        .when(F.length(F.trim(F.coalesce("why", F.lit("")))) < least, "the reason is too short").otherwise("acknowledged")
    )
    return rows.select("check", outcome.alias("outcome"), F.when(outcome == "acknowledged", F.col("fingerprint")).alias("fingerprint"))


def acknowledge_flags(raised: DataFrame, asked: DataFrame, least: int = 8) -> DataFrame:
    """ordinal, flag, outcome of each request (ordinal, flag, why): the flag must have been raised, and the reason have `least` characters."""
    there = raised.select("ordinal", "flag").distinct().withColumn("there", F.lit(True))
    outcome = F.when(F.col("there").isNull(), "never raised").when(F.length(F.trim(F.coalesce("why", F.lit("")))) < least, "the reason is too short").otherwise("acknowledged")
    return asked.join(there, ["ordinal", "flag"], "left").select("ordinal", "flag", outcome.alias("outcome"))


def rollup(checks: DataFrame) -> DataFrame:
    """Counts per level and the verdict: the worst level that isn't acknowledged."""
    worst = F.max(F.when(F.col("acknowledged"), 0).when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return checks.agg(*[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("pass", "warn", "fail")], F.count_if("acknowledged").alias("n_acknowledged"), F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass").alias("verdict"))

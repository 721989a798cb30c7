"""The registered queries: each binds an operator to the domain tables; its SQL for DuckDB stands beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formula, ids, names, sql, variants, verdict
from .gold import SPELLINGS
from .operators import assign, audit, collide, report, resolve, species
from .oracles import PRELUDE, canon, verdicts
from .plans.written import shared_folder, shuffled, written
from .sources import domain as D
from .sources import ledger, readers
from .sources.store import Store
from .streaming import decisions as log
from .streaming import flags
from .vocab import ADDUCTS, ARTIFACTS, CAUSES, CAVEATS, CLASS_OF_ORIGIN, CLASSES, DEFAULT_ADDUCTS, FLAGS, INDIRECT, MAPPED_RELATIONS, NAMESPACES, ORIGINS, PRIMARY, REASON_WORDS, ROUTES, TIERS, TRIVIAL_RATIONALES, XENOBIOTICS

#: The label of the model whose species are the rows of `customer`.
MODEL = "customer"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; sql may begin with further tables (a comma first)."""

    def put(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = PRELUDE + sql.strip()
        return f

    return put


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _tags(x: str) -> str:
    """Sorted contaminant tags as a list, in SQL."""
    cases = ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN '{t}' END" for p, t, _ in XENOBIOTICS)
    return f"list_sort(list_distinct(list_filter([{cases}], lambda t: t IS NOT NULL)))"


def _origin(x: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower({x}), '{p}') THEN '{o}' END" for p, _, o in XENOBIOTICS) + ")"


_NORMAL = rf"""n_s AS (SELECT feature_id, name, regexp_replace(trim(replace(replace(replace(replace(replace(replace(replace(replace(name, 'α', 'alpha'), 'β', 'beta'), 'γ', 'gamma'), 'δ', 'delta'), 'ε', 'epsilon'), 'ω', 'omega'), 'μ', 'u'), 'λ', 'lambda')), '\s+', ' ', 'g') AS s FROM features),
n_b AS (SELECT *, regexp_extract(s, '^([A-Za-z0-9]{{2,7}})\s*\((.{{3,}})\)$', 1) AS acronym, trim(regexp_extract(s, '^([A-Za-z0-9]{{2,7}})\s*\((.{{3,}})\)$', 2)) AS expansion, trim(regexp_extract(s, '\(([^)]+)\)', 1)) AS inside FROM n_s),
n_c AS (SELECT *, acronym <> '' AND upper(acronym) = acronym AND regexp_matches(acronym, '[A-Z]') AS is_a FROM n_b),
n_d AS (SELECT *, CASE WHEN is_a THEN expansion ELSE s END AS base FROM n_c),
normal AS (SELECT *, CASE WHEN ends_with(lower(base), ' monohydrate') THEN trim(left(base, length(base) - 12)) WHEN regexp_matches(lower(base), ' (hydrochloride|dihydrochloride|hydrobromide|sodium salt|potassium salt|hemisulfate|sulfate salt|acetate salt|dihydrate|trihydrate|hydrate)$') THEN regexp_replace(base, '(?i) (hydrochloride|dihydrochloride|hydrobromide|sodium salt|potassium salt|hemisulfate|sulfate salt|acetate salt|dihydrate|trihydrate|hydrate)$', '') ELSE base END AS display FROM n_d)"""
_PARTS = r"""p AS (SELECT *, CASE WHEN contains(base, '=') THEN list_filter(list_transform(string_split(base, '='), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS pe, CASE WHEN contains(base, '/') THEN list_filter(list_transform(string_split(base, '/'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS ps FROM normal)"""
_KEPT = _in([*PRIMARY, "structure-only", "exogenous"])
_HELD = f"held AS (SELECT ordinal, name, db, id FROM (UNPIVOT (SELECT ordinal, name, {', '.join(NAMESPACES)} FROM entries) ON {', '.join(NAMESPACES)} INTO NAME db VALUE id))"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.held(D.entries(spark, sf_dir))


# ------------------------------------------------------------------ coverage and reports

_COVERAGE = f""", rows AS (
SELECT 'class:' || v AS metric, count(o)::BIGINT AS value FROM (SELECT unnest([{", ".join(f"'{c}'" for c in [*CLASSES, "pending"])}]) AS v)
  LEFT JOIN (SELECT ordinal AS o, coalesce(final_class, 'pending') AS c FROM entries) ON c = v GROUP BY v
UNION ALL SELECT 'gem_relation:' || relation, count(*) FROM entries WHERE relation IS NOT NULL GROUP BY relation
UNION ALL SELECT unnest(['primary_usable', 'has_kegg', 'has_hmdb', 'gem_mapped', 'gem_species_level', 'exogenous', 'xenobiotic_excluded']), unnest([p, k, h, g, s, e, x]) FROM (SELECT
  count(*) FILTER (final_class IN {_in(PRIMARY)}) AS p, count(kegg) AS k, count(hmdb) AS h, count(*) FILTER (relation IN ('exact', 'class-proxy', 'isomer-surrogate')) AS g,
  count(*) FILTER (relation = 'exact') AS s, count(*) FILTER (final_class = 'exogenous') AS e, count(*) FILTER (final_class = 'xenobiotic-excluded') AS x FROM entries))
SELECT metric, value, n AS denom, coalesce(round(100.0 * value::DOUBLE / nullif(n, 0), 1), 0.0) AS pct FROM rows, (SELECT count(*) AS n FROM entries)"""


@query(_COVERAGE)
def coverage(spark, sf_dir):
    """K3, A1-A4: the coverage table."""
    return report.coverage(spark, D.entries(spark, sf_dir))


@query("""SELECT relation, count(*) AS n FROM entries WHERE relation IS NOT NULL GROUP BY relation""")
def a3_relation_counts(spark, sf_dir):
    return D.entries(spark, sf_dir).where("relation is not null").groupBy("relation").agg(F.count("*").alias("n"))


_MEMBERS = f""", ids AS (SELECT ordinal, db, id FROM held UNION ALL SELECT ordinal, db, id FROM candidates WHERE id IS NOT NULL),
m AS (SELECT e.feature_id, {", ".join(f"min(i.id) FILTER (i.db = '{d}') AS {d}" for d in NAMESPACES)} FROM entries e LEFT JOIN ids i USING (ordinal)
      WHERE coalesce(e.final_class, 'pending') <> 'xenobiotic-excluded' GROUP BY e.feature_id)"""


@query(f""", {_HELD} {_MEMBERS} SELECT *, {", ".join(f"{d} IS NOT NULL AS has_{d}" for d in NAMESPACES)} FROM m""")
def k5_enriched_xref(spark, sf_dir):
    """Least id per namespace over accepted and candidate ids."""
    return report.membership(D.entries(spark, sf_dir), D.candidates(spark, sf_dir))


@query(f""", {_HELD} {_MEMBERS} SELECT {", ".join(f"{d} IS NOT NULL AS has_{d}" for d in NAMESPACES)}, count(*) AS n, min(feature_id) AS first FROM m GROUP BY ALL""")
def a6_upset(spark, sf_dir):
    """Features per exact combination of namespaces."""
    return report.intersections(report.membership(D.entries(spark, sf_dir), D.candidates(spark, sf_dir)))


@query(f""", {_HELD} {_MEMBERS}, bits AS (SELECT {" + ".join(f"CASE WHEN {d} IS NOT NULL THEN {1 << k} ELSE 0 END" for k, d in enumerate(NAMESPACES))} AS b FROM m), masks AS (SELECT unnest(range(0, 32)) AS k)
SELECT concat_ws(';', {", ".join(f"CASE WHEN k & {1 << k} > 0 THEN '{d}' END" for k, d in enumerate(NAMESPACES))}) AS namespaces, bit_count(k)::INT AS size, count(*) AS n, CASE WHEN k = 0 THEN 'total' WHEN k = 31 THEN 'all_five' WHEN bit_count(k) = 1 THEN 'with_id' ELSE 'intersection' END AS kind FROM bits JOIN masks ON b & k = k GROUP BY k""")
def a6_totals(spark, sf_dir):
    """Features that have all of some namespaces, for every set of them: the total, those with each, inclusive intersections, all five."""
    return report.totals(report.membership(D.entries(spark, sf_dir), D.candidates(spark, sf_dir)))


_IMPROVED = f""", {_HELD}, u AS (SELECT ordinal, db FROM held UNION SELECT ordinal, db FROM candidates WHERE id IS NOT NULL),
bb AS (SELECT ordinal, {", ".join(f"bool_or(db = '{d}') AS b_{d}" for d in NAMESPACES)} FROM candidates WHERE id IS NOT NULL AND source = 'metaboanalyst' GROUP BY ordinal),
aa AS (SELECT ordinal, {", ".join(f"bool_or(db = '{d}') AS a_{d}" for d in NAMESPACES)} FROM u GROUP BY ordinal),
x AS (SELECT final_class, mam, b_kegg OR b_hmdb AS any_first, {", ".join(f"b_{d}, a_{d} AND coalesce(final_class, 'pending') <> 'xenobiotic-excluded' AS a_{d}" for d in NAMESPACES)} FROM entries LEFT JOIN bb USING (ordinal) LEFT JOIN aa USING (ordinal))
SELECT 'primary' AS metric, count(*) FILTER (any_first) AS baseline, count(*) FILTER (final_class IN {_in(PRIMARY)}) AS after FROM x
UNION ALL SELECT 'model', count(*) FILTER (mam IS NOT NULL AND any_first), count(mam) FROM x
""" + "".join(f" UNION ALL SELECT '{d}', count(*) FILTER (b_{d}), count(*) FILTER (a_{d}) FROM x" for d in NAMESPACES) + "".join(f" UNION ALL SELECT 'class:{c}', 0, count(*) FILTER (final_class = '{c}') FROM x" for c in ("structure-only", "exogenous", "xenobiotic-excluded"))


@query(_IMPROVED)
def a7_improvement(spark, sf_dir):
    """Before and after, per namespace, in the model, and by class."""
    return report.improvement(D.entries(spark, sf_dir), D.candidates(spark, sf_dir))


_HISTORY = """history AS (SELECT ordinal, arg_max(rationale, seq) AS last_rationale, arg_max(rationale, seq) FILTER (action IN ('exclude', 'accept', 'auto_accept')) AS last_call, arg_min(action, seq) FILTER (action IN ('accept', 'auto_accept')) AS first_accept,
 arg_max(action, seq) AS last_action, count(*) AS n FROM decisions GROUP BY ordinal)"""


_LOGICS = """lg AS (SELECT ordinal, arg_min(rationale, seq) AS first_logic, arg_min(rationale, seq) FILTER (NOT contains(rationale, 're-bridge') AND NOT contains(rationale, 'backfill')) AS kegg_logic,
 arg_min(rationale, seq) FILTER (contains(lower(rationale), 'hmdb') OR contains(rationale, 're-bridge') OR contains(lower(rationale), 'backfill')) AS hmdb_logic FROM decisions WHERE action IN ('accept', 'auto_accept') GROUP BY ordinal)"""
_ROUTE = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUTES.items()) + " ELSE coalesce(source, '?') END"


def _recovered(db: str) -> str:
    logic = "kegg_logic" if db == "kegg" else "coalesce(hmdb_logic, first_logic)"
    return f""", {_NORMAL}, {_LOGICS}, c AS (SELECT ordinal, id, arg_min(source, seq) AS source, arg_min(query, seq) AS query, arg_min(note, seq) AS note FROM candidates WHERE db = '{db}' AND source <> 'metaboanalyst' GROUP BY ordinal, id),
rec AS (SELECT e.ordinal, e.feature_id, e.name AS original_name, coalesce(CASE WHEN query <> '' AND NOT regexp_matches(query, '^({"|".join(NAMESPACES)}):') THEN query END, display, '') AS harmonized_name, {db} AS id, coalesce(note, '') AS note, {_ROUTE} AS route, coalesce({logic}, '') AS logic
FROM entries e LEFT JOIN normal n USING (feature_id) LEFT JOIN c ON c.ordinal = e.ordinal AND c.id = e.{db} LEFT JOIN lg ON lg.ordinal = e.ordinal
WHERE {db} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candidates m WHERE m.ordinal = e.ordinal AND m.db = '{db}' AND m.source = 'metaboanalyst' AND m.id IS NOT NULL))"""


def recovered(spark: SparkSession, sf_dir: str, db: str) -> DataFrame:
    return report.recovered(D.entries(spark, sf_dir), D.candidates(spark, sf_dir), D.decisions(spark, sf_dir), db)


@query(_recovered("kegg") + " SELECT * FROM rec")
def j9_kegg_recovered(spark, sf_dir):
    """KEGG ids where the first pass had none, with name, record, route and logic."""
    return recovered(spark, sf_dir, "kegg")


@query(_recovered("hmdb") + " SELECT * FROM rec")
def k4_hmdb_recovered(spark, sf_dir):
    return recovered(spark, sf_dir, "hmdb")


_CAUSE = _recovered("kegg") + r""", caused AS (SELECT *, CASE WHEN contains(lower(logic), 'typo') THEN 0 WHEN contains(lower(route), 'xref bridge') OR contains(lower(logic), 'bridgedb promotes') THEN 5
 WHEN contains(lower(logic), 'combined name') OR contains(lower(logic), 'isomer pair') OR contains(original_name, '/') THEN 4
 WHEN regexp_matches(original_name, '=\s*[A-Z0-9]{2,5}\b') OR regexp_matches(trim(original_name), '^[A-Z0-9]{2,5}$') OR regexp_matches(original_name, '\([A-Z0-9]{2,6}\)') THEN 1
 WHEN contains(lower(original_name), 'carnitine') AND contains(original_name, ' ') OR regexp_matches(original_name, '-\d-?[Pp]hosphate') OR starts_with(original_name, 'Orto') THEN 2 ELSE 3 END AS place FROM rec)"""
_CAUSE_NAME = "CASE place " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CAUSES)) + " END"


@query(_CAUSE + f" SELECT feature_id, original_name, harmonized_name, {_CAUSE_NAME} AS cause FROM caused")
def f27_causes(spark, sf_dir):
    """why the first pass missed each recovered name."""
    r = recovered(spark, sf_dir, "kegg")
    return r.select("feature_id", "original_name", "harmonized_name", report.cause(F.col("original_name"), F.col("logic"), F.col("route")).alias("cause"))


@query(_CAUSE + f" SELECT place, {_CAUSE_NAME} AS cause, count(*) AS n, min(feature_id) AS first, max(feature_id) AS last FROM caused GROUP BY place")
def a16_cause_groups(spark, sf_dir):
    """Recovered names by cause, in report order; their examples are the rows of f27_causes."""
    return report.causes(recovered(spark, sf_dir, "kegg"))


_REASON = "CASE " + " ".join(f"WHEN regexp_matches(lower(reason), '{'|'.join(words)}') THEN '{c}'" for c, words in REASON_WORDS.items()) + " ELSE 'unspecified' END"


def _ids_sql(columns) -> str:
    return "concat_ws(';', " + ", ".join(f"'{d}:' || {d}" for d in columns) + ")"


@query(f""", {_HISTORY}, r AS (SELECT *, coalesce(last_call, last_rationale, '') AS reason FROM entries LEFT JOIN history USING (ordinal) WHERE final_class IN ('exogenous', 'xenobiotic-excluded'))
SELECT feature_id, name AS original_name, final_class, coalesce(nullif(origin, 'endogenous'), {_origin("name")}, {_REASON}) AS category, {_ids_sql(["kegg", "hmdb", "chebi", "pubchem"])} AS ids,
CASE WHEN final_class = 'exogenous' THEN CASE WHEN mam IS NOT NULL THEN 'in-model' WHEN relation NOT IN ('exact', 'class-proxy', 'isomer-surrogate') THEN relation ELSE '' END END AS gem_xref, reason FROM r""")
def k4_p9_set_apart(spark, sf_dir):
    """Exogenous entries that are kept and excluded ones, with category and reason of the last call."""
    return report.set_apart(D.entries(spark, sf_dir), resolve.latest(D.decisions(spark, sf_dir)))


@query("SELECT x AS words, CASE WHEN " + " WHEN ".join(f"regexp_matches(lower(x), '{'|'.join(words)}') THEN '{c}'" for c, words in REASON_WORDS.items()) + " ELSE 'unspecified' END AS category, count(*) AS n FROM (SELECT rationale AS x FROM decisions) GROUP BY ALL")
def p9_reason_categories(spark, sf_dir):
    """The category that each reason's words alone give."""
    none = F.lit(None).cast("string")
    d = D.decisions(spark, sf_dir).groupBy(F.col("rationale").alias("words")).agg(F.count("*").alias("n"))
    return d.select("words", resolve.reason_category(none, none, F.col("words")).alias("category"), "n")


@query(f""", {_LOGICS}, tr AS (SELECT ordinal, array_to_string(list_sort(list_distinct(list(query))), ' | ') AS tried FROM candidates WHERE query <> '' GROUP BY ordinal)
SELECT feature_id, name AS original_name, coalesce(tried, '') AS harmonized_names_tried, final_class, {_ids_sql(["chebi", "pubchem", "inchikey"])} AS structure_ids, coalesce(nullif(first_logic, ''), 'no KEGG/HMDB returned by any source') AS reason
FROM entries LEFT JOIN tr USING (ordinal) LEFT JOIN lg USING (ordinal) WHERE final_class IN ('structure-only', 'unmapped')""")
def k4_unmapped_harmonization(spark, sf_dir):
    return report.unmapped(D.entries(spark, sf_dir), D.candidates(spark, sf_dir), D.decisions(spark, sf_dir))


_SOURCE_OF = {"gem_mam": "mam", "gem_relation": "relation"}


@query(f""", last AS (SELECT key, unnest(e) FROM (SELECT lower(trim(name)) AS key, max({{'o': ordinal, {", ".join(f"'ID_{d}': {_SOURCE_OF.get(d, d)}" for d in report.ANNOTATION)}}}) AS e FROM entries GROUP BY key))
SELECT p_partkey, p_name, {", ".join(f"coalesce(ID_{d}, '') AS ID_{d}" for d in report.ANNOTATION)}, key IS NOT NULL AS ID_matched FROM part LEFT JOIN last ON lower(trim(p_name)) = key""")
def j8_annotate_source(spark, sf_dir):
    """Source rows with the ids of the last feature of their name."""
    return report.annotate(D.read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", D.entries(spark, sf_dir))


@query("""SELECT c AS "column", overlap, row_number() OVER (ORDER BY overlap DESC, k) = 1 AS chosen FROM (
SELECT k, c, count(e) AS overlap FROM (SELECT unnest([0, 1]) AS k, unnest(['p_brand', 'p_name']) AS c, unnest([p_brand, p_name]) AS v FROM part) LEFT JOIN (SELECT DISTINCT lower(trim(name)) AS e FROM entries) ON lower(trim(v)) = e GROUP BY k, c)""")
def s2_pick_column(spark, sf_dir):
    """The column whose values overlap the known names most."""
    return report.best_column(D.read(spark, sf_dir, "part"), ["p_brand", "p_name"], D.entries(spark, sf_dir))


@query(""", b AS (SELECT ordinal, db, arg_min(id, {'s': seq, 'i': id}) FILTER (source = 'metaboanalyst') AS ex, arg_min(id, {'s': seq, 'i': id}) FILTER (source <> 'metaboanalyst') AS ot FROM candidates WHERE id IS NOT NULL GROUP BY ordinal, db)
SELECT feature_id, CASE WHEN coalesce(final_class, '') = 'xenobiotic-excluded' THEN '' ELSE coalesce(kegg, k.ot, k.ex, '') END AS kegg, CASE WHEN coalesce(final_class, '') = 'xenobiotic-excluded' THEN '' ELSE coalesce(hmdb, h.ot, h.ex, '') END AS hmdb
FROM entries e LEFT JOIN b k ON k.ordinal = e.ordinal AND k.db = 'kegg' LEFT JOIN b h ON h.ordinal = e.ordinal AND h.db = 'hmdb'""")
def j19_reassembly(spark, sf_dir):
    return report.reassemble(D.entries(spark, sf_dir), D.candidates(spark, sf_dir))


@query(f""", c AS (SELECT ordinal, count(*) AS n, arg_min(source, seq) AS source, count(id) AS ids FROM candidates GROUP BY ordinal), d AS (SELECT ordinal, count(*) AS n, arg_max(action, seq) AS action FROM decisions GROUP BY ordinal)
SELECT lpad((e.ordinal // 100)::VARCHAR, 6, '0') AS run, feature_id, name AS original_name, final_class, confidence, {_ids_sql(NAMESPACES)} AS ids, mam, coalesce(c.n, 0) AS n_candidates, coalesce(c.ids, 0) AS n_ids, c.source AS first_source, coalesce(d.n, 0) AS n_decisions, d.action AS last_action,
concat_ws(';', CASE WHEN e.ordinal % 3 = 0 THEN 'class_level_id' END, CASE WHEN e.ordinal % 5 = 0 THEN 'old_flag' END) AS flags, e.ordinal AS left_over, CASE WHEN (e.ordinal // 100) % 2 = 1 THEN (SELECT count(*) FROM entries x WHERE x.ordinal // 100 = e.ordinal // 100 AND x.mam IS NOT NULL) END AS repaired
FROM entries e LEFT JOIN c USING (ordinal) LEFT JOIN d USING (ordinal)""")
def s4_ledgers(spark, sf_dir):
    """Ledgers of both versions read whole and upgraded: every entry with what its candidates, decisions and flags come to."""
    t = {k: written(df, k) for k, df in ledger.tables(written(D.ledgers(spark, sf_dir), "ledgers"), "now").items()}
    key = ["run", "feature_id"]
    id_of = F.coalesce(*NAMESPACES)
    c = t["candidates"].groupBy(key).agg(F.count("*").alias("n_candidates"), F.count(id_of).alias("n_ids"), F.min(F.when(F.col("source").isNotNull(), F.struct("position", "source")))["source"].alias("first_source"))
    d = t["decisions"].groupBy(key).agg(F.count("*").alias("n_decisions"), F.max(F.when(F.col("action").isNotNull(), F.struct("position", "action")))["action"].alias("last_action"))
    f = t["flags"].groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("flag")), ";").alias("flags"))
    m = t["meta"].select("run", F.size(F.try_variant_get(F.col("rest")["migrations"], "$[0].model_ids_repaired", "array<variant>")).cast("long").alias("repaired"))
    e = t["entries"].join(c, key, "left").join(d, key, "left").join(f, key, "left").join(m, "run")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    ids_of = F.concat_ws(";", *[F.concat(F.lit(f"{x}:"), F.col("accepted")[x]) for x in NAMESPACES])
    # a run's name has six digits or more, the result its first six
    return e.select(F.lpad("run", 6, "0").alias("run"), "feature_id", "original_name", "final_class", "confidence", ids_of.alias("ids"), F.get("gem_mam", F.lit(0)).alias("mam"), zero("n_candidates"), zero("n_ids"), "first_source", zero("n_decisions"), "last_action", F.coalesce("flags", F.lit("")).alias("flags"), F.try_variant_get(F.col("rest")["ordinal"], "$", "long").alias("left_over"), "repaired")


@query("""SELECT count(*) AS n, count(*) FILTER (final_class IS NULL) AS pending, CASE WHEN count(*) = 0 THEN 'ingest_names' WHEN (SELECT count(*) FROM candidates) = 0 THEN 'exact_match'
WHEN count(*) FILTER (final_class IS NULL) > 0 THEN 'gather_evidence' ELSE 'model_or_finalize' END AS step FROM entries""")
def p14_next_step(spark, sf_dir):
    return report.next_step(D.entries(spark, sf_dir), D.candidates(spark, sf_dir))


_SAID = f"""SELECT 'exogenous' AS list, category AS value, ordinal FROM sa WHERE final_class = 'exogenous' UNION ALL SELECT 'excluded', category, ordinal FROM sa WHERE final_class <> 'exogenous'
UNION ALL SELECT 'model', coalesce(relation, CASE WHEN mam IS NOT NULL THEN 'unspecified' ELSE 'not-evaluated' END), ordinal FROM entries WHERE relation IS NOT NULL OR mam IS NOT NULL OR final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous')"""


@query(f""", {_HISTORY}, sr AS (SELECT *, coalesce(last_call, last_rationale, '') AS reason FROM entries LEFT JOIN history USING (ordinal) WHERE final_class IN ('exogenous', 'xenobiotic-excluded')), sa AS (SELECT ordinal, final_class, coalesce(nullif(origin, 'endogenous'), {_origin("name")}, {_REASON}) AS category FROM sr),
sy AS (SELECT list, value, count(*) AS n, min(ordinal) AS first FROM ({_SAID}) GROUP BY list, value) SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, first)::INT AS rank FROM sy""")
def a10_most_common(spark, sf_dir):
    """A10: of the kept and the excluded the categories, of the model's answers the relations, commonest first, of equals the one seen first."""
    e = written(D.entries(spark, sf_dir), "entries")
    at = e.select("feature_id", "ordinal")
    apart = report.set_apart(e, resolve.latest(D.decisions(spark, sf_dir))).join(at, "feature_id").select(F.when(F.col("final_class") == "exogenous", "exogenous").otherwise("excluded").alias("list"), F.col("category").alias("value"), "ordinal")
    answers = report.model_curation(e, model(spark, sf_dir), MODEL).join(at, "feature_id").select(F.lit("model").alias("list"), F.col("relation").alias("value"), "ordinal")
    return report.most_common(apart.unionByName(answers))


# ------------------------------------------------------------------ names, ids, scalar functions

@query(rf""", {_NORMAL}, {_PARTS}
SELECT feature_id, name, display AS normalized, lower(display) AS key, CASE WHEN is_a THEN expansion WHEN length(inside) > 2 AND NOT regexp_matches(inside, '^[RSrs+\-,/ ]+$') THEN inside END AS parenthetical,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN is_a THEN [acronym, s] ELSE [] END, CASE WHEN len(pe) > 1 THEN pe ELSE [] END, CASE WHEN len(ps) > 1 THEN ps ELSE [] END,
  CASE WHEN regexp_matches(display, '(?i)[ -]carnitine$') THEN [regexp_replace(display, '(?i)[ -]carnitine$', 'carnitine')] ELSE [] END, CASE WHEN regexp_matches(display, '(?i)[ -]coa$') THEN [regexp_replace(display, '(?i)[ -]coa$', 'coa')] ELSE [] END))), '|') AS alternatives,
array_to_string(list_sort(list_filter([CASE WHEN is_a THEN 'abbrev_parenthetical' END, CASE WHEN len(pe) > 1 OR len(ps) > 1 THEN 'combined_name' END, CASE WHEN display <> base THEN 'salt_stripped' END, CASE WHEN regexp_matches(base, '\b\d+[- ]') THEN 'has_digit_locant' END,
  CASE WHEN regexp_matches(display, '(?i)[ -](carnitine|coa)$') THEN 'conjugate_spacing' END, CASE WHEN regexp_matches(display, '(?i)\bcarnitine\b') THEN 'acylcarnitine' END], lambda x: x IS NOT NULL)), '|') AS flags,
array_to_string({_tags("name")}, '|') AS tags FROM p""")
def s1_ingest(spark, sf_dir):
    """Features with normal form, flags and contaminant tags."""
    out = resolve.ingest(D.features(spark, sf_dir))
    return out.select("feature_id", "name", "normalized", "key", "parenthetical", *[F.array_join(c, "|").alias(c) for c in ("alternatives", "flags", "tags")])


@query(f"""SELECT db, raw_id, {canon("db", "raw_id")} AS id, count(*) AS n FROM candidates GROUP BY db, raw_id""")
def f3_f4_canonical_ids(spark, sf_dir):
    """Canonical accessions and missing values."""
    return D.candidates(spark, sf_dir).groupBy("db", "raw_id").agg(F.count("*").alias("n")).select("db", "raw_id", ids.canonical(F.col("db"), F.col("raw_id")).alias("id"), "n")


@query(r"""SELECT species_id, compartment, CASE WHEN compartment <> '' AND ends_with(species_id, compartment) AND length(species_id) > length(compartment) THEN coalesce(nullif(rtrim(left(species_id, length(species_id) - length(compartment)), '_'), ''), species_id)
WHEN regexp_extract(species_id, '^(.+?)_([a-z]{1,2})$', 1) <> '' THEN regexp_extract(species_id, '^(.+?)_([a-z]{1,2})$', 1) ELSE regexp_replace(species_id, '[a-z]$', '') END AS base FROM species""")
def f6_base_id(spark, sf_dir):
    return D.species(spark, sf_dir).select("species_id", "compartment", ids.base_id(F.col("species_id"), F.col("compartment")).alias("base"))


@query(r"""SELECT species_id, CASE WHEN regexp_replace(x, '[_-]+$', '') <> x THEN nullif(regexp_replace(x, '[_-]+$', ''), '') END AS repaired FROM (SELECT species_id, regexp_replace(species_id, '[a-z]$', '') AS x FROM species)""")
def f25_s4_repair(spark, sf_dir):
    """Ids that lost their compartment's letter, some with a dangling mark, repaired."""
    return D.species(spark, sf_dir).select("species_id", ids.repaired(F.regexp_replace("species_id", "[a-z]$", "")).alias("repaired"))


_GRAMS = "list_distinct(CASE WHEN length({x}) >= 3 THEN list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)) ELSE [] END)"
_FLAT = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


@query(f""", n AS (SELECT DISTINCT name, {_FLAT.format(x="name")} AS f FROM features), g AS (SELECT name, {_GRAMS.format(x="f")} AS g, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM n)
SELECT a.name AS a, b.name AS b, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard
FROM g a JOIN g b ON a.name < b.name WHERE len(a.g) > 0 AND len(b.g) > 0 AND 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) > 0.3""")
def f8_f9_f14_similarity(spark, sf_dir):
    """Similar pairs of distinct names by shared trigrams, with the overlap of their words."""
    from .plans import blocking

    n = D.features(spark, sf_dir).select("name").distinct()
    pairs = blocking.dice_join(n.select(F.col("name").alias("a")), "a", n.select(F.col("name").alias("b")), "b", 0.3, []).where("a < b")
    return pairs.select("a", "b", "dice", names.jaccard(names.tokens(F.col("a")), names.tokens(F.col("b"))).alias("jaccard"))


_MASS = {"C": 12.0, "H": 1.00782503223, "N": 14.00307400443, "O": 15.99491461957, "P": 30.97376199842, "S": 31.9720711744}


@query(r""", f AS (SELECT DISTINCT formula FROM candidates WHERE formula IS NOT NULL), p AS (SELECT formula, regexp_full_match(formula, '(?:(?:C|H|N|O|P|S)[0-9]*)+') AS ok FROM f),
x AS (SELECT formula, ok, regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)') AS parts FROM p),
e AS (SELECT formula, regexp_extract(y, '^[A-Za-z]+') AS el, sum(coalesce(try_cast(regexp_extract(y, '[0-9]+$') AS INT), 1)) AS n FROM (SELECT formula, unnest(parts) AS y FROM x WHERE ok) GROUP BY ALL),
c AS (SELECT formula, string_agg(el || CASE WHEN n > 1 THEN n::INT::VARCHAR ELSE '' END, '' ORDER BY CASE el WHEN 'C' THEN '0' WHEN 'H' THEN '1' ELSE '2' || el END) AS canon,
 sum(n::DOUBLE * CASE el """ + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _MASS.items()) + r""" END) AS mono FROM e GROUP BY formula)
SELECT p.formula, coalesce(canon, upper(p.formula)) AS canonical, round(mono, 5) AS mono_mass, regexp_matches(p.formula, '[RX]([^a-z]|$)') AS pool FROM p LEFT JOIN c USING (formula)""")
def f10_f11_f18_formulas(spark, sf_dir):
    """canonical formula, monoisotopic mass, placeholder."""
    f = F.col("formula")
    return D.candidates(spark, sf_dir).where("formula is not null").select("formula").distinct().select("formula", formula.canonical(f).alias("canonical"), F.round(formula.mono_mass(f), 5).alias("mono_mass"), formula.is_pool(f).alias("pool"))


@query("""SELECT ordinal, seq, round(mass, 4) AS observed, round((mass - 180.06338810304) / 180.06338810304 * 1e6, 3) AS ppm, abs((mass - 180.06338810304) / 180.06338810304 * 1e6) <= 15.0 AS mass_match,
CASE WHEN formula IS NOT NULL AND formula NOT IN ('c5h11no2s', 'RCO2') THEN formula = 'C6H12O6' END AS formula_match FROM (SELECT ordinal, seq, formula, 180.06338810304::DOUBLE + (seq % 100 - 50) * 0.0001::DOUBLE AS mass FROM candidates WHERE source = 'pubchem')""")
def f12_verify(spark, sf_dir):
    """formula and mass of a candidate against a proposed identity."""
    c = D.candidates(spark, sf_dir).where("source = 'pubchem'").select("ordinal", "seq", "formula", (F.lit(180.06338810304) + (F.col("seq") % 100 - 50) * F.lit(0.0001)).alias("mass"))
    v = formula.verify(F.lit("C6H12O6"), F.col("formula"), F.col("mass"))
    return c.withColumn("v", v).select("ordinal", "seq", F.round("mass", 4).alias("observed"), F.round("v.ppm_error", 3).alias("ppm"), "v.mass_match", "v.formula_match")


@query(f"""SELECT s_suppkey, adduct, round(m, 5) AS neutral_mono_mass, round(m - m * 15.0 / 1e6, 5) AS mass_low, round(m + m * 15.0 / 1e6, 5) AS mass_high FROM (
SELECT s_suppkey, unnest([{", ".join(f"'{a}'" for a in DEFAULT_ADDUCTS)}]) AS adduct, s_acctbal + 1100.0 - unnest([{", ".join(repr(ADDUCTS[a]) for a in DEFAULT_ADDUCTS)}]::DOUBLE[]) AS m FROM supplier)""")
def f13_mass_candidates(spark, sf_dir):
    s = D.read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(formula.neutral_masses(F.col("s_acctbal") + 1100.0, [*DEFAULT_ADDUCTS, "[M+Zz]"])).alias("x"))
    return s.select("s_suppkey", "x.*")


@query("""SELECT ordinal, substr(sha256(array_to_string(list_sort(list(db || '=' || id)), '|')), 1, 16) AS fingerprint FROM accepted GROUP BY ordinal""")
def f24_fingerprint(spark, sf_dir):
    """the fingerprint of a set, here the at most five ids of a feature."""
    return D.accepted(spark, sf_dir).groupBy("ordinal").agg(ids.fingerprint(F.collect_list(F.concat("db", F.lit("="), "id"))).alias("fingerprint"))


@query(r"""SELECT note AS name, regexp_matches(lower(note), 'acyl|alkyl') AND NOT regexp_matches(note, '\d{1,2}:\d') AS class_like, count(*) AS n FROM candidates GROUP BY note""")
def f26_class_heuristic(spark, sf_dir):
    c = D.candidates(spark, sf_dir).groupBy(F.col("note").alias("name")).agg(F.count("*").alias("n"))
    return c.select("name", (F.lower("name").rlike("acyl|alkyl") & ~F.col("name").rlike(r"\d{1,2}:\d")).alias("class_like"), "n")


@query(f"""SELECT seq, lower(trim(rationale)) IN {_in(TRIVIAL_RATIONALES)} OR length(trim(rationale)) < 4 AS trivial FROM decisions""")
def f31_trivial_rationale(spark, sf_dir):
    r = F.lower(F.trim("rationale"))
    return D.decisions(spark, sf_dir).select("seq", (r.isin(TRIVIAL_RATIONALES) | (F.length(r) < 4)).alias("trivial"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::VARCHAR END AS pubchem, (s_suppkey * 2)::VARCHAR AS chebi, CASE WHEN s_suppkey % 2 = 0 THEN 'LM' || s_suppkey END AS lipidmaps FROM supplier""")
def s10_dblink(spark, sf_dir):
    """The first line of a key among a record's links, trimmed."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    lines = F.array_compact(F.array(F.when(k % 3 != 0, F.concat(F.lit("PubChem: "), text(k), F.lit(" "))), F.concat(F.lit("ChEBI:  "), text(k * 2)), F.concat(F.lit("ChEBI: "), text(k * 3)), F.when(k % 2 == 0, F.concat(F.lit("LIPIDMAPS: LM"), text(k)))))
    d = D.read(spark, sf_dir, "supplier").select("s_suppkey", lines.alias("l"))
    return d.select("s_suppkey", *[readers.dblink(F.col("l"), key).alias(name) for key, name in (("PubChem", "pubchem"), ("ChEBI", "chebi"), ("LIPIDMAPS", "lipidmaps"))])


@query("SELECT p_partkey::VARCHAR AS name FROM part WHERE p_partkey IS NOT NULL")
def s2_default_column(spark, sf_dir):
    """The first column of a sheet as text, without nulls."""
    return readers.column(D.read(spark, sf_dir, "part").select("p_partkey", "p_name"))


@query("""SELECT p AS path, string_split(string_split(p, '/')[-1], '.')[1] AS label FROM (SELECT DISTINCT '/models/' || p_brand || '.' || p_size || '.xml' AS p FROM part)""")
def f28_model_label(spark, sf_dir):
    path = F.concat(F.lit("/models/"), "p_brand", F.lit("."), F.col("p_size").cast("string"), F.lit(".xml"))
    return D.read(spark, sf_dir, "part").select(path.alias("path")).distinct().select("path", readers.model_label_of(F.col("path")).alias("label"))


_FORMULA_OF = "[" + ", ".join(f"'{x}'" for x in D.FORMULAS) + f"][p_partkey % {len(D.FORMULAS)} + 1]"


@query(f"""SELECT p_partkey AS cid, f AS found, CASE WHEN f THEN p_partkey::VARCHAR END AS pubchem, CASE WHEN f THEN 'KEY' || p_partkey || '-N' END AS inchikey, CASE WHEN f THEN {_FORMULA_OF} END AS formula, CASE WHEN f THEN p_name END AS iupac,
CASE WHEN f THEN (p_partkey % 900 + 100)::DOUBLE + 0.0634::DOUBLE END AS mass, CASE WHEN f AND p_partkey % 5 <> 0 THEN least(p_partkey % 40 + 1, 25) ELSE 0 END::INT AS n_names, CASE WHEN f AND p_partkey % 5 <> 0 THEN 'name ' || least(p_partkey % 40 + 1, 25) END AS last_name FROM (SELECT *, p_partkey % 7 <> 0 AS f FROM part)""")
def s12_s16_compounds(spark, sf_dir):
    """Recorded answers about compounds, with 25 names at most."""
    c = readers.compound(D.compound_payloads(spark, sf_dir), "cid")
    return c.select("cid", "found", "pubchem", "inchikey", "formula", "iupac", "mass", F.size("names").alias("n_names"), F.try_element_at("names", F.lit(-1)).alias("last_name"))


_TERM = f"""t AS (SELECT 'CHEBI:' || p_partkey AS id, p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AS found, p_partkey, p_name, p_brand, {_FORMULA_OF} AS form FROM part)"""


@query(f""", {_TERM} SELECT id, found, CASE WHEN found THEN p_name || ';' || p_brand ELSE '' END AS names, CASE WHEN found AND p_partkey % 4 < 3 THEN form END AS formula, CASE WHEN found THEN (p_partkey % 900 + 100)::DOUBLE + 0.5 END AS mass,
CASE WHEN found AND p_partkey % 3 <> 0 THEN 'KEY' || p_partkey || '-N' END AS inchikey FROM t""")
def s15_terms(spark, sf_dir):
    """Recorded answers about terms: label and synonyms, and each fact under the first of its keys."""
    return readers.term(D.term_payloads(spark, sf_dir)).withColumn("names", F.array_join("names", ";"))


@query(f""", {_HELD}, {_TERM}, a AS (SELECT DISTINCT db, id FROM held), r AS (SELECT 'chebi' AS db, id, 2 AS n, CASE WHEN p_partkey % 4 < 3 THEN form END AS formula FROM t WHERE found
UNION ALL SELECT 'pubchem', p_partkey::VARCHAR, CASE WHEN p_partkey % 5 <> 0 THEN least(p_partkey % 40 + 1, 25) ELSE 0 END, {_FORMULA_OF} FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'kegg', 'C' || lpad(p_partkey::VARCHAR, greatest(5, length(p_partkey::VARCHAR))::INT, '0'), 1, {_FORMULA_OF} FROM part),
j AS (SELECT a.db, a.id, n, formula, CASE WHEN a.db = 'inchikey' THEN 'unsupported db inchikey' WHEN a.db = 'kegg' AND ends_with(a.id, '5') THEN 'exit 1' END AS error FROM a LEFT JOIN r ON r.db = a.db AND r.id = a.id)
SELECT db, id, n IS NOT NULL AND error IS NULL AS found, CASE WHEN error IS NULL THEN coalesce(n, 0) ELSE 0 END::INT AS n_names, CASE WHEN n IS NOT NULL AND error IS NULL THEN formula END AS formula, db = 'hmdb' AS noted, error FROM j""")
def s17_fetch(spark, sf_dir):
    """Records of each accepted id by its database; no source, no support and failure are told apart."""
    asked = held(spark, sf_dir).select("db", "id").distinct()
    n = F.col("p_partkey").cast("string")
    kegg = D.read(spark, sf_dir, "part").select(F.concat(F.lit("C"), F.lpad(n, F.greatest(F.lit(5), F.length(n)), F.lit("0"))).alias("id"), F.array("p_name").alias("names"), D.pick(D.FORMULAS, F.col("p_partkey") % len(D.FORMULAS)).alias("formula"))
    compounds = readers.compound(D.compound_payloads(spark, sf_dir), "cid").where("found").select(F.col("pubchem").alias("id"), "names", "formula")
    failed = asked.where("db = 'kegg' and endswith(id, '5')").withColumn("error", F.lit("exit 1"))
    out = readers.fetch(asked, {"kegg": kegg, "chebi": readers.term(D.term_payloads(spark, sf_dir)).where("found"), "pubchem": compounds}, failed)
    return out.select("db", "id", "found", F.size("names").alias("n_names"), "formula", F.col("note").isNotNull().alias("noted"), "error")


# ------------------------------------------------------------------ joins


@query(f""", k AS (SELECT lower(trim(note)) AS key, db, arg_min(id, {{'s': seq, 'i': id}}) AS id FROM candidates WHERE source = 'metaboanalyst' AND id IS NOT NULL GROUP BY ALL),
x AS (SELECT key, {", ".join(f"min(id) FILTER (db = '{d}') AS {d}" for d in NAMESPACES)} FROM k GROUP BY key)
SELECT feature_id, name, {", ".join(NAMESPACES)}, CASE WHEN coalesce({", ".join(NAMESPACES)}) IS NULL THEN 'no_match' ELSE 'match' END AS status FROM features LEFT JOIN x ON lower(trim(name)) = key""")
def j1_exact_match(spark, sf_dir):
    """Names to ids by exact name, each distinct name looked up once."""
    return resolve.exact_match(D.features(spark, sf_dir), resolve.name_index(D.candidates(spark, sf_dir)))


@query("""SELECT p_partkey, array_to_string(CASE p_partkey % 4 WHEN 0 THEN ['C' || p_partkey] WHEN 1 THEN ['CHEBI:' || p_partkey, 'CHEBI:7'] WHEN 2 THEN [] ELSE ['CHEBI:' || p_partkey] END, ';') AS ids FROM part""")
def f30_annotations(spark, sf_dir):
    """annotations of one id or a list of them, each id in one spelling."""
    k = F.col("p_partkey")
    text = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("C"), text)).when(k % 4 == 1, F.concat(F.lit('["'), text, F.lit('","CHEBI:7","","CHEBI:'), text, F.lit('"]'))).when(k % 4 == 3, F.concat(F.lit("CHEBI:"), text))
    db = F.when(k % 4 == 0, "kegg").otherwise("chebi")
    return D.read(spark, sf_dir, "part").select("p_partkey", F.array_join(ids.canonical_list(db, ids.listed(raw)), ";").alias("ids"))


@query(""", r AS (SELECT DISTINCT p_partkey AS position, p_name AS record FROM part), t AS (SELECT DISTINCT lower(regexp_extract(p_name, '[A-Za-z]+$')) AS term FROM part UNION SELECT left(lower(p_name), 2) FROM part), h AS (SELECT term, position, record, row_number() OVER (PARTITION BY term ORDER BY position) AS rank FROM t JOIN r ON contains(lower(record), term) WHERE term <> '')
SELECT term, rank::INT AS rank, position, record FROM h WHERE rank <= 6""")
def s8_substring_search(spark, sf_dir):
    """The first six records whose name contains a term."""
    p = D.read(spark, sf_dir, "part")
    terms = p.select(F.explode(F.array(F.lower(F.regexp_extract("p_name", "[A-Za-z]+$", 0)), F.substring(F.lower("p_name"), 1, 2))).alias("term")).distinct()
    return resolve.substring_search(terms, p.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("record")))


@query(f""", {_HELD}, r AS (SELECT db, id, list_sort(list_distinct(list(note))) AS names FROM candidates WHERE id IS NOT NULL AND source = 'chebi-ols4' AND db <> 'hmdb' GROUP BY db, id)
SELECT a.db, a.id, names IS NOT NULL AS found, coalesce(len(names), 0)::INT AS n_names, names[1] AS first_name, CASE WHEN names IS NULL AND a.db = 'hmdb' THEN 'not available' WHEN names IS NULL THEN 'not found' END AS note
FROM (SELECT DISTINCT db, id FROM held) a LEFT JOIN r ON a.db = r.db AND a.id = r.id""")
def j3_s9_fetch_records(spark, sf_dir):
    """Accepted ids against their own records; misses stay as rows."""
    c = D.candidates(spark, sf_dir).where("id is not null and source = 'chebi-ols4' and db <> 'hmdb'")
    records = c.groupBy("db", "id").agg(F.array_sort(F.collect_set("note")).alias("names"))
    return resolve.fetch_records(held(spark, sf_dir).select("db", "id"), records)


@query(f""", q AS (SELECT DISTINCT ordinal * 10 + CASE db WHEN 'kegg' THEN 0 ELSE 1 END AS query_id, db, id FROM accepted WHERE db IN ('kegg', 'chebi')),
b AS (SELECT src_db, {canon("src_db", "src_id")} AS sid, {canon("'hmdb'", "hmdb")} AS target FROM bridge),
g AS (SELECT query_id, db, id, list_sort(coalesce(list_distinct(list(target)), [])) AS t FROM q LEFT JOIN b ON src_db = db AND sid = id GROUP BY query_id, db, id)
SELECT query_id, db, id, array_to_string(t, ';') AS targets, t[1] AS first, len(t) > 1 AS ambiguous FROM g""")
def s11_j2_bridge(spark, sf_dir):
    """Cross-references by explicit query id, canonical on both sides."""
    a = D.accepted(spark, sf_dir).where("db in ('kegg', 'chebi')")
    return resolve.bridge_xref(a.select((F.col("ordinal") * 10 + F.when(F.col("db") == "kegg", 0).otherwise(1)).alias("query_id"), "db", "id").distinct(), D.bridge(spark, sf_dir))


@query(""", m AS (SELECT ordinal, source, db, id, min(seq) AS first_seq, arg_max(note, seq) FILTER (note <> '') AS note, arg_max(formula, seq) FILTER (formula <> '') AS formula, count(*) AS n FROM candidates WHERE id IS NOT NULL GROUP BY ALL) SELECT * FROM m""")
def candidate_upsert(spark, sf_dir):
    """State: one candidate per key, the last values that aren't empty win."""
    return resolve.upsert_candidates(D.candidates(spark, sf_dir))


@query(f""", {_NORMAL}, {_HELD}, un AS (SELECT DISTINCT ordinal FROM held h WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.ordinal = h.ordinal AND c.db = h.db AND c.id = h.id)),
r AS (SELECT e.*, coalesce({", ".join(NAMESPACES)}) IS NOT NULL AS has_ids, un.ordinal IS NOT NULL AS unbacked, coalesce(origin, CASE WHEN final_class = 'xenobiotic-excluded' THEN coalesce({_origin("e.name")}, 'contaminant') END) AS given,
 coalesce(final_class, CASE WHEN kegg IS NOT NULL THEN 'KEGG-mapped' WHEN hmdb IS NOT NULL THEN 'HMDB-mapped' WHEN coalesce({", ".join(NAMESPACES)}) IS NOT NULL THEN 'structure-only' ELSE 'unmapped' END) AS got,
 regexp_matches(base, '\\b\\d+[- ]') AS locant FROM entries e JOIN normal n USING (feature_id) LEFT JOIN un ON un.ordinal = e.ordinal),
k AS (SELECT *, CASE WHEN NOT has_ids AND final_class IN ('xenobiotic-excluded', 'unmapped') THEN 'terminal' WHEN NOT has_ids AND final_class = 'exogenous' THEN 'tagged' WHEN unbacked THEN 'unbacked' ELSE 'mapped' END AS kind,
 CASE {" ".join(f"WHEN given = '{o}' THEN '{c}'" for o, c in CLASS_OF_ORIGIN.items())} END AS implied FROM r),
m AS (SELECT *, kind = 'mapped' AND got IN {_KEPT} AS kept FROM k)
SELECT feature_id, CASE kind WHEN 'unbacked' THEN 'refused: id without a candidate' WHEN 'terminal' THEN 'exclude' ELSE 'accept' END AS action, CASE WHEN kind <> 'unbacked' THEN got END AS routed_class,
CASE kind WHEN 'unbacked' THEN NULL WHEN 'terminal' THEN coalesce(confidence, CASE final_class WHEN 'unmapped' THEN 'U' ELSE 'X' END) WHEN 'tagged' THEN coalesce(confidence, 'M4') ELSE coalesce(confidence, 'M2') END AS tier,
CASE WHEN kind = 'unbacked' THEN NULL WHEN kind = 'mapped' AND given IS NULL AND got IN ('KEGG-mapped', 'HMDB-mapped', 'structure-only') THEN 'endogenous' ELSE given END AS routed_origin,
CASE WHEN kind = 'unbacked' THEN '' ELSE array_to_string(list_filter([CASE WHEN given NOT IN {_in(ORIGINS)} THEN 'origin not recognized' END, CASE WHEN implied <> final_class THEN 'origin implies another class' END,
 CASE WHEN kept AND len({_tags("name")}) > 0 THEN 'kept under a non-biological name' END, CASE WHEN (kind = 'tagged' OR kept) AND got = 'exogenous' AND given IS NULL THEN 'exogenous without origin' END,
 CASE WHEN kept AND locant AND coalesce(confidence, 'M2') <> 'M1' THEN 'locant by a route that isn''t exact' END], lambda x: x IS NOT NULL), '; ') END AS warnings FROM m""")
def p5_p6_routing(spark, sf_dir):
    """What recording each decision would do, and its warnings."""
    unbacked = resolve.fabricated(held(spark, sf_dir).select("ordinal", "db", "id"), D.candidates(spark, sf_dir))
    return resolve.route(D.entries(spark, sf_dir), unbacked)


@query(f""", {_HELD} SELECT ordinal, db, id FROM held h WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.ordinal = h.ordinal AND c.db = h.db AND c.id = h.id)""")
def p8_anti_fabrication(spark, sf_dir):
    return resolve.fabricated(held(spark, sf_dir).select("ordinal", "db", "id"), D.candidates(spark, sf_dir))


@query(r"""SELECT feature_id, name, array_to_string(list_sort(list_filter([CASE WHEN regexp_matches(name, '^[A-Z0-9]{2,7}\s*\(.{3,}\)$') AND regexp_matches(name, '^[A-Z]') THEN 'abbrev_parenthetical' END,
 CASE WHEN regexp_matches(name, '[^=]=[^=]|[^/]/[^/]') THEN 'combined_name' END, CASE WHEN ends_with(name, ' monohydrate') THEN 'salt_stripped' END, CASE WHEN regexp_matches(name, '\b\d+[- ]') THEN 'has_digit_locant' END], lambda x: x IS NOT NULL)), ';') AS flags
FROM features WHERE (regexp_matches(name, '^[A-Z0-9]{2,7}\s*\(.{3,}\)$') AND regexp_matches(name, '^[A-Z]')) OR regexp_matches(name, '[^=]=[^=]|[^/]/[^/]') OR regexp_matches(trim(name), '^[A-Z][a-z]+$')""".replace("\\\\", "\\"))
def p11_risky(spark, sf_dir):
    return resolve.risky(D.features(spark, sf_dir))


@query(f""", {_NORMAL}, d AS (SELECT unnest(['kegg', 'pubchem', 'chebi']) AS db), al AS (SELECT ordinal, d.db, query, seq FROM candidates, d WHERE contains(source, d.db) AND query <> '' AND NOT regexp_matches(query, '^({"|".join(NAMESPACES)}):')
UNION ALL SELECT ordinal, d.db, display, {2**62} FROM entries JOIN normal USING (feature_id), d WHERE display <> ''), fs AS (SELECT ordinal, db, query, min(seq) AS s FROM al GROUP BY ALL)
SELECT ordinal, db, string_agg(query, ' | ' ORDER BY s, query) AS queries FROM fs GROUP BY ordinal, db""".replace("JOIN normal USING (feature_id), d", "JOIN (SELECT feature_id, display FROM normal) USING (feature_id), d"))
def p12_u4_harmonized(spark, sf_dir):
    """The names that the sources of a database were asked for, and the normal form, each once, in order."""
    return resolve.harmonized_queries(D.entries(spark, sf_dir), D.candidates(spark, sf_dir))


@query(f""", {_HELD} SELECT ordinal, db, id FROM held SEMI JOIN (SELECT DISTINCT ordinal, db, id FROM decisions WHERE action = 'backcheck') USING (ordinal, db, id)""")
def p10_backchecked(spark, sf_dir):
    return resolve.backchecked(held(spark, sf_dir).select("ordinal", "db", "id"), D.decisions(spark, sf_dir))


@query(f""", {_HELD}, sh AS (SELECT db, id, count(DISTINCT lower(trim(name))) AS n FROM held GROUP BY db, id HAVING count(DISTINCT lower(trim(name))) > 1),
by_ AS (SELECT ordinal, id, array_to_string(list_sort(list_distinct(list(source))), ',') AS detail FROM candidates WHERE db = 'kegg' AND source IN {_in(INDIRECT)} GROUP BY ordinal, id)
SELECT ordinal, 'shared' AS warning, db, id, (n - 1) || ' other names' AS detail FROM held JOIN sh USING (db, id)
UNION ALL SELECT ordinal, 'unchecked', db, id, detail FROM held JOIN by_ USING (ordinal, id) WHERE db = 'kegg' AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.action = 'backcheck' AND d.ordinal = held.ordinal AND d.db = 'kegg' AND d.id = held.id)""")
def p7_accept_warnings(spark, sf_dir):
    """Accepted ids that others hold, or that were never held against their record."""
    return resolve.accept_warnings(held(spark, sf_dir), D.candidates(spark, sf_dir), D.decisions(spark, sf_dir))


@query(f""", {_HELD}, {_NORMAL}, nn AS (SELECT DISTINCT name, display FROM normal), mt AS (SELECT DISTINCT h.ordinal, h.db, h.id, display AS l, c.note AS r FROM held h JOIN nn ON nn.name = h.name JOIN candidates c ON c.ordinal = h.ordinal AND c.db = h.db AND c.id = h.id WHERE c.note <> ''),
{verdicts("mt")} SELECT ordinal, db, id, r AS "match", verdict, conflicts FROM mt JOIN vd USING (l, r) WHERE verdict IN ('conflict', 'class-level')""")
def p7_name_warnings(spark, sf_dir):
    """Accepted ids that came under the name of another compound or of a class."""
    return resolve.name_warnings(held(spark, sf_dir), D.candidates(spark, sf_dir)).select("ordinal", "db", "id", "match", "verdict", "conflicts")


@query(f""", mt AS (SELECT DISTINCT feature_id, name AS l, note AS r FROM features JOIN candidates USING (ordinal) WHERE source = 'metaboanalyst'), {verdicts("mt")}
SELECT feature_id, l AS name, r AS "match", verdict, conflicts FROM mt JOIN vd USING (l, r) WHERE verdict IN ('conflict', 'class-level')""")
def p11_risky_matches(spark, sf_dir):
    """Exact matches whose record is another compound or a class by its name."""
    c = D.candidates(spark, sf_dir).where("source = 'metaboanalyst'").select("ordinal", F.col("note").alias("match"))
    return resolve.risky_matches(D.features(spark, sf_dir).join(c, "ordinal").select("feature_id", "name", "match"))


@query(f""", {_HELD} SELECT db, id, count(*) AS n, count(DISTINCT lower(trim(name))) AS n_names, min(ordinal) AS first, max(ordinal) AS last FROM held GROUP BY db, id HAVING count(*) > 1""")
def j4_shared_ids(spark, sf_dir):
    """Ids held by several features."""
    return collide.shared_ids(held(spark, sf_dir))


#: Of the names of candidates, those of a class: lipids without a chain or head group of their own.
_GENERIC = _in(["1-Acyl-sn-glycero-3-phosphocholine"])
_EVIDENCE = f"""{_HELD}, k AS (SELECT DISTINCT ordinal, db, id FROM decisions WHERE action = 'backcheck' AND (verdict = 'class-level' OR db_resolution = 'class')),
raised AS (SELECT DISTINCT ordinal, [{", ".join(f"'{f}'" for f in [*FLAGS, "old_flag"])}][(ordinal + o) % {len(FLAGS) + 1} + 1] AS flag FROM entries, (SELECT unnest([0, 4]) AS o)),
ev AS (SELECT * FROM k UNION SELECT ordinal, db, id FROM candidates WHERE id IS NOT NULL AND note IN {_GENERIC} UNION SELECT h.ordinal, db, id FROM held h JOIN raised r ON r.ordinal = h.ordinal WHERE flag = 'class_level_id'),
sev AS (SELECT h.db, h.id, count(*) AS n, CASE WHEN count(DISTINCT lower(trim(name))) = 1 THEN 'duplicate-name' WHEN count(ev.ordinal) > 0 THEN 'class-id-shared' ELSE 'collision' END AS severity FROM held h LEFT JOIN ev ON ev.ordinal = h.ordinal AND ev.db = h.db AND ev.id = h.id GROUP BY h.db, h.id HAVING count(*) > 1)"""


def raised(e: DataFrame) -> DataFrame:
    """ordinal, flag: two flags for each entry, in turn."""
    flags = [*FLAGS, "old_flag"]
    return e.select("ordinal", F.explode(F.array(F.lit(0), F.lit(4))).alias("o")).select("ordinal", D.pick(flags, (F.col("ordinal") + F.col("o")) % len(flags)).alias("flag"))


def evidence(e: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    return audit.class_evidence(e, c, d, raised(e))


@query(f""", {_EVIDENCE} SELECT db, id, n, severity FROM sev""")
def j5_severity(spark, sf_dir):
    """What each sharing means, by all evidence of class-level ids."""
    e = D.entries(spark, sf_dir)
    return collide.severity(audit.held(e), evidence(e, D.candidates(spark, sf_dir), D.decisions(spark, sf_dir)))


@query(f""", {_EVIDENCE} SELECT db, id, count(DISTINCT ordinal) AS n FROM ev GROUP BY db, id""")
def f23_class_evidence(spark, sf_dir):
    """ids that back-checks, names of candidates or flags show to be class-level."""
    e = D.entries(spark, sf_dir)
    return evidence(e, D.candidates(spark, sf_dir), D.decisions(spark, sf_dir)).groupBy("db", "id").agg(F.count_distinct("ordinal").alias("n"))


@query(f""", {_HELD} SELECT ordinal, db, id, arg_min(note, {{'s': seq, 'n': note}}) AS note, min(seq) AS seq FROM held JOIN candidates USING (ordinal, db, id) WHERE source <> 'metaboanalyst' GROUP BY ordinal, db, id""")
def j6_first_candidate(spark, sf_dir):
    """The first candidate, not of the exact source, behind an accepted id."""
    c = D.candidates(spark, sf_dir).where("source <> 'metaboanalyst'").select("ordinal", "db", "id", "seq", "note")
    out = held(spark, sf_dir).select("ordinal", "db", "id").join(c, ["ordinal", "db", "id"]).groupBy("ordinal", "db", "id").agg(F.min(F.struct("seq", "note")).alias("b"))
    return out.select("ordinal", "db", "id", "b.note", "b.seq")


_BASE = r"""base AS (SELECT *, CASE WHEN compartment <> '' AND ends_with(species_id, compartment) AND length(species_id) > length(compartment) THEN coalesce(nullif(rtrim(left(species_id, length(species_id) - length(compartment)), '_'), ''), species_id)
WHEN regexp_extract(species_id, '^(.+?)_([a-z]{1,2})$', 1) <> '' THEN regexp_extract(species_id, '^(.+?)_([a-z]{1,2})$', 1) ELSE regexp_replace(species_id, '[a-z]$', '') END AS base FROM species),
model AS (SELECT base, arg_min(name, ordinal) FILTER (name <> '') AS name, arg_min(formula, ordinal) FILTER (formula <> '') AS formula, arg_min(charge, ordinal) AS charge, list_sort(coalesce(list_distinct(list(name) FILTER (name <> '')), [])) AS names,
 list_sort(coalesce(list_distinct(list(compartment) FILTER (compartment <> '')), [])) AS compartments, list_sort(list_distinct(list(species_id))) AS species, count(*) AS n, min(kegg) AS kegg, min(hmdb) AS hmdb, min(chebi) AS chebi, arg_min(mass, ordinal) AS mass FROM base GROUP BY base)"""


def model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.index(D.species(spark, sf_dir))


@query(f""", {_BASE} SELECT base, name, formula, charge, array_to_string(names, '|') AS names, array_to_string(compartments, '|') AS compartments, array_to_string(species, '|') AS species, n, kegg, hmdb, chebi, mass, coalesce(regexp_matches(formula, '[RX]([^a-z]|$)'), false) AS pool FROM model""")
def a8_model_index(spark, sf_dir):
    """The model's index, one row per base id."""
    return model(spark, sf_dir).select("base", "name", "formula", "charge", *[F.array_join(c, "|").alias(c) for c in ("names", "compartments", "species")], "n", "kegg", "hmdb", "chebi", "mass", "pool")


@query(f""", {_BASE} SELECT count(*) AS n_base, sum(n)::BIGINT AS n_species, count(*) FILTER (len(names) = 0) AS n_unnamed FROM model""")
def a17_model_stats(spark, sf_dir):
    return model(spark, sf_dir).agg(F.count("*").alias("n_base"), F.sum("n").alias("n_species"), F.count_if(F.size("names") == 0).alias("n_unnamed"))


_XWALK = f""", {_BASE}, x AS (SELECT DISTINCT base, db, id FROM (UNPIVOT (SELECT base, kegg, hmdb, chebi FROM base) ON kegg, hmdb, chebi INTO NAME db VALUE id)),
h AS (SELECT a.ordinal, a.db, CASE a.db WHEN 'kegg' THEN 0 WHEN 'hmdb' THEN 1 ELSE 2 END AS place, list_sort(list_distinct(list(base))) AS bases FROM accepted a JOIN x ON a.db = x.db AND a.id = x.id GROUP BY a.ordinal, a.db),
xwalk AS (SELECT ordinal, arg_min(db, place) AS via, arg_min(bases, place) AS bases FROM h GROUP BY ordinal)"""


@query(_XWALK + """ SELECT ordinal, via, array_to_string(bases, ';') AS bases, len(bases)::INT AS n_bases FROM xwalk""")
def j7_crosswalk(spark, sf_dir):
    """Ids to model species, the first namespace that hits wins."""
    s = D.species(spark, sf_dir).withColumn("base", ids.base_id(F.col("species_id"), F.col("compartment")))
    return resolve.crosswalk(D.accepted(spark, sf_dir), s)


@query(_XWALK + """ SELECT e.ordinal, feature_id, name FROM entries e WHERE kegg IS NOT NULL AND final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous') AND NOT EXISTS (SELECT 1 FROM xwalk WHERE xwalk.ordinal = e.ordinal)""")
def j17_p13_gaps(spark, sf_dir):
    """Model-relevant entries whose ids lead to no species."""
    e = D.entries(spark, sf_dir).where(F.col("kegg").isNotNull() & F.col("final_class").isin(*PRIMARY, "exogenous"))
    return e.join(QUERIES["j7_crosswalk"](spark, sf_dir).select("ordinal"), "ordinal", "left_anti").select("ordinal", "feature_id", "name")


@query(f""", {_BASE}, asked AS (SELECT DISTINCT mam AS id FROM entries WHERE mam IS NOT NULL UNION SELECT species_id FROM species), k AS (SELECT base AS id, 0 AS place, base FROM model UNION ALL SELECT unnest(species), 1, base FROM model),
b AS (SELECT id, min({{'p': place, 'b': base}}) AS b FROM k GROUP BY id)
SELECT asked.id, b.id IS NOT NULL AS found, b.b AS base, CASE b.p WHEN 0 THEN 'base-id' WHEN 1 THEN 'species-id' END AS by FROM asked LEFT JOIN (SELECT id, b.p, b.b FROM b) b ON b.id = asked.id""".replace("SELECT id, b.p, b.b FROM b", "SELECT id, b['p'] AS p, b['b'] AS b FROM b"))
def j12_species_check(spark, sf_dir):
    """Base ids, else species ids, that the model has."""
    asked = D.entries(spark, sf_dir).where("mam is not null").select(F.col("mam").alias("id")).unionByName(D.species(spark, sf_dir).select(F.col("species_id").alias("id"))).distinct()
    return species.lookup(asked, model(spark, sf_dir))


def _score_sql(asked: str = "SELECT DISTINCT name AS query FROM features") -> str:
    g = lambda x: _GRAMS.format(x=x)
    return f"""m AS (SELECT base, list_transform(species, lambda x: lower(x)) AS sl, unnest(CASE WHEN len(names) = 0 THEN [base] ELSE names END) AS name FROM model), q AS ({asked}),
qg AS (SELECT query, lower(query) AS ql, lower(trim(query)) AS qt, {g("qf")} AS g, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS t FROM (SELECT query, {_FLAT.format(x="query")} AS qf FROM q)),
mg AS (SELECT base, sl, name, lower(name) AS nl, lower(base) AS bl, {g("f")} AS g, {g("fb")} AS gb, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM (SELECT *, {_FLAT.format(x="name")} AS f, regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]', '', 'g') AS fb FROM m)),
p AS (SELECT query, base, qt, nl, bl, qt = bl OR list_contains(sl, qt) AS same, qg.t AS t, mg.t AS u, greatest(CASE WHEN len(qg.g) = 0 OR len(mg.g) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(qg.g, mg.g)) / (len(qg.g) + len(mg.g)) END, CASE WHEN len(qg.g) = 0 OR len(gb) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(qg.g, gb)) / (len(qg.g) + len(gb)) END)::DOUBLE AS d FROM qg, mg),
s AS (SELECT query, base, unnest([{{'s': CASE WHEN same THEN 96.0 ELSE 0.0 END::DOUBLE, 'o': 0, 'k': 'id-exact'}}, {{'s': CASE WHEN NOT same AND contains(bl, qt) THEN 60.0 + 20.0 * length(qt) / length(bl) ELSE 0.0 END, 'o': -1, 'k': 'id-substring'}},
 {{'s': CASE WHEN qt = nl THEN 100.0 ELSE 0.0 END, 'o': -2, 'k': 'name-exact'}}, {{'s': CASE WHEN qt <> nl AND (contains(nl, qt) OR contains(qt, nl)) THEN 50.0 + 35.0 * (least(length(qt), length(nl)) / greatest(length(qt), length(nl))) ELSE 0.0 END, 'o': -3, 'k': 'name-substring'}},
 {{'s': CASE WHEN qt <> nl AND len(t) > 0 AND len(u) > 0 THEN 60.0 * (len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u)))) + CASE WHEN len(list_intersect(t, u)) = len(t) THEN 10.0 ELSE 0.0 END ELSE 0.0 END, 'o': -4, 'k': 'name-tokens'}},
 {{'s': CASE WHEN qt <> nl THEN CASE WHEN d > 0.8 THEN 100.0 * d ELSE 60.0 * d END ELSE 0.0 END, 'o': -5, 'k': 'name-trigram'}}]) AS x FROM p),
b AS (SELECT query, base, max({{'s': x.s, 'o': x.o, 'k': x.k}}) AS x FROM s GROUP BY query, base, (SELECT 1)),"""


@query(f""", {_BASE}, {_score_sql()} r AS (SELECT query, base, max({{'s': round(x.s, 1), 'o': x.o, 'k': x.k}}) AS x FROM b WHERE x.s >= 30.0 GROUP BY query, base),
w AS (SELECT query, base, x.s AS score, x.k AS kind, row_number() OVER (PARTITION BY query ORDER BY x.s DESC, base)::INT AS rank FROM r) SELECT * FROM w WHERE rank <= 25""")
def j13_name_search(spark, sf_dir):
    """The best 25 species per name, by the best of six routes."""
    return species.search(D.features(spark, sf_dir).select(F.col("name").alias("query")), model(spark, sf_dir))


@query(f""", {_BASE}, q AS (SELECT name, {_GRAMS.format(x="f")} AS g FROM (SELECT DISTINCT name, {_FLAT.format(x="name")} AS f FROM features)), m AS (SELECT base, name, {_GRAMS.format(x="f")} AS g FROM (SELECT base, name, {_FLAT.format(x="name")} AS f FROM (SELECT base, unnest(names) AS name FROM model))),
d AS (SELECT q.name AS query, base, round(max(2.0 * len(list_intersect(q.g, m.g)) / (len(q.g) + len(m.g)))::DOUBLE, 3) AS dice FROM q, m WHERE len(q.g) > 0 AND len(m.g) > 0 AND 2.0 * len(list_intersect(q.g, m.g)) / (len(q.g) + len(m.g)) > 0.4 GROUP BY q.name, base),
w AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dice DESC, base DESC)::INT AS rank FROM d) SELECT * FROM w WHERE rank <= 5""")
def o3_top_dice(spark, sf_dir):
    """O3: the plain scorer's top five."""
    return species.top_dice(D.features(spark, sf_dir).select(F.col("name").alias("query")), model(spark, sf_dir))


@query(f""", {_BASE}, a AS (SELECT s_suppkey AS key, s_acctbal + 1100.0 AS q FROM supplier) SELECT key, base, round((85.0 - abs(mass - q) / (q * (500.0 / 1e6)) * 5.0)::DOUBLE, 1) AS score FROM a, model WHERE q > 0 AND mass > 0 AND abs(mass - q) <= q * (500.0 / 1e6)""")
def j14_mass_range(spark, sf_dir):
    """Masses within a window, by logarithmic buckets."""
    asked = D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") + 1100.0).alias("mass"))
    return species.within_ppm(asked, model(spark, sf_dir).select("base", "mass"), 500.0)


@query(f""", {_BASE}, c AS (SELECT base, CASE formula WHEN 'HO4C4H5' THEN 'C4H6O4' ELSE upper(formula) END AS canon FROM model WHERE formula IS NOT NULL),
a AS (SELECT DISTINCT CASE formula WHEN 'HO4C4H5' THEN 'C4H6O4' ELSE upper(formula) END AS canon FROM candidates WHERE formula IS NOT NULL) SELECT canon, base FROM a JOIN c USING (canon)""")
def j15_formula_join(spark, sf_dir):
    """Species of a canonical formula."""
    asked = D.candidates(spark, sf_dir).where("formula is not null").select("formula").distinct()
    return species.by_formula(asked, model(spark, sf_dir))


@query(f""", {_BASE}, {_score_sql()} r AS (SELECT query, base, max(round(x.s, 1)) AS s FROM b WHERE x.s >= 30.0 GROUP BY query, base), w AS (SELECT query, base, row_number() OVER (PARTITION BY query ORDER BY s DESC, base) AS rank FROM r)
SELECT query, CASE formula WHEN 'HO4C4H5' THEN 'C4H6O4' ELSE upper(formula) END AS canon, count(*) AS n, string_agg(base, ';' ORDER BY base) AS bases FROM w JOIN model USING (base) WHERE rank <= 25 AND formula IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def a13_same_formula(spark, sf_dir):
    """Formulas shared by several of a query's best hits."""
    m = model(spark, sf_dir)
    return species.same_formula(species.search(D.features(spark, sf_dir).select(F.col("name").alias("query")), m), m)


_PLACED = "unnest([0, 1]) AS place, unnest([" + ", ".join(f"[{', '.join(chr(39) + n + chr(39) for n in D.NAMES)}][{at} % {len(D.NAMES)} + 1]" for at in ("s_suppkey", "(s_suppkey * 7 + 1)")) + "]) AS query"
_FOLD = """list_reduce(list_prepend({'pos': -1, 's': -1.0::DOUBLE, 'k': NULL::VARCHAR, 'm': NULL::VARCHAR}, list_sort(list({'pos': pos, 's': s, 'k': k, 'm': m}))), lambda a, x: CASE WHEN x.s > a.s THEN {'pos': x.pos, 's': round(x.s, 1), 'k': x.k, 'm': x.m} ELSE a END)"""
_RANKED = """fo AS (SELECT key, base, """ + _FOLD + """ AS f FROM hits GROUP BY key, base), rk AS (SELECT key, base, f.s AS score, f.k AS kind, f.m AS matched, row_number() OVER (PARTITION BY key ORDER BY f.s DESC, base)::INT AS rank FROM fo)"""


@query(f""", {_BASE}, sp AS (SELECT s_suppkey AS key, {_PLACED} FROM supplier), {_score_sql("SELECT DISTINCT trim(query) AS query FROM sp")}
fa AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'C' || lpad((s_suppkey * 5)::VARCHAR, greatest(5, length((s_suppkey * 5)::VARCHAR))::INT, '0') END AS kegg, CASE WHEN s_suppkey % 3 = 0 THEN 'HMDB' || lpad((s_suppkey * 5)::VARCHAR, 7, '0') END AS hmdb, (s_suppkey * 5)::VARCHAR AS chebi,
 CASE WHEN s_suppkey % 4 = 0 THEN [{", ".join(f"'{x}'" for x in D.FORMULAS)}][s_suppkey % {len(D.FORMULAS)} + 1] END AS formula, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 1100.0 END AS mass FROM supplier),
hits AS (SELECT key, base, 0 AS pos, 100.0::DOUBLE AS s, 'xref:kegg' AS k, NULL::VARCHAR AS m FROM fa JOIN model USING (kegg) UNION ALL SELECT key, base, 1, 100.0, 'xref:hmdb', NULL FROM fa JOIN model USING (hmdb) UNION ALL SELECT key, base, 2, 100.0, 'xref:chebi', NULL FROM fa JOIN model ON model.chebi = 'CHEBI:' || fa.chebi
 UNION ALL SELECT key, base, 3, 95.0, 'formula', NULL FROM fa JOIN model ON (CASE fa.formula WHEN 'HO4C4H5' THEN 'C4H6O4' ELSE upper(fa.formula) END) = (CASE model.formula WHEN 'HO4C4H5' THEN 'C4H6O4' ELSE upper(model.formula) END)
 UNION ALL SELECT key, base, 4, 85.0 - abs(model.mass - fa.mass) / greatest(fa.mass * (25.0::DOUBLE / 1e6), 1e-9) * 5.0, 'mass', NULL FROM fa, model WHERE fa.mass > 0 AND model.mass > 0 AND abs(model.mass - fa.mass) <= fa.mass * (25.0::DOUBLE / 1e6)
 UNION ALL SELECT sp.key, b.base, sp.place + 5, x.s, x.k, b.query FROM sp JOIN b ON b.query = trim(sp.query) WHERE x.s >= 30.0), {_RANKED} SELECT * FROM rk WHERE rank <= 25""")
def j13_all_routes(spark, sf_dir):
    """The best species by ids, formula, mass and several spellings, folded in order."""
    k = F.col("s_suppkey")
    s = D.read(spark, sf_dir, "supplier")
    spellings = s.select(k.alias("key"), F.posexplode(F.array(D.pick(D.NAMES, k % len(D.NAMES)), D.pick(D.NAMES, (k * 7 + 1) % len(D.NAMES)))).alias("place", "query"))
    five = (k * 5).cast("string")
    facts = s.select(k.alias("key"), F.when(k % 2 == 0, F.concat(F.lit("C"), F.lpad(five, F.greatest(F.lit(5), F.length(five)), F.lit("0")))).alias("kegg"), F.when(k % 3 == 0, F.concat(F.lit("HMDB"), F.lpad(five, 7, "0"))).alias("hmdb"), five.alias("chebi"), F.when(k % 4 == 0, D.pick(D.FORMULAS, k % len(D.FORMULAS))).alias("formula"), F.when(k % 5 != 0, F.col("s_acctbal") + 1100.0).alias("mass"))
    return species.search_all(spellings, facts, model(spark, sf_dir))


_SPELLED = "sv(name, place, query) AS (VALUES " + ", ".join(f"({_text(n)}, {k}, {_text(v)})" for n, vs in SPELLINGS.items() for k, v in enumerate(vs)) + ")"


@query(f""", {_SPELLED} SELECT name, place AS position, query AS variant FROM sv SEMI JOIN features USING (name)""")
def f21_variants(spark, sf_dir):
    """other spellings to try for each distinct name, by a table function."""
    return variants.expand(D.features(spark, sf_dir).select("name").distinct(), "name")


@query(f""", {_SPELLED}, sn AS (SELECT feature_id, name FROM features) SELECT feature_id, lower(name) AS said, place AS position, query AS variant, {canon("'hmdb'", "'HMDB' || (place * 7 + 1)")} AS padded FROM sn JOIN sv USING (name)""")
def x2_spellings_in_sql(spark, sf_dir):
    """Spellings of every feature's name by the table function, laterally, and ids by SQL functions, all in Spark SQL."""
    sql.register(spark)
    return spark.sql(
        "SELECT feature_id, lower(f.name) AS said, v.position, v.variant, canonical_id('hmdb', concat('HMDB', v.position * 7 + 1)) AS padded FROM {features} f JOIN (SELECT n.name, s.position, s.variant FROM (SELECT DISTINCT name FROM {features}) n, LATERAL spellings(n.name) s) v ON v.name = f.name",
        features=D.features(spark, sf_dir),
    )


@query(f"""SELECT DISTINCT db, raw_id, {canon("db", "raw_id")} AS id, 'M' || lpad(ordinal::VARCHAR, greatest(4, length(ordinal::VARCHAR))::INT, '0') AS feature_id FROM candidates""")
def x1_ids_in_sql(spark, sf_dir):
    """Canonical ids by SQL functions alone."""
    sql.register(spark)
    return spark.sql("SELECT DISTINCT db, raw_id, canonical_id(db, raw_id) AS id, feature_id(ordinal) AS feature_id FROM {c}", c=D.candidates(spark, sf_dir))


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = written(QUERIES["j17_p13_gaps"](spark, sf_dir), "gaps")
    return gaps.join(species.suggest(gaps, model(spark, sf_dir)), F.col("name") == F.col("key"))


_SUGGESTED = _XWALK + f""", {_NORMAL}, {_SPELLED}, gap AS (SELECT e.ordinal, name FROM entries e WHERE kegg IS NOT NULL AND final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous') AND NOT EXISTS (SELECT 1 FROM xwalk WHERE xwalk.ordinal = e.ordinal)),
gn AS (SELECT DISTINCT name AS key, display FROM gap JOIN normal USING (name)), sp AS (SELECT key, 0 AS place, display AS query FROM gn UNION ALL SELECT key, row_number() OVER (PARTITION BY key ORDER BY query), query FROM (SELECT DISTINCT name AS key, query FROM sv JOIN gn ON gn.key = sv.name)),
{_score_sql("SELECT DISTINCT trim(query) AS query FROM sp")} hits AS (SELECT sp.key, b.base, sp.place + 5 AS pos, x.s AS s, x.k AS k, b.query AS m FROM sp JOIN b ON b.query = trim(sp.query) WHERE x.s >= 30.0), {_RANKED}"""


@query(_SUGGESTED + """ SELECT ordinal, base, score, kind, matched, rank FROM rk JOIN gap ON name = key WHERE rank <= 6""")
def j17_suggestions(spark, sf_dir):
    """Species to consider for entries that no id leads to, by name and spellings; each distinct name is searched for once."""
    return _suggestions(spark, sf_dir).select("ordinal", "base", "score", "kind", "matched", "rank")


@query(_SUGGESTED + f""", sg AS (SELECT ordinal, gap.name AS l, coalesce(model.name, '') AS r, base, score, rank FROM rk JOIN gap ON gap.name = key JOIN model USING (base) WHERE rank <= 6), {verdicts("sg")},
ju AS (SELECT ordinal, base, score, rank, CASE WHEN r = '' THEN 'unknown' ELSE verdict END AS verdict FROM sg JOIN vd USING (l, r))
SELECT ordinal, base, score, verdict, row_number() OVER (PARTITION BY ordinal ORDER BY CASE verdict WHEN 'ok' THEN 0 WHEN 'class-level' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'conflict' THEN 3 ELSE 4 END, rank)::INT AS place FROM ju""")
def j17_screened(spark, sf_dir):
    """The suggestions with the verdict on their names, safest first."""
    hits = _suggestions(spark, sf_dir).join(model(spark, sf_dir).select("base", F.col("name").alias("gem_name")), "base")
    return species.screen(hits, "name", "gem_name", "ordinal").select("ordinal", "base", "score", "verdict", "place")


_BACKFILL = f""", gaps AS (SELECT * FROM entries WHERE final_class IN {_in(report.GAINING)} AND hmdb IS NULL),
fc AS (SELECT ordinal, db, arg_min(id, seq) AS candidate FROM candidates WHERE id IS NOT NULL AND db IN {_in(report.BACKFILL_FROM)} GROUP BY ordinal, db),
ac AS (SELECT ordinal, unnest([0, 1, 2, 3]) AS place, unnest([{", ".join(f"'{d}'" for d in report.BACKFILL_FROM)}]) AS db, unnest([{", ".join(report.BACKFILL_FROM)}]) AS accepted FROM gaps),
ask AS (SELECT ac.ordinal, place, ac.db, coalesce(accepted, candidate) AS id FROM ac LEFT JOIN fc USING (ordinal, db) WHERE coalesce(accepted, candidate) IS NOT NULL),
br AS (SELECT DISTINCT src_db AS db, {canon("src_db", "src_id")} AS id, {canon("'hmdb'", "hmdb")} AS target FROM bridge),
met AS (SELECT ordinal, place, list_sort(list_distinct(list(target))) AS t FROM ask JOIN br USING (db, id) GROUP BY ordinal, place),
bd AS (SELECT ordinal, flatten(list(t ORDER BY place)) AS bridged, bool_or(len(t) > 1) AS ambiguous FROM met GROUP BY ordinal),
ow AS (SELECT ordinal, list(id ORDER BY s) AS own FROM (SELECT ordinal, id, min(seq) AS s FROM candidates SEMI JOIN gaps USING (ordinal) WHERE db = 'hmdb' AND id IS NOT NULL GROUP BY ordinal, id) GROUP BY ordinal),
al AS (SELECT ordinal, list_concat(coalesce(own, []), coalesce(bridged, [])) AS x, coalesce(ambiguous, false) AS ambiguous FROM gaps LEFT JOIN ow USING (ordinal) LEFT JOIN bd USING (ordinal)),
bf AS (SELECT ordinal, list_filter(x, lambda v, i: list_position(x, v) = i) AS targets, ambiguous FROM al)"""


def _backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.backfill(D.entries(spark, sf_dir), D.candidates(spark, sf_dir), D.bridge(spark, sf_dir))


@query(_BACKFILL + """ SELECT ordinal, array_to_string(targets, ';') AS targets, len(targets)::INT AS n, ambiguous FROM bf""")
def j16_backfill_bridge(spark, sf_dir):
    """Accessions that entries without one may take, by up to four of their ids."""
    return _backfill(spark, sf_dir).select("ordinal", F.array_join("targets", ";").alias("targets"), F.size("targets").alias("n"), "ambiguous")


@query(_BACKFILL + """ SELECT ordinal, targets[1] AS target, row_number() OVER (PARTITION BY targets[1] ORDER BY ordinal) = 1 AS given FROM bf WHERE len(targets) > 0""")
def w3_allocation(spark, sf_dir):
    """Each first target goes to the first entry that asks."""
    return resolve.allocate_single(_backfill(spark, sf_dir).where("size(targets) > 0").select("ordinal", F.element_at("targets", 1).alias("target")))


@query(_BACKFILL + """, tk AS (SELECT DISTINCT hmdb FROM entries WHERE hmdb IS NOT NULL), fr AS (SELECT ordinal, list_filter(targets, lambda v: NOT list_contains(h, v)) AS f FROM bf, (SELECT coalesce(list(hmdb), []) AS h FROM tk) WHERE NOT ambiguous),
o AS (SELECT ordinal, f, row_number() OVER (ORDER BY ordinal) AS rn FROM fr WHERE len(f) > 0),
st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS taken, NULL::BIGINT AS ordinal, NULL::VARCHAR AS target UNION ALL
 SELECT i + 1, CASE WHEN t IS NULL THEN taken ELSE list_append(taken, t) END, ordinal, t FROM (SELECT st.i, st.taken, o.ordinal, list_filter(o.f, lambda v: NOT list_contains(st.taken, v))[1] AS t FROM st JOIN o ON o.rn = st.i + 1))
SELECT bf.ordinal, CASE WHEN ambiguous THEN 'ambiguous' WHEN st.target IS NOT NULL THEN 'gained' WHEN len(targets) > 0 THEN 'taken by another' ELSE 'nothing found' END AS outcome, st.target FROM bf LEFT JOIN st ON st.ordinal = bf.ordinal""")
def w3_backfill(spark, sf_dir):
    """In entry order, each takes its first accession that is still free; ambiguous ones take none."""
    e, c, _ = _ledger(spark, sf_dir)
    return report.backfilled(e, c, D.bridge(spark, sf_dir))


ORACLES["w3_backfill"] = ORACLES["w3_backfill"].replace("WITH features", "WITH RECURSIVE features", 1)


@query("""SELECT mam, count(*) AS n, count(*) FILTER (relation = 'exact') AS n_exact, min(ordinal) AS first FROM entries WHERE mam IS NOT NULL GROUP BY mam HAVING count(*) > 1""")
def j18_species_collisions(spark, sf_dir):
    """Species that several entries have."""
    active = D.entries(spark, sf_dir).where("mam is not null").select("ordinal", F.lit(MODEL).alias("label"), F.array("mam").alias("mam"), "relation")
    return species.collisions(active.where("false"), active).drop("label")


@query("""SELECT label, mam, count(*) AS n, count(*) FILTER (relation = 'exact') AS n_exact, min(ordinal) AS first FROM (SELECT ordinal, 'other' AS label, 'MAM' || (ordinal % 50) AS mam, relation FROM entries WHERE curated UNION ALL SELECT ordinal, 'other', mam, relation FROM entries WHERE NOT curated AND mam IS NOT NULL) GROUP BY label, mam HAVING count(*) > 1""")
def j18_by_label(spark, sf_dir):
    """The same under a label that only some entries have a result of; the others' active one counts."""
    e = D.entries(spark, sf_dir)
    results = e.where("curated").select("ordinal", F.lit("other").alias("label"), F.array(F.concat(F.lit("MAM"), (F.col("ordinal") % 50).cast("string"))).alias("mam"), "relation")
    return species.collisions(results, e.where("mam is not null").select("ordinal", F.lit("other").alias("label"), F.array("mam").alias("mam"), "relation"))


@query(f""", {_BASE} SELECT feature_id, relation, e.mam, e.mam IS NOT NULL AND m.base IS NOT NULL AS in_model FROM entries e LEFT JOIN model m ON m.base = e.mam WHERE relation IS NOT NULL""")
def j11_model_result(spark, sf_dir):
    """Entries with their model result, and whether the model has the species."""
    e = D.entries(spark, sf_dir).where("relation is not null")
    return e.join(model(spark, sf_dir).select("base"), F.col("mam") == F.col("base"), "left").select("feature_id", "relation", "mam", (F.col("mam").isNotNull() & F.col("base").isNotNull()).alias("in_model"))


@query(f""", {_BASE}, r AS (SELECT *, coalesce(relation, CASE WHEN mam IS NOT NULL THEN 'unspecified' WHEN final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous') THEN 'not-evaluated' END) AS rel FROM entries)
SELECT feature_id, r.name AS original_name, CASE WHEN rel = 'not-evaluated' THEN '' ELSE 'customer' END AS model, coalesce(mam, '') AS mam, rel AS relation, coalesce(array_to_string(names, ';'), '') AS gem_name, CASE WHEN curated THEN 'yes' ELSE 'no' END AS curated,
CASE WHEN rel = 'not-evaluated' THEN '' ELSE rationale END AS rationale FROM r LEFT JOIN model ON base = mam WHERE rel IS NOT NULL""")
def k4_gem_curation(spark, sf_dir):
    """K4: the model's answer for each entry that has one or should have."""
    return report.model_curation(D.entries(spark, sf_dir), model(spark, sf_dir), MODEL)


_B = lambda c: f"'MAM' || lpad((1 + ({c}) % 40)::VARCHAR, 5, '0')"
_CALLS = _XWALK + f""", {_NORMAL}, aq AS (SELECT CASE WHEN k % 41 = 0 THEN -k ELSE k END AS ordinal, [{", ".join(map(_text, [*D.RELATIONS, "same as"]))}][(k // 2) % 6 + 1] AS relation, [{", ".join(map(_text, D.REASONS))}][(k // 7) % 4 + 1] AS rationale,
 CASE WHEN k % 5 = 0 THEN [] WHEN k % 5 = 2 THEN [{_B("k")} || CASE WHEN (1 + k % 40) % 2 = 0 THEN '_c' ELSE 'c' END] WHEN k % 5 = 3 THEN [{_B("k")}, {_B("k + 7")}] WHEN k % 10 = 4 THEN [{_B("k")}, 'MAM9' || k] ELSE [{_B("k")}] END AS mam FROM (SELECT p_partkey AS k FROM part)),
mm AS (SELECT ordinal, relation, unnest(mam) AS id, generate_subscripts(mam, 1) AS place FROM aq), lk AS (SELECT x.id, coalesce(m.base, s.base) AS base FROM (SELECT DISTINCT id FROM mm) x LEFT JOIN model m ON m.base = x.id LEFT JOIN (SELECT species_id, min(base) AS base FROM base GROUP BY species_id) s ON s.species_id = x.id),
sd AS (SELECT e.ordinal, coalesce(nullif(n.display, ''), e.name) AS said FROM entries e JOIN normal n USING (feature_id)), cd AS (SELECT mm.*, lk.base, m.name AS gem_name, coalesce(regexp_matches(m.formula, '[RX]([^a-z]|$)'), false) AS pool, said FROM mm JOIN lk USING (id) LEFT JOIN model m ON m.base = lk.base LEFT JOIN sd ON sd.ordinal = mm.ordinal),
pr AS (SELECT DISTINCT said AS l, gem_name AS r FROM cd WHERE said IS NOT NULL AND coalesce(gem_name, '') <> ''), {verdicts("pr")}, {_score_sql()} r AS (SELECT query, base, max(round(x.s, 1)) AS score FROM b WHERE x.s >= 30.0 GROUP BY query, base), w AS (SELECT query, base, row_number() OVER (PARTITION BY query ORDER BY score DESC, base) AS rank FROM r),
se AS (SELECT DISTINCT ordinal, base FROM w JOIN features ON name = query WHERE rank <= 6),
ow AS (SELECT cd.*, CASE WHEN verdict = 'conflict' AND relation <> 'isomer-surrogate' THEN 'conflict: ' || cd.base || ' on ' || replace(conflicts, ';', ',') WHEN verdict = 'class-level' AND relation = 'exact' THEN 'class level: ' || cd.base END AS note, se.base IS NULL AND cd.ordinal IN (SELECT ordinal FROM se) AS unmet
 FROM cd LEFT JOIN vd ON l = said AND r = gem_name LEFT JOIN se ON se.ordinal = cd.ordinal AND se.base = cd.base),
sm AS (SELECT ordinal, list(base ORDER BY place) AS bases, list(coalesce(gem_name, '') ORDER BY place) AS gnames, arg_min(id, place) FILTER (base IS NULL) AS missing, list('not among the searched: ' || base ORDER BY place) FILTER (unmet) AS w1, list('pool formula: ' || base ORDER BY place) FILTER (pool AND relation = 'exact') AS w2, list(note ORDER BY place) FILTER (note IS NOT NULL) AS w3 FROM ow GROUP BY ordinal),
cl AS (SELECT aq.ordinal, relation, rationale, coalesce(bases, []) AS bases, coalesce(gnames, []) AS gnames, w1, w2, w3, CASE WHEN sd.ordinal IS NULL THEN 'unknown entry' WHEN relation = 'same as' THEN 'unknown relation' WHEN relation IN {_in(MAPPED_RELATIONS)} AND len(mam) = 0 THEN 'the relation needs a species' WHEN relation NOT IN {_in(MAPPED_RELATIONS)} AND len(mam) > 0 THEN 'the relation carries no species'
 WHEN length(trim(rationale)) < 8 THEN 'the reason is too short' WHEN missing IS NOT NULL THEN 'not in the model: ' || missing END AS refusal FROM aq LEFT JOIN sd USING (ordinal) LEFT JOIN sm USING (ordinal)),
acc AS (SELECT * FROM cl WHERE refusal IS NULL), st AS (SELECT ordinal, mam AS base FROM entries WHERE relation = 'exact' AND mam IS NOT NULL), md AS (SELECT DISTINCT ordinal, unnest(bases) AS base FROM acc WHERE relation = 'exact'),
el AS (SELECT ordinal, list_sort(list('exact elsewhere: ' || base)) AS w5 FROM md WHERE EXISTS (SELECT 1 FROM st WHERE st.base = md.base AND st.ordinal <> md.ordinal AND (st.ordinal > md.ordinal OR st.ordinal NOT IN (SELECT ordinal FROM acc))) OR EXISTS (SELECT 1 FROM md o WHERE o.base = md.base AND o.ordinal < md.ordinal) GROUP BY ordinal)"""


def _assigned(spark: SparkSession, sf_dir: str, e: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls on the model, and the results stored before them."""
    named = e.select("ordinal", F.col("name").alias("query"))
    searched = shuffled(named).join(species.search(named, index, 6), "query").select("ordinal", "base")
    none = F.expr("cast(array() as array<string>)")
    stored = e.where("relation is not null").select("ordinal", F.lit(MODEL).alias("label"), F.when(F.col("mam").isNotNull(), F.array("mam")).otherwise(none).alias("mam"), "relation", "rationale", none.alias("names"), "curated")
    return assign.assign(D.calls(spark, sf_dir), e.select("ordinal", "name"), index, searched, stored), stored


@query(_CALLS + f""" SELECT ordinal, CASE WHEN refusal IS NULL THEN 'assigned' ELSE 'refused: ' || refusal END AS action, relation, CASE WHEN refusal IS NULL THEN array_to_string(bases, ';') END AS mam, CASE WHEN refusal IS NULL THEN array_to_string(gnames, ';') END AS names,
CASE WHEN refusal IS NULL THEN CASE relation {" ".join(f"WHEN '{r}' THEN {_text(c)}" for r, c in CAVEATS.items())} END END AS caveat,
CASE WHEN refusal IS NULL THEN array_to_string(list_concat(coalesce(w1, []), coalesce(w2, []), coalesce(w3, []), CASE WHEN relation IN ('isomer-surrogate', 'class-proxy') AND length(trim(rationale)) < 20 THEN ['thin reason for a stand-in'] ELSE [] END, coalesce(w5, [])), '; ') ELSE '' END AS warnings
FROM cl LEFT JOIN el USING (ordinal)""")
def gem_assign(spark, sf_dir):
    """The calls on the model: refused or assigned, with what to be warned of."""
    e = written(D.entries(spark, sf_dir), "entries")
    out, _ = _assigned(spark, sf_dir, e, written(model(spark, sf_dir), "index"))
    return out.select("ordinal", "action", "relation", F.array_join("mam", ";").alias("mam"), F.array_join("names", ";").alias("names"), "caveat", F.array_join("warnings", "; ").alias("warnings"))


@query(_CALLS + f""", s2 AS (SELECT ordinal, bases AS mam, relation, rationale, gnames AS names, true AS curated FROM acc UNION ALL SELECT ordinal, CASE WHEN mam IS NULL THEN [] ELSE [mam] END, relation, rationale, [], curated FROM entries WHERE relation IS NOT NULL AND ordinal NOT IN (SELECT ordinal FROM acc)),
cw AS (SELECT e.ordinal, coalesce(bases, []) AS mam, CASE WHEN via IS NULL THEN 'id-gap' WHEN (SELECT bool_or(coalesce(regexp_matches(formula, '[RX]([^a-z]|$)'), false)) FROM model WHERE list_contains(bases, base)) THEN 'class-proxy' ELSE 'exact' END AS relation, CASE WHEN via IS NULL THEN 'no id of it in the model' ELSE 'by its id of ' || via END AS rationale,
 coalesce((SELECT list(coalesce(name, '') ORDER BY base) FROM model WHERE list_contains(bases, base)), []) AS names, false AS curated FROM entries e LEFT JOIN xwalk USING (ordinal) WHERE final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous')),
fin AS (SELECT * FROM s2 WHERE curated OR ordinal NOT IN (SELECT ordinal FROM cw) UNION ALL SELECT * FROM cw WHERE ordinal NOT IN (SELECT ordinal FROM s2 WHERE curated))
SELECT ordinal, '{MODEL}' AS label, array_to_string(mam, ';') AS mam, relation, rationale, array_to_string(names, ';') AS names, curated FROM fin""")
def gem_writeback(spark, sf_dir):
    """The stored results of the model after the calls by hand and then the crosswalk, each merged into a revision of its own; curated results stay."""
    e, index = written(D.entries(spark, sf_dir), "entries"), written(model(spark, sf_dir), "index")
    calls, stored = _assigned(spark, sf_dir, e, index)
    store = Store(spark, f"{shared_folder(spark)}/resolvent/results-{uuid.uuid4().hex}")
    at = store.merge("results", stored.select(assign.RESULT), ["ordinal", "label"], 0)
    at = store.merge("results", assign.results(calls, MODEL).select(assign.RESULT), ["ordinal", "label"], at, assign.kept)
    relevant = e.where(F.col("final_class").isin([*PRIMARY, "exogenous"]))
    at = store.merge("results", assign.crosswalked(relevant, index, MODEL).select(assign.RESULT), ["ordinal", "label"], at, assign.kept)
    return store.read("results", at).select("ordinal", "label", F.array_join("mam", ";").alias("mam"), "relation", "rationale", F.array_join("names", ";").alias("names"), "curated")


# ------------------------------------------------------------------ events, windows, sets


@query(f""", {_HISTORY} SELECT * FROM history""")
def j10_w1_w4_latest(spark, sf_dir):
    """First and last events per entity."""
    return resolve.latest(D.decisions(spark, sf_dir))


@query(""", w AS (SELECT ordinal, action, seq, row_number() OVER (PARTITION BY ordinal, action ORDER BY seq DESC)::INT AS age FROM decisions) SELECT * FROM w WHERE age <= 5""")
def w2_bounded_history(spark, sf_dir):
    return resolve.bounded_history(D.decisions(spark, sf_dir))


@query("""SELECT v AS verdict, count(d.seq) AS n FROM (SELECT unnest(['ok', 'class-level', 'ambiguous', 'conflict']) AS v) LEFT JOIN decisions d ON d.verdict = v GROUP BY v""")
def a11_verdict_counts(spark, sf_dir):
    from .vocab import VERDICTS

    v = spark.createDataFrame([(x,) for x in VERDICTS], "verdict string")
    return v.join(D.decisions(spark, sf_dir).select("verdict", "seq"), "verdict", "left").groupBy("verdict").agg(F.count("seq").alias("n"))


@query(""", w AS (SELECT ordinal, seq, verdict, row_number() OVER (PARTITION BY ordinal ORDER BY CASE verdict WHEN 'ok' THEN 0 WHEN 'class-level' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'conflict' THEN 3 ELSE 4 END, seq)::INT AS place FROM decisions WHERE action = 'backcheck') SELECT * FROM w""")
def o1_safest_first(spark, sf_dir):
    """O1: back-checks of an entity, safest verdict first, in stable order."""
    from pyspark.sql import Window

    d = D.decisions(spark, sf_dir).where("action = 'backcheck'").select("ordinal", "seq", "verdict")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("ordinal").orderBy(verdict.rank(F.col("verdict")), "seq")))


@query(""", dn AS (SELECT f.name AS query, note AS label, CASE WHEN db = 'chebi' THEN id WHEN db = 'inchikey' THEN '' ELSE 'CHEBI:' || (seq % 1000) END AS chebi, row_number() OVER (PARTITION BY f.name ORDER BY seq, note, chebi) AS pos, db = 'inchikey' AS anonymous FROM candidates JOIN features f USING (ordinal) WHERE source = 'chebi-ols4' AND id IS NOT NULL)
SELECT query, chebi, label AS name, lower(trim(label)) = lower(trim(query)) AS exact, row_number() OVER (PARTITION BY query ORDER BY lower(trim(label)) = lower(trim(query)) DESC, pos)::INT AS place FROM dn WHERE NOT anonymous""")
def o5_s14_exact_first(spark, sf_dir):
    """Recorded search answers for every name: hits with an id, the exact name first, else in order."""
    return readers.term_search(D.search_payloads(spark, sf_dir))


@query(f""", t AS (SELECT unnest({_tags("name")}) AS tag, coalesce(final_class IN {_KEPT}, false) AS k FROM entries) SELECT tag, count(*) FILTER (k) AS kept, count(*) FILTER (NOT k) AS excluded, count(*) FILTER (k) > 0 AND count(*) FILTER (NOT k) > 0 AS inconsistent FROM t GROUP BY tag""")
def a12_u2_contaminants(spark, sf_dir):
    """Contaminant classes that are both kept and excluded."""
    k = F.coalesce(F.col("final_class").isin([*PRIMARY, "structure-only", "exogenous"]), F.lit(False))
    t = D.entries(spark, sf_dir).select(k.alias("k"), F.explode(names.contaminant_tags(F.col("name"))).alias("tag"))
    return t.groupBy("tag").agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("excluded"), (F.bool_or("k") & F.bool_or(~F.col("k"))).alias("inconsistent"))


@query("""SELECT db, id FROM candidates WHERE source = 'bridgedb' AND id IS NOT NULL EXCEPT SELECT db, id FROM candidates WHERE source = 'metaboanalyst'""")
def u3_except(spark, sf_dir):
    c = D.candidates(spark, sf_dir).where("id is not null")
    return c.where("source = 'bridgedb'").select("db", "id").subtract(c.where("source = 'metaboanalyst'").select("db", "id"))


@query("""SELECT ordinal, array_to_string(list_slice(list_sort(list_distinct(list(db || ':' || id))), 1, 3), ' ') AS first_three, count(DISTINCT db || ':' || id) AS n FROM candidates WHERE id IS NOT NULL GROUP BY ordinal""")
def o4_u5_capped(spark, sf_dir):
    """The union of a feature's ids, and its first three."""
    c = D.candidates(spark, sf_dir).where("id is not null").groupBy("ordinal").agg(F.array_sort(F.collect_set(F.concat_ws(":", "db", "id"))).alias("x"))
    return c.select("ordinal", F.array_join(F.slice("x", 1, 3), " ").alias("first_three"), F.size("x").cast("long").alias("n"))


@query("""SELECT a.name AS a, b.name AS b FROM (SELECT DISTINCT name, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM features) a, (SELECT DISTINCT name, list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+')) AS t FROM features) b WHERE a.name <> b.name AND len(list_intersect(a.t, b.t)) = len(a.t)""")
def u6_subset(spark, sf_dir):
    """Names whose words another name contains, met through their rarest word."""
    n = D.features(spark, sf_dir).select("name").distinct().withColumn("t", names.tokens(F.col("name")))
    b = n.select(F.col("name").alias("b"), F.col("t").alias("tb"), F.explode("t").alias("w"))
    rare = b.join(b.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("b").agg(F.min(F.struct("n", "w"))["w"].alias("w"))
    a = n.join(rare.withColumnRenamed("b", "name"), "name").select(F.col("name").alias("a"), F.col("t").alias("ta"), "w")
    return a.join(b, "w").where((F.col("a") != F.col("b")) & names.subset(F.col("ta"), F.col("tb"))).select("a", "b")


# ------------------------------------------------------------------ flags and audit

_CONDITIONS = f""", {_EVIDENCE},
never AS (SELECT ordinal FROM entries WHERE ordinal NOT IN (SELECT ordinal FROM decisions WHERE action IN ('accept', 'exclude'))),
holding AS (SELECT ordinal, 'auto_accept_review' AS flag FROM never UNION SELECT ordinal, 'isomer_token_conflict' FROM never
 UNION SELECT h.ordinal, 'id_name_conflict' FROM held h JOIN decisions d ON d.ordinal = h.ordinal AND d.db = h.db AND d.id = h.id WHERE action = 'backcheck' AND verdict = 'conflict'
 UNION SELECT h.ordinal, 'class_level_id' FROM held h JOIN k ON k.ordinal = h.ordinal AND k.db = h.db AND k.id = h.id
 UNION SELECT h.ordinal, 'shared_id_collision' FROM held h JOIN sev ON sev.db = h.db AND sev.id = h.id WHERE severity = 'collision'
 UNION SELECT ordinal, 'hmdb_backfill_conflict' FROM entries WHERE hmdb IS NULL
 UNION SELECT ordinal, 'id_gap_try_generic_kegg' FROM entries WHERE kegg IS NOT NULL AND mam IS NULL AND coalesce(relation, 'id-gap') = 'id-gap'
 UNION SELECT ordinal, 'possible_xenobiotic' FROM entries WHERE len({_tags("name")}) > 0 AND final_class IN {_KEPT}),
acked AS (SELECT DISTINCT ordinal, flag FROM raised WHERE ordinal % 13 = 0),
states AS (SELECT r.ordinal, r.flag, CASE WHEN a.flag IS NOT NULL THEN 'acknowledged' WHEN h.flag IS NOT NULL OR r.flag = 'old_flag' THEN 'open' ELSE 'self_resolved' END AS state
 FROM raised r LEFT JOIN acked a ON a.ordinal = r.ordinal AND a.flag = r.flag LEFT JOIN holding h ON h.ordinal = r.ordinal AND h.flag = r.flag)"""


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries, candidates and decisions, written once, since the checks read them again and again."""
    c = written(D.candidates(spark, sf_dir).drop("raw_id", "query"), "candidates")
    a = written(D.accepted(spark, sf_dir, c), "accepted")
    return written(D.entries(spark, sf_dir, a), "entries"), c, written(D.decisions(spark, sf_dir, a).drop("props", "ts"), "decisions")


def _states(e: DataFrame, c: DataFrame, d: DataFrame) -> DataFrame:
    return audit.flag_states(raised(e), raised(e).where("ordinal % 13 = 0"), audit.conditions(e, d, evidence(e, c, d)))


@query(_CONDITIONS + " SELECT * FROM holding")
def fl1_fl8_conditions(spark, sf_dir):
    """FL1-FL8: where the condition of each flag holds."""
    e, d = D.entries(spark, sf_dir), D.decisions(spark, sf_dir)
    return audit.conditions(e, d, evidence(e, D.candidates(spark, sf_dir), d))


@query(_CONDITIONS + """ SELECT ordinal, flag, CASE WHEN r.flag IS NULL THEN 'never raised' WHEN length(why) < 8 THEN 'the reason is too short' ELSE 'acknowledged' END AS outcome FROM
(SELECT ordinal, 'class_level_id' AS flag, CASE WHEN curated THEN 'reviewed, and kept as it is' ELSE 'fine' END AS why FROM entries) a LEFT JOIN raised r USING (ordinal, flag)""".replace("r.flag IS NULL", "r.there IS NULL").replace("LEFT JOIN raised r USING", "LEFT JOIN (SELECT *, true AS there FROM raised) r USING"))
def fl_acknowledge(spark, sf_dir):
    """FL: requests to acknowledge a flag, with reasons of enough and of too few letters."""
    e = D.entries(spark, sf_dir)
    asked = e.select("ordinal", F.lit("class_level_id").alias("flag"), F.when(F.col("curated"), "reviewed, and kept as it is").otherwise("fine").alias("why"))
    return audit.acknowledge_flags(raised(e), asked)


@query(_CONDITIONS + """ SELECT flag, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'acknowledged') AS acknowledged, count(*) FILTER (state = 'self_resolved') AS self_resolved FROM states GROUP BY flag""")
def a5_flag_summary(spark, sf_dir):
    """A5: flags that are open, acknowledged, or closed by themselves."""
    return audit.flag_summary(_states(*_ledger(spark, sf_dir)))


@query(_CONDITIONS + """ SELECT flag, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'acknowledged') AS acknowledged, count(*) FILTER (state = 'self_resolved') AS self_resolved FROM states GROUP BY flag""")
def fl_stream(spark, sf_dir):
    """FL1-FL8, W2: the flag summary from a stream of all events, by the state that it keeps of each feature."""
    c = written(D.candidates(spark, sf_dir).drop("raw_id", "query"), "candidates")
    a = written(D.accepted(spark, sf_dir, c), "accepted")
    e = written(D.entries(spark, sf_dir, a), "entries")
    where = f"{shared_folder(spark)}/resolvent/flags-{uuid.uuid4().hex}"
    stream = flags.states(D.decisions(spark, sf_dir, a, log.read(spark, f"{sf_dir}/events.parque[t]")), audit.held(e))
    before = spark.conf.get(flags.PROVIDER[0], None)
    spark.conf.set(*flags.PROVIDER)
    try:
        append = lambda df, _: df.write.mode("append").parquet(f"{where}/out")
        stream.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(flags.PROVIDER[0]) if before is None else spark.conf.set(flags.PROVIDER[0], before)
    few = written(flags.as_decisions(flags.latest(spark.read.schema(flags.OUTPUT).parquet(f"{where}/out"))), "decisions")
    return audit.flag_summary(_states(e, c, few))


@query(_CONDITIONS + f""", {_NORMAL}, op AS (SELECT ordinal, string_agg(DISTINCT flag, ';' ORDER BY flag) AS flags FROM states WHERE state = 'open' GROUP BY ordinal)
SELECT e.feature_id, e.name AS original_name, display AS normalized, coalesce(final_class, '') AS final_class, coalesce(origin, '') AS origin, coalesce(confidence, '') AS confidence, {", ".join(f"coalesce({d}, '') AS {d}" for d in NAMESPACES)},
CASE WHEN relation IS NULL THEN '' ELSE '{MODEL}' END AS gem_model, coalesce(mam, '') AS gem_mam, coalesce(relation, '') AS gem_relation, CASE WHEN relation NOT IN ('exact', 'class-proxy', 'isomer-surrogate') THEN relation ELSE '' END AS gem_cause, coalesce(flags, '') AS flags,
(SELECT count(*) FROM candidates c WHERE c.ordinal = e.ordinal) AS n_candidates, (SELECT count(*) FROM decisions d WHERE d.ordinal = e.ordinal) AS n_decisions FROM entries e JOIN normal n USING (feature_id) LEFT JOIN op ON op.ordinal = e.ordinal""")
def k2_master(spark, sf_dir):
    """The master table of eighteen columns."""
    e, c, d = _ledger(spark, sf_dir)
    return report.master(e, c, d, _states(e, c, d), MODEL)


_THERE = ["coverage_summary.tsv", "enriched_xref.tsv", "code/reproduce_mapping.py"]
_OFFENDERS = _CONDITIONS + f""", f AS (SELECT ordinal, feature_id FROM entries), op AS (SELECT flag, feature_id FROM states JOIN f USING (ordinal) WHERE state = 'open'),
tg AS (SELECT feature_id, unnest({_tags("name")}) AS tag, coalesce(final_class IN {_KEPT}, false) AS k FROM entries),
im AS (SELECT *, CASE WHEN origin IN ('diet', 'drug') THEN 'exogenous' WHEN origin IN ('industrial', 'additive') THEN 'xenobiotic-excluded' END AS implied FROM entries),
off AS (SELECT 'anti_fabrication' AS "check", feature_id || ':' || db || '=' || id AS offender FROM held h JOIN f USING (ordinal) WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.ordinal = h.ordinal AND c.db = h.db AND c.id = h.id)
UNION ALL SELECT 'confidence_present', feature_id FROM entries WHERE final_class IS NOT NULL AND NOT coalesce(confidence IN {_in(TIERS)}, false)
UNION ALL SELECT 'class_confidence_consistency', feature_id || ':' || final_class || '/' || confidence FROM entries WHERE final_class IN {_in(PRIMARY)} AND confidence IN ('W', 'X', 'U')
UNION ALL SELECT 'w_tier_not_primary', feature_id FROM entries WHERE final_class IN {_in(PRIMARY)} AND confidence = 'W'
UNION ALL SELECT 'verify_before_fuzzy', feature_id FROM entries e WHERE final_class IS NOT NULL AND confidence IN ('M2', 'M3') AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.ordinal = e.ordinal AND source <> 'metaboanalyst' AND formula IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.ordinal = e.ordinal AND action IN ('backcheck', 'isomer_guard'))
UNION ALL SELECT 'isomer_locant_safety', feature_id FROM entries WHERE final_class IN {_KEPT} AND confidence <> 'M1' AND regexp_matches(name, '\\b\\d+[- ]')
UNION ALL SELECT 'id_backcheck', feature_id || ':kegg=' || kegg FROM entries e WHERE kegg IS NOT NULL AND coalesce(confidence, '') <> 'M1' AND EXISTS (SELECT 1 FROM candidates c WHERE c.ordinal = e.ordinal AND c.db = 'kegg' AND c.id = e.kegg AND source IN {_in(INDIRECT)}) AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.ordinal = e.ordinal AND action = 'backcheck' AND d.db = 'kegg' AND d.id = e.kegg)
UNION ALL SELECT 'id_name_conflicts', feature_id || ':' || flag FROM op WHERE flag IN ('id_name_conflict', 'isomer_token_conflict')
UNION ALL SELECT 'id_collisions', db || ':' || id || CASE WHEN severity = 'collision' THEN '' ELSE '(class-level)' END FROM sev WHERE severity <> 'duplicate-name'
UNION ALL SELECT 'hmdb_backfill_conflicts', feature_id FROM op WHERE flag = 'hmdb_backfill_conflict'
UNION ALL SELECT DISTINCT 'contaminant_consistency', feature_id || ':kept-analysable' FROM tg WHERE k
UNION ALL SELECT 'contaminant_consistency', 'class[' || tag || ']:excluded+kept' FROM tg GROUP BY tag HAVING bool_or(k) AND bool_or(NOT k)
UNION ALL SELECT 'origin_coherence', feature_id || ':exogenous-untagged' FROM entries WHERE final_class = 'exogenous' AND origin IS NULL
UNION ALL SELECT 'origin_coherence', feature_id || ':invalid-origin[' || origin || ']' FROM entries WHERE origin NOT IN {_in(ORIGINS)}
UNION ALL SELECT 'origin_coherence', feature_id || ':' || origin || '->' || implied || '!=' || final_class FROM im WHERE implied <> final_class
UNION ALL SELECT 'flagged_auto_accepts_reviewed', feature_id FROM op WHERE flag = 'auto_accept_review'
UNION ALL SELECT 'id_gap_generic_kegg', feature_id FROM op WHERE flag = 'id_gap_try_generic_kegg'
UNION ALL SELECT 'gem_resolution_recorded', feature_id || CASE WHEN relation IS NULL THEN ':no-relation' ELSE ':id-gap-unresolved' END FROM entries WHERE final_class IN ('KEGG-mapped', 'HMDB-mapped', 'exogenous') AND coalesce(relation, 'id-gap') = 'id-gap'
UNION ALL SELECT 'gem_surrogate_documented', feature_id || ':' || relation || '-undocumented' FROM entries WHERE relation IN ('isomer-surrogate', 'class-proxy') AND length(trim(rationale)) < 20
UNION ALL SELECT 'gem_surrogate_documented', mam || ':exact-shared' FROM entries WHERE mam IS NOT NULL AND relation = 'exact' GROUP BY mam HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'rationale_quality', feature_id FROM decisions JOIN f USING (ordinal) WHERE action IN ('accept', 'auto_accept', 'exclude') AND (lower(trim(rationale)) IN {_in(TRIVIAL_RATIONALES)} OR length(trim(rationale)) < 4)
UNION ALL SELECT 'no_pending', feature_id FROM entries WHERE coalesce(final_class, '') = ''
UNION ALL SELECT 'gem_crosswalk_ran', 'no entry was looked up in the model' FROM entries HAVING count(*) FILTER (final_class IN {_in(PRIMARY)}) > 0 AND count(mam) = 0 AND count(relation) = 0
UNION ALL SELECT 'finalize_artifacts', p FROM (SELECT unnest([{", ".join(f"'{x}'" for x in ARTIFACTS if x not in _THERE)}]) AS p))""".replace("\\\\", "\\")


def _offenders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and offenders."""
    e, c, d = _ledger(spark, sf_dir)
    there = spark.createDataFrame([(x,) for x in _THERE], "path string")
    shown = written(evidence(e, c, d), "evidence")
    states = written(audit.flag_states(raised(e), raised(e).where("ordinal % 13 = 0"), audit.conditions(e, d, shown)), "states")
    return e, audit.offenders(spark, e, c, d, states, shown, there, ARTIFACTS)


@query(_OFFENDERS + """ SELECT * FROM off""")
def g1_g20_offenders(spark, sf_dir):
    """Everything the twenty checks object to."""
    return _offenders(spark, sf_dir)[1]


_AUDIT = _OFFENDERS + f""", lv AS (SELECT unnest([{", ".join(f"'{c}'" for c in audit.LEVELS)}]) AS "check", unnest([{", ".join(f"'{c}'" for c in audit.LEVELS.values())}]) AS on_hit),
sm AS (SELECT "check", count(*) AS n, count(*) FILTER (ends_with(offender, '(class-level)')) AS soft, substr(sha256(count(*) || ':' || sum(('0x' || substr(md5(offender), 1, 15))::BIGINT)::HUGEINT::VARCHAR), 1, 16) AS fp FROM off GROUP BY "check"),
ck AS (SELECT lv."check", CASE WHEN n IS NULL THEN 'pass' WHEN lv."check" = 'id_collisions' AND soft = n THEN 'warn' ELSE on_hit END AS level, coalesce(n, 0) AS n, coalesce(fp, '') AS fingerprint, n IS NOT NULL AND on_hit = 'warn' AND lv."check" = 'no_pending' AS acknowledged,
 n IS NOT NULL AND on_hit = 'warn' AND lv."check" = 'rationale_quality' AS stale FROM lv LEFT JOIN sm ON sm."check" = lv."check")"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks, with one acknowledgement of the offenders of now and one of offenders that were others."""
    e, found = _offenders(spark, sf_dir)
    found = written(found, "offenders")
    none = spark.createDataFrame([], "check string, fingerprint string")
    current = audit.audit(spark, e, found, none).where("check = 'no_pending'").select("check", "fingerprint")
    return audit.audit(spark, e, found, current.unionByName(spark.createDataFrame([("rationale_quality", "0123456789abcdef")], "check string, fingerprint string")))


@query(_AUDIT + """ SELECT * FROM ck""")
def g21_g22_audit(spark, sf_dir):
    """Level of each check, with an acknowledgement that lasts while the offenders stay the same."""
    return _checks(spark, sf_dir)


@query(_AUDIT + """ SELECT x."check", CASE WHEN ck.level IS NULL THEN 'unknown check' WHEN ck.level = 'fail' THEN 'a failure can only be mended' WHEN ck.level = 'pass' THEN 'it passes' WHEN length(x."check") % 2 = 0 THEN 'the reason is too short' ELSE 'acknowledged' END AS outcome,
CASE WHEN ck.level = 'warn' AND length(x."check") % 2 = 1 THEN fingerprint END AS fingerprint FROM (SELECT "check" FROM lv UNION ALL SELECT 'no_such_check') x LEFT JOIN ck USING ("check")""")
def g22_acknowledge(spark, sf_dir):
    """Requests to acknowledge each check, every second one with too short a reason."""
    asked = spark.createDataFrame([(c, "looks fine" if len(c) % 2 == 0 else "seen, and told downstream") for c in [*audit.LEVELS, "no_such_check"]], "check string, why string")
    return audit.acknowledge(_checks(spark, sf_dir), asked)


@query(_AUDIT + """ SELECT count(*) FILTER (level = 'pass') AS n_pass, count(*) FILTER (level = 'warn') AS n_warn, count(*) FILTER (level = 'fail') AS n_fail, count(*) FILTER (acknowledged) AS n_acknowledged,
CASE WHEN bool_or(level = 'fail') THEN 'fail' WHEN bool_or(level = 'warn' AND NOT acknowledged) THEN 'warn' ELSE 'pass' END AS verdict FROM ck""")
def a14_audit_rollup(spark, sf_dir):
    return audit.rollup(_checks(spark, sf_dir))


# ------------------------------------------------------------------ verdicts on names



@query(f""", pr AS (SELECT f.name AS l, c.note AS r, count(*) AS n FROM candidates c JOIN features f USING (ordinal) GROUP BY ALL), {verdicts("pr")} SELECT l AS query, r AS candidate, verdict, conflicts, n FROM pr JOIN vd USING (l, r)""")
def f19_f20_verdicts(spark, sf_dir):
    """the verdict on each name and the name of each of its candidates, and the axes of conflict."""
    n = D.features(spark, sf_dir).select("ordinal", F.col("name").alias("query"))
    g = D.candidates(spark, sf_dir).select("ordinal", F.col("note").alias("candidate")).join(n, "ordinal").groupBy("query", "candidate").agg(F.count("*").alias("n"))
    return verdict.judged(g, "query", "candidate").select("query", "candidate", "v.verdict", F.array_join("v.conflicts", ";").alias("conflicts"), "n")


@query(f""", rc AS (SELECT DISTINCT db, id, note FROM candidates WHERE id IS NOT NULL), pr AS (SELECT DISTINCT h.ordinal, h.name AS l, h.db, h.id, rc.note AS r FROM held h LEFT JOIN rc ON rc.db = h.db AND rc.id = h.id), {verdicts("(SELECT l, r FROM pr WHERE r IS NOT NULL)")}
SELECT ordinal, pr.db, pr.id, count(pr.r) AS n_names, CASE WHEN bool_or(verdict = 'conflict') THEN 'conflict' WHEN bool_or(verdict = 'ok') THEN 'ok' WHEN bool_or(verdict = 'class-level') THEN 'class-level' WHEN bool_or(verdict = 'ambiguous') THEN 'ambiguous' ELSE 'unknown' END AS verdict
FROM pr LEFT JOIN vd ON vd.l = pr.l AND vd.r = pr.r GROUP BY ordinal, pr.db, pr.id""".replace(", rc AS", f", {_HELD}, rc AS", 1))
def f22_best_verdict(spark, sf_dir):
    """of every accepted id, the verdict over all names that its record has among the candidates; unknown for a record without names."""
    records = D.candidates(spark, sf_dir).where("id is not null").select("db", "id", "note").distinct()
    r = written(held(spark, sf_dir).join(records, ["db", "id"], "left").select("ordinal", "name", "db", "id", "note"), "records")
    judged = verdict.judged(r.where("note is not null").select("name", "note").distinct(), "name", "note").select(F.col("name").alias("l"), F.col("note").alias("r"), F.col("v.verdict").alias("v"))
    r = r.join(judged, (F.col("name") == F.col("l")) & (F.col("note") == F.col("r")), "left")
    return r.groupBy("ordinal", "db", "id").agg(F.count("note").alias("n_names"), verdict.best_of(F.collect_set("v")).alias("verdict"))


@query(f""", {_HELD}, n AS (SELECT DISTINCT db, id, trim(name) AS name FROM held) SELECT a.db, a.id, a.name AS a, b.name AS b FROM n a JOIN n b ON a.db = b.db AND a.id = b.id WHERE a.name < b.name""")
def j5_pairs(spark, sf_dir):
    """The pairs of different names on each shared id."""
    return collide.pairs(held(spark, sf_dir)).select("db", "id", "a", "b")


@query(f""", {_HELD}, nm AS (SELECT DISTINCT db, id, trim(name) AS name FROM held), pr AS (SELECT a.db, a.id, a.name AS l, b.name AS r FROM nm a JOIN nm b ON a.db = b.db AND a.id = b.id WHERE a.name < b.name), {verdicts("pr")}
SELECT db, id, l AS a, r AS b, verdict, conflicts FROM pr JOIN vd USING (l, r)""")
def j5_pairwise(spark, sf_dir):
    """The different names on each shared id, compared in pairs."""
    return collide.pairs(held(spark, sf_dir)).select("db", "id", "a", "b", "verdict", F.array_join("conflicts", ";").alias("conflicts"))

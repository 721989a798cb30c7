"""SQL for DuckDB over the generated tables: the domain projection, and one statement per query."""

from __future__ import annotations

from . import vocab as V
from .sources.domain import ACTIONS, FORMULAS, NAMES, ORIGINS, RATIONALES, RELATIONS
from .vocab import NAMESPACES, SOURCES, TIERS, VERDICTS


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pad(x: str, n: int | str) -> str:
    return f"lpad({x}, greatest({n}, length({x}))::INT, '0')"


def canon(db: str, x: str) -> str:
    x = f"nullif(nullif(nullif(nullif(trim({x}), ''), 'NA'), 'null'), 'None')"
    digits = f"regexp_extract({x}, '^HMDB0*([0-9]+)$', 1)"
    return f"CASE WHEN {db} = 'hmdb' AND {digits} <> '' THEN 'HMDB' || {pad(digits, 7)} WHEN {db} = 'chebi' AND NOT starts_with(upper({x}), 'CHEBI:') THEN 'CHEBI:' || {x} ELSE {x} END"


_N = "(l_suppkey * 20 + l_partkey % 20)::VARCHAR"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())
_B = "(c_custkey // 3)"
_PLACE = "['c', 'm', 'e'][c_custkey % 3 + 1]"

PRELUDE = f"""WITH features AS (SELECT p_partkey AS ordinal, 'M' || {pad("p_partkey::VARCHAR", 4)} AS feature_id,
    CASE WHEN p_partkey % 2 = 0 THEN {_list(NAMES)}[(p_partkey // 2) % {len(NAMES)} + 1] ELSE p_name END AS name FROM part),
candidates AS (SELECT *, {canon("db", "raw_id")} AS id FROM (SELECT l_partkey AS ordinal, l_orderkey * 10 + l_linenumber AS seq,
    {_list(SOURCES)}[CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END] AS source,
    {_list(NAMESPACES)}[l_suppkey % 5 + 1] AS db,
    CASE WHEN l_orderkey % 50 = 0 THEN 'NA' WHEN l_suppkey % 5 = 0 THEN 'C' || {pad(_N, 5)}
         WHEN l_suppkey % 5 = 1 THEN 'HMDB' || CASE WHEN l_linenumber % 2 = 0 THEN {pad(_N, 5)} ELSE {pad(_N, 7)} END
         WHEN l_suppkey % 5 = 2 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'CHEBI:' ELSE '' END || {_N}
         WHEN l_suppkey % 5 = 3 THEN {_N} ELSE 'KEY' || {_N} || '-N' END AS raw_id,
    {_list(NAMES)}[(l_suppkey + l_partkey) % {len(NAMES)} + 1] AS note,
    CASE WHEN l_linenumber % 2 <> 0 THEN {_list(FORMULAS)}[l_suppkey % {len(FORMULAS)} + 1] END AS formula,
    CASE WHEN l_linenumber = 7 THEN '' WHEN l_linenumber = 3 THEN 'chebi:' || {_N} ELSE {_list(NAMES)}[(l_suppkey * 7 + l_partkey) % {len(NAMES)} + 1] END AS query
    FROM lineitem)),
accepted AS (SELECT ordinal, db, CASE WHEN db = 'kegg' AND ordinal % 17 = 0 THEN 'C99999' ELSE b.id END AS id
    FROM (SELECT ordinal, db, min({{'seq': seq, 'id': id}}) AS b FROM candidates WHERE id IS NOT NULL AND ordinal % 9 <> 8 AND NOT (ordinal % 11 = 3 AND db = 'hmdb' OR ordinal % 31 = 5 AND db IN ('kegg', 'hmdb') OR ordinal % 37 = 6) GROUP BY ordinal, db)),
wide AS (SELECT ordinal, {", ".join(f"min(id) FILTER (db = '{d}') AS {d}" for d in NAMESPACES)} FROM accepted GROUP BY ordinal),
entries AS (SELECT *, CASE WHEN relation IN ('exact', 'class-proxy', 'isomer-surrogate') THEN 'MAM' || lpad((ordinal // 2 % 400)::VARCHAR, 5, '0') END AS mam FROM
   (SELECT f.ordinal, feature_id, name, {", ".join(NAMESPACES)},
    CASE WHEN f.ordinal % 9 = 8 THEN NULL WHEN f.ordinal % 23 = 0 THEN 'xenobiotic-excluded' WHEN f.ordinal % 19 = 0 THEN 'exogenous'
         WHEN kegg IS NOT NULL THEN 'KEGG-mapped' WHEN hmdb IS NOT NULL THEN 'HMDB-mapped' WHEN coalesce(chebi, pubchem, inchikey) IS NOT NULL THEN 'structure-only' ELSE 'unmapped' END AS final_class,
    CASE WHEN f.ordinal % 8 < 7 THEN {_list(TIERS)}[f.ordinal % 8 + 1] END AS confidence,
    CASE WHEN f.ordinal % 4 <> 3 THEN {_list(ORIGINS)}[(f.ordinal // 4) % {len(ORIGINS)} + 1] END AS origin,
    CASE WHEN f.ordinal % 6 < 5 THEN {_list(RELATIONS)}[f.ordinal % 6 + 1] END AS relation,
    CASE WHEN f.ordinal % 3 = 0 THEN 'chosen because its chain matches' ELSE 'short' END AS rationale, f.ordinal % 3 = 0 AS curated
    FROM features f LEFT JOIN wide USING (ordinal))),
decisions AS (SELECT ordinal, seq, ts, action, db, CASE WHEN seq % 3 <> 0 AND held IS NOT NULL THEN held ELSE 'X' || seq END AS id,
    CASE WHEN action = 'backcheck' THEN {_list(VERDICTS)}[seq % 4 + 1] END AS verdict,
    CASE WHEN action = 'backcheck' THEN CASE WHEN seq % 7 = 0 THEN 'class' ELSE 'species' END END AS db_resolution, rationale, props
    FROM (SELECT user_id AS ordinal, event_id AS seq, ts, CASE event_type {_CASES} END AS action, {_list(NAMESPACES)}[event_id % 5 + 1] AS db,
          {_list(RATIONALES)}[event_id % {len(RATIONALES)} + 1] AS rationale, props FROM events) e
    LEFT JOIN (SELECT ordinal, db, id AS held FROM accepted) USING (ordinal, db)),
species AS (SELECT c_custkey AS ordinal, 'MAM' || {pad(_B + "::VARCHAR", 5)} || CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE '' END || {_PLACE} AS species_id,
    CASE WHEN c_custkey % 5 <> 4 THEN {_PLACE} ELSE '' END AS compartment,
    CASE WHEN c_custkey % 4 <> 1 THEN {_list(NAMES)}[{_B} % {len(NAMES)} + 1] || CASE WHEN {_B} >= {len(NAMES)} THEN ' ' || ({_B} % 40) ELSE '' END ELSE '' END AS name,
    CASE WHEN c_custkey % 7 <> 3 THEN {_list(FORMULAS)}[{_B} % {len(FORMULAS)} + 1] END AS formula, (c_custkey % 3 - 1)::INT AS charge, c_acctbal + 1100.0 AS mass,
    CASE WHEN {_B} % 2 = 0 THEN 'C' || {pad(f"({_B} * 5)::VARCHAR", 5)} END AS kegg,
    CASE WHEN {_B} % 3 = 0 THEN 'HMDB' || {pad(f"({_B} * 5)::VARCHAR", 7)} END AS hmdb,
    CASE WHEN {_B} % 5 = 0 THEN 'CHEBI:' || ({_B} * 5) END AS chebi FROM customer),
bridge AS (SELECT ['kegg', 'chebi', 'pubchem', 'inchikey'][o_custkey % 4 + 1] AS src_db,
    CASE WHEN o_custkey % 4 = 0 THEN 'C' || {pad("o_custkey::VARCHAR", 5)} WHEN o_custkey % 4 = 1 AND o_custkey % 3 = 0 THEN 'CHEBI:' || o_custkey WHEN o_custkey % 4 < 3 THEN o_custkey::VARCHAR ELSE 'KEY' || o_custkey || '-N' END AS src_id,
    'HMDB' || CASE WHEN o_orderkey % 2 = 0 THEN {pad("(o_orderkey // 4)::VARCHAR", 5)} ELSE {pad("(o_orderkey // 4)::VARCHAR", 7)} END AS hmdb FROM orders)
"""


def _listed(table: dict[str, str]) -> str:
    """The tags whose pattern a lower-case name has, in order. RE2 has no look-ahead: what may not follow is spelled out."""
    said = []
    for tag, p in table.items():
        test = f"regexp_matches(low, '{p}')"
        if tag == "sphingolipid":
            test = "regexp_matches(low, '" + p.replace("cer(?![a-z])", "cer([^a-z]|$)") + "')"
        if tag == "lacto":
            test = "regexp_matches(regexp_replace(low, '\\blacto(neo|se|syl|bio)', '#', 'g'), '" + p.replace("(?!neo|se|syl|bio)", "") + "')"
        said.append(f"CASE WHEN {test} THEN '{tag}' END")
    return "list_filter([" + ", ".join(said).replace("3'?", "3''?").replace("6'?", "6''?") + "], lambda x: x IS NOT NULL)"


def _map(pairs: dict) -> str:
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, list)) else f"'{v}'"
    return "MAP {" + ", ".join(f"'{k}': {show(v)}" for k, v in pairs.items()) + "}"


def _alternatives(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _group(pattern: str, n: int) -> str:
    return f"nullif(regexp_extract(low, '{pattern}', {n}), '')"


_STEMS = f"({_alternatives(V.STEMS)})a?({_alternatives(V.ENDINGS)})o(?:yl|ic)"
_CHAIN = r"regexp_extract_all(regexp_replace(low, '([^0-9:.])', '\1\1', 'g'), '(?:^|[^0-9.:])([0-9]{1,2}:[0-9])(?:[^0-9:]|$)', 1)"
_SAME, _MEET = "x.{0} = y.{0}", "len(list_intersect(x.{0}, y.{0})) > 0"
_BOTH, _ONE = "len(x.{0}) > 0 AND len(y.{0}) > 0", "(len(x.{0}) > 0) <> (len(y.{0}) > 0)"
_AXES = (
    [(a, f"{_BOTH} AND NOT {_MEET}", _ONE) for a in ("skeleton", "ether_linkage")]
    + [(a, "x.{0} <> y.{0}", "(x.{0} IS NULL) <> (y.{0} IS NULL)") for a in ("glycan_series", "glycan_length", "sialyl_linkage", "omega", "peroxidation", "hydroxy_count", "acetyl_count", "polyamine_backbone")]
    + [
        ("chains", f"{_BOTH} AND NOT {_MEET}", f"{_MEET} AND x.{{0}} <> y.{{0}}"), ("db_positions", f"{_BOTH} AND x.{{0}} <> y.{{0}}", f"{_ONE} AND len(list_intersect(x.chains, y.chains)) > 0"),
        ("linkages", None, f"{_BOTH} AND x.{{0}} <> y.{{0}}"), ("hete_locants", f"{_BOTH} AND x.{{0}} <> y.{{0}}", None), ("oxidation", "x.{0} <> y.{0} AND len(x.skeleton) > 0 AND len(y.skeleton) > 0", None),
    ]
)


def _axes(which: int) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {a[which].format(a[0])} THEN '{a[0]}' END" for a in _AXES if a[which]) + "], lambda x: x IS NOT NULL)"


def verdicts(pairs: str) -> str:
    """CTEs that end in vd(l, r, verdict, conflicts), over the distinct pairs of names of a table (l, r)."""
    return rf"""vp AS (SELECT DISTINCT l, r FROM {pairs}),
v0 AS (SELECT n, regexp_replace(replace(replace(replace(lower(coalesce(n, '')), 'α', 'alpha'), 'β', 'beta'), '→', '->'), '([0-9]+)[ze]([,)\s\-])', '\1\2', 'g') AS low FROM (SELECT l AS n FROM vp UNION SELECT r FROM vp)),
v1 AS (SELECT *, {_listed(V.SKELETONS)} AS sk, {_listed(V.ETHERS)} AS said, regexp_extract_all(low, '{_alternatives(V.ACYLS)}') AS tr, regexp_extract_all(low, '{_STEMS}', 1) AS s1, regexp_extract_all(low, '{_STEMS}', 2) AS s2, regexp_matches(low, '{V.OXIDATION}') AS oxidation,
 coalesce({", ".join(f"CASE WHEN contains(low, '{p}') THEN '{p}' END" for p in V.POLYAMINES)}) AS polyamine_backbone FROM v0),
v2 AS (SELECT *, list_sort(list_distinct(list_concat(list_filter({_CHAIN}, lambda x: x <> '0:0'), list_transform(tr, lambda x: {_map({k: v[0] for k, v in V.ACYLS.items()})}[x]),
 list_transform(range(1, len(s1) + 1), lambda i: {_map(V.STEMS)}[s1[i]]::VARCHAR || ':' || {_map(V.ENDINGS)}[s2[i]]::VARCHAR)))) AS chains FROM v1),
vf AS (SELECT n, list_sort(sk) AS skeleton, chains, oxidation, polyamine_backbone,
 list_sort(CASE WHEN (len(tr) > 0 AND regexp_matches(low, 'glycero|phosphocholine|phosphoethanolamine')) OR (len(chains) > 0 AND list_contains(sk, 'glycerophospholipid') AND len(said) = 0) THEN list_distinct(list_append(said, 'acyl')) ELSE said END) AS ether_linkage,
 coalesce('n-' || {_group(V.OMEGA, 1)}, list_filter(list_transform(tr, lambda x: {_map({k: v[1] for k, v in V.ACYLS.items()})}[x]), lambda x: x IS NOT NULL)[1]) AS omega,
 list_sort(list_distinct(list_concat(flatten(list_transform(tr, lambda x: {_map({k: v[2] for k, v in V.ACYLS.items()})}[x])), flatten(list_transform(regexp_extract_all(low, '{V.POSITIONS}', 1), lambda x: list_transform(string_split(x, ','), lambda y: y::INT)))))) AS db_positions,
 coalesce({_listed(V.SERIES)}[1], {_map(V.SERIES_OF_LINK)}[coalesce({", ".join(_group(V.SERIES_LINK, k) for k in (1, 2, 3))})]) AS glycan_series,
 coalesce({_group(V.GLYCAN_SIZE, 1)}, {_group(V.GLYCAN_SIZE, 2)}, {_map(V.OSYL)}[regexp_extract(low, '{V.OSYL_COUNT}', 1)]::VARCHAR, CASE WHEN contains(low, 'paraglobo') THEN '4' END) AS glycan_length, {_listed(V.SIALYL)}[1] AS sialyl_linkage,
 list_transform(regexp_extract_all(low, '{V.LINKAGE}', 0), lambda x: array_to_string(list_slice(regexp_extract_all(x, '[0-9]'), 1, 2), '-')) AS linkages, CASE WHEN oxidation THEN regexp_matches(low, '{V.PEROXIDATION}')::VARCHAR END AS peroxidation,
 CASE WHEN regexp_matches(low, '{V.HETE_OR_HODE}') THEN CASE WHEN regexp_matches(low, '{V.TWO_HYDROXY}') THEN 2 ELSE 1 END WHEN list_contains(sk, 'eicosanoid') AND contains(low, 'hydroxy') THEN CASE WHEN contains(low, 'dihydroxy') THEN 2 ELSE 1 END END AS hydroxy_count,
 list_sort(list_distinct(regexp_extract_all(low, '{V.HETE_LOCANT}', 1))) AS hete_locants,
 CASE WHEN polyamine_backbone IS NOT NULL OR list_contains(sk, 'amino-acid') THEN CASE WHEN regexp_matches(low, '{V.TWO_ACETYL}') THEN 2 WHEN regexp_matches(low, '{V.ONE_ACETYL}') THEN 1 END END AS acetyl_count,
 CASE WHEN len(chains) > 0 OR regexp_matches(low, '{V.HEADGROUP}') THEN 'species' WHEN len(list_intersect(sk, {_list(V.LIPIDS)})) > 0 OR regexp_matches(low, '{V.GENERIC}') THEN 'class' ELSE 'species' END AS resolution FROM v2),
vc AS (SELECT l, r, {_axes(1)} AS conflicts, {_axes(2)} AS ambiguities, x.resolution = 'species' AND y.resolution = 'class' AS wide FROM vp JOIN vf x ON x.n IS NOT DISTINCT FROM l JOIN vf y ON y.n IS NOT DISTINCT FROM r),
vd AS (SELECT l, r, CASE WHEN len(conflicts) > 0 THEN 'conflict' WHEN wide THEN 'class-level' WHEN len(ambiguities) > 0 THEN 'ambiguous' ELSE 'ok' END AS verdict, array_to_string(conflicts, ';') AS conflicts FROM vc)"""

"""What a name says about its compound, and whether two names can mean one compound.

Both are Column expressions. Acyl names match the longest first and use up their letters, so
"linoleoyl" isn't also "oleoyl"; systematic stems take the linking "a" ("eicosatetraenoyl").
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..plans.written import discard, written

SET_AXES = ["skeleton", "ether_linkage"]
SCALAR_AXES = ["glycan_series", "glycan_length", "sialyl_linkage", "omega", "peroxidation", "hydroxy_count", "acetyl_count", "polyamine_backbone"]
_STRINGS = "cast(array() as array<string>)"


def lowered(c: Column) -> Column:
    c = F.lower(F.coalesce(c, F.lit("")))
    for old, new in (("α", "alpha"), ("β", "beta"), ("→", "->")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, r"(\d+)[ze](?=[,)\s\-])", "$1")


def _tags(low: Column, table: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(tag)) for tag, p in table.items()]))


def _first(low: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(low.rlike(p), F.lit(tag)) for tag, p in table.items()])


def _all(low: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(low, F.lit(pattern), F.lit(group))


def _longest(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)])


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def features(name: Column, let: Callable[[str, Column], Column] = lambda _, c: c) -> Column:
    """A struct of the axes on which compounds of like name differ. Null is read as an empty name.

    let gives what is used more than once a name, so that it is computed once (see featured).
    """
    low = let("low", lowered(name))
    skeleton = let("skeleton", _tags(low, V.SKELETONS))
    trivial = let("trivial", _all(low, f"({_longest(V.ACYLS)})"))
    stems = f"({_longest(V.STEMS)})a?({_longest(V.ENDINGS)})o(?:yl|ic)"
    systematic = F.zip_with(_all(low, stems, 1), _all(low, stems, 2), lambda a, b: F.concat(_map(V.STEMS)[a].cast("string"), F.lit(":"), _map(V.ENDINGS)[b].cast("string")))
    of_trivial = F.transform(trivial, lambda x: _map({k: v[0] for k, v in V.ACYLS.items()})[x])
    chains = let("chains", _set(F.concat(F.filter(_all(low, V.CHAIN), lambda x: x != "0:0"), of_trivial, systematic)))
    headed = low.rlike("glycero|phosphocholine|phosphoethanolamine")
    said = let("said", _tags(low, V.ETHERS))
    ester = (F.size(trivial) > 0) & headed
    implied = (F.size(chains) > 0) & F.array_contains(skeleton, "glycerophospholipid") & (F.size(said) == 0)
    ether = F.when(ester | implied, F.array_distinct(F.concat(said, F.array(F.lit("acyl"))))).otherwise(said)
    stated = F.regexp_extract(low, V.OMEGA, 1)
    omegas = F.array_compact(F.transform(trivial, lambda x: _map({k: v[1] for k, v in V.ACYLS.items() if v[1]})[x]))
    omega = F.when(stated != "", F.concat(F.lit("n-"), stated)).otherwise(F.get(omegas, F.lit(0)))
    known = F.flatten(F.transform(trivial, lambda x: F.create_map(*[y for k, v in V.ACYLS.items() for y in (F.lit(k), F.array(*[F.lit(p) for p in v[2]]) if v[2] else F.expr("cast(array() as array<int>)"))])[x]))
    listed = F.flatten(F.transform(_all(low, V.POSITIONS), lambda x: F.transform(F.split(x, ","), lambda y: y.cast("int"))))
    link = F.coalesce(*[F.nullif(F.regexp_extract(low, V.SERIES_LINK, k), F.lit("")) for k in (1, 2, 3)])
    series = F.coalesce(_first(low, V.SERIES), _map(V.SERIES_OF_LINK)[link])
    size = F.coalesce(*[F.nullif(F.regexp_extract(low, V.GLYCAN_SIZE, k), F.lit("")) for k in (1, 2)]).cast("int")
    osyl = _map(V.OSYL)[F.regexp_extract(low, V.OSYL_COUNT, 1)]
    length = F.coalesce(size, osyl, F.when(low.contains("paraglobo"), 4))
    pairs = F.transform(_all(low, V.LINKAGE, 0), lambda x: F.array_join(F.slice(F.regexp_extract_all(x, F.lit(r"(\d)"), F.lit(1)), 1, 2), "-"))
    oxidation = let("oxidation", low.rlike(V.OXIDATION))
    hydroxy = F.when(low.rlike(V.HETE_OR_HODE), F.when(low.rlike(V.TWO_HYDROXY), 2).otherwise(1)).when(
        F.array_contains(skeleton, "eicosanoid") & low.contains("hydroxy"), F.when(low.contains("dihydroxy"), 2).otherwise(1)
    )
    polyamine = let("polyamine", F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in V.POLYAMINES]))
    acetyl = F.when(polyamine.isNotNull() | F.array_contains(skeleton, "amino-acid"), F.when(low.rlike(V.TWO_ACETYL), 2).when(low.rlike(V.ONE_ACETYL), 1))
    generic = let("generic", low.rlike(V.GENERIC))
    lipid = F.arrays_overlap(skeleton, F.array(*map(F.lit, V.LIPIDS)))
    resolution = F.when((F.size(chains) > 0) | low.rlike(V.HEADGROUP), "species").when(lipid | generic, "class").otherwise("species")
    return F.struct(
        F.array_sort(skeleton).alias("skeleton"), F.array_sort(ether).alias("ether_linkage"), chains.alias("chains"), omega.alias("omega"),
        _set(F.concat(known, listed)).alias("db_positions"), series.alias("glycan_series"), length.cast("string").alias("glycan_length"),
        _first(low, V.SIALYL).alias("sialyl_linkage"), pairs.alias("linkages"), oxidation.alias("oxidation"),
        F.when(oxidation, low.rlike(V.PEROXIDATION)).cast("string").alias("peroxidation"), hydroxy.cast("string").alias("hydroxy_count"),
        _set(_all(low, V.HETE_LOCANT)).alias("hete_locants"), acetyl.cast("string").alias("acetyl_count"), polyamine.alias("polyamine_backbone"),
        resolution.alias("resolution"), generic.alias("generic_token"),
    )


def featured(found: DataFrame, name: str) -> DataFrame:
    """name and f, the features of each distinct value of a column, as a written table.

    Each step is a column of its own that the next ones read. What reads the table sees plain
    columns: comparisons of two names stay small however the axes are computed, and Spark can't push
    a condition on them below the aggregation, where every row would have to be looked at.
    """
    df = found.select(F.col(name).alias("name")).distinct()

    def let(key: str, c: Column) -> Column:
        nonlocal df
        df = df.withColumn(f"_{key}", c)
        return F.col(f"_{key}")

    whole = features(F.col("name"), let)
    return written(df.select("name", whole.alias("f")), "features")


def judged(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with v, the comparison of the names in two columns. Each distinct name is read once, and each distinct pair compared once.

    The comparisons are written: a condition on a verdict would otherwise be pushed into its seventeen axes and spread over all their combinations.
    """
    met = one = written(pairs.select(F.col(left).alias("_l"), F.col(right).alias("_r")).distinct(), "pairs")
    names = featured(one.select(F.col("_l").alias("name")).union(one.select("_r")), "name")
    a, b = names.select(F.col("name").alias("_a"), F.col("f").alias("_fa")), names.select(F.col("name").alias("_b"), F.col("f").alias("_fb"))
    one = one.join(a, F.col("_l").eqNullSafe(F.col("_a"))).join(b, F.col("_r").eqNullSafe(F.col("_b"))).select("_l", "_r", compare(F.col("_fa"), F.col("_fb")).alias("v"))
    one = written(one, "verdicts")
    discard(met, names)
    return pairs.join(one, F.col(left).eqNullSafe(F.col("_l")) & F.col(right).eqNullSafe(F.col("_r"))).drop("_l", "_r")


def compare(q: Column, c: Column) -> Column:
    """struct(verdict, conflicts, ambiguities, shared) of two features() columns; the lists name axes."""
    has = lambda x: F.size(x) > 0
    conflicts, ambiguities, shared = [], [], []
    for ax in SET_AXES:
        a, b = q[ax], c[ax]
        meet = F.size(F.array_intersect(a, b)) > 0
        shared.append(F.when(meet, F.lit(ax)))
        conflicts.append(F.when(has(a) & has(b) & ~meet, F.lit(ax)))
        ambiguities.append(F.when(has(a) != has(b), F.lit(ax)))
    for ax in SCALAR_AXES:
        a, b = q[ax], c[ax]
        shared.append(F.when(a == b, F.lit(ax)))
        conflicts.append(F.when(a != b, F.lit(ax)))
        ambiguities.append(F.when(a.isNull() != b.isNull(), F.lit(ax)))
    a, b = q["chains"], c["chains"]
    overlap = F.size(F.array_intersect(a, b)) > 0
    shared.append(F.when(has(a) & (a == b), F.lit("chains")))
    conflicts.append(F.when(has(a) & has(b) & ~overlap, F.lit("chains")))
    ambiguities.append(F.when(overlap & (a != b), F.lit("chains")))
    a, b = q["db_positions"], c["db_positions"]
    shared.append(F.when(has(a) & (a == b), F.lit("db_positions")))
    conflicts.append(F.when(has(a) & has(b) & (a != b), F.lit("db_positions")))
    ambiguities.append(F.when((has(a) != has(b)) & overlap, F.lit("db_positions")))
    a, b = q["linkages"], c["linkages"]
    shared.append(F.when(has(a) & (a == b), F.lit("linkages")))
    ambiguities.append(F.when(has(a) & has(b) & (a != b), F.lit("linkages")))
    a, b = q["hete_locants"], c["hete_locants"]
    conflicts.append(F.when(has(a) & has(b) & (a != b), F.lit("hete_locants")))
    conflicts.append(F.when((q["oxidation"] != c["oxidation"]) & has(q["skeleton"]) & has(c["skeleton"]), F.lit("oxidation")))
    bad, open_ = F.array_compact(F.array(*conflicts)), F.array_compact(F.array(*ambiguities))
    verdict = F.when(has(bad), "conflict").when((q["resolution"] == "species") & (c["resolution"] == "class"), "class-level").when(has(open_), "ambiguous").otherwise("ok")
    return F.struct(verdict.alias("verdict"), bad.alias("conflicts"), open_.alias("ambiguities"), F.array_compact(F.array(*shared)).alias("shared"))


def rank(verdict: Column) -> Column:
    """Safest first; what can't be told comes last."""
    return F.coalesce(_map({v: k for k, v in enumerate(V.VERDICTS)})[verdict], F.lit(len(V.VERDICTS)))


def best_of(verdicts: Column) -> Column:
    """The verdict over all names of a record: a conflict wins, then ok, class-level, ambiguous; unknown without names."""
    return F.coalesce(*[F.when(F.array_contains(verdicts, v), F.lit(v)) for v in ("conflict", "ok", "class-level", "ambiguous")], F.lit("unknown"))

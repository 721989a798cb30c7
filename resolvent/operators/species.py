"""The model's species: index, lookups, similarity, formula and mass joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formula, ids, names, variants, verdict
from ..plans import blocking
from ..plans.written import shuffled, written


def index(species: DataFrame) -> DataFrame:
    """One row per base id: first name, formula and charge in model order, and sorted sets of the rest."""
    rows = species.withColumn("base", ids.base_id(F.col("species_id"), F.col("compartment")))
    first = lambda c: F.min(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct("ordinal", c)))[c]
    distinct = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    out = rows.groupBy("base").agg(first("name").alias("name"), first("formula").alias("formula"), first("charge").alias("charge"), distinct("name").alias("names"), distinct("compartment").alias("compartments"), distinct("species_id").alias("species"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("kegg", "hmdb", "chebi")], first("mass").alias("mass"))
    return out.withColumn("pool", F.coalesce(formula.is_pool(F.col("formula")), F.lit(False)))


def lookup(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(id) as a base id, else as a species id."""
    as_base = index.select(F.col("base").alias("id"), F.lit(0).alias("place"), F.col("base"))
    as_species = index.select(F.explode("species").alias("id"), F.lit(1).alias("place"), F.col("base"))
    best = as_base.unionByName(as_species).groupBy("id").agg(F.min(F.struct("place", "base")).alias("b"))
    return asked.join(shuffled(best), "id", "left").select("id", F.col("b").isNotNull().alias("found"), F.col("b.base").alias("base"), F.when(F.col("b.place") == 0, "base-id").when(F.col("b.place") == 1, "species-id").alias("by"))


class _Scores:
    """What names.name_score gives distinct queries, from a score on, kept apart: `said` by distinct name (query, name, b), `by_id` by species (query, base, b); `named` has the names of each species.

    So a name that many species carry is compared once. Only pairs that some route can score so high are looked at: see blocking.
    """

    def __init__(self, spellings: DataFrame, index: DataFrame, least: float):
        asked = written(spellings.select("query").distinct(), "asked")
        own = F.when(F.size("names") == 0, F.array(F.col("base"))).otherwise(F.col("names"))
        self.named = written(index.select("base", F.explode(own).alias("name")), "named")
        q_parts = asked.withColumn("q", names.name_parts(F.trim("query")))
        n_parts = self.named.select("name").distinct().withColumn("n", names.name_parts(F.col("name")))
        met = written(blocking.like_names(asked, "query", self.named, "name", least), "met")
        scored = met.join(shuffled(q_parts), "query").join(shuffled(n_parts), "name").select("query", "name", names.text_score(F.col("q"), F.col("n")).alias("b"))
        self.said = written(scored.where(F.col("b.score") >= least), "said")
        ids = blocking.like_ids(asked, "query", written(index.select("base", F.array_join("species", " ").alias("ids")), "ids"), "base", "ids")
        scored = ids.select("query", "base", names.id_score(F.lower(F.trim("query")), F.col("base"), F.col("ids")).alias("b"))
        self.by_id = written(scored.where(F.col("b.score") >= least), "by_id")

    def of(self, pairs: DataFrame) -> DataFrame:
        """query, base, score, order, kind of those distinct pairs (query, base) that have a score: the best route, the earlier of equals."""
        by_name = pairs.join(shuffled(self.named), "base").join(shuffled(self.said), ["query", "name"]).select("query", "base", "b")
        hits = by_name.unionByName(pairs.join(shuffled(self.by_id), ["query", "base"]).select("query", "base", "b"))
        return hits.groupBy("query", "base").agg(F.max("b").alias("b")).select("query", "base", "b.score", "b.order", "b.kind")

    def best(self, most: int) -> DataFrame:
        """query, base, score (rounded), kind, rank: the `most` best of each query by rounded score, then base id.

        One of them is among the `most` least base ids of a name that gives it its score, or among the `most` best by id alone.
        """
        some = self.named.distinct().withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("base"))).where(F.col("place") <= most).drop("place")
        score = F.round("b.score", 1)
        by_name = self.said.join(shuffled(some), "name").groupBy("query", "base").agg(F.max(score).alias("score"))
        hits = by_name.unionByName(self.by_id.select("query", "base", score.alias("score"))).groupBy("query", "base").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "base")
        first = written(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("query", "base"), "first")
        found = self.of(first).withColumn("score", F.round("score", 1))
        return found.withColumn("rank", F.row_number().over(w)).select("query", "base", "score", "kind", "rank")


def search(queries: DataFrame, index: DataFrame, most: int = 25, least: float = 30.0) -> DataFrame:
    """The best species per query name: rounded score, then base id."""
    return _Scores(queries, index, least).best(most)


def _least_of(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows of the `most` least base ids of each key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("base"))).where(F.col("place") <= most).drop("place")


def search_all(spellings: DataFrame, facts: DataFrame | None, index: DataFrame, most: int = 25, least: float = 30.0, ppm: float = 25.0) -> DataFrame:
    """The best species per key by all that is known of it: key, base, score, kind, matched (the spelling, for a name), rank.

    spellings: key, place, query, in the order they are tried; facts: key, kegg, hmdb, chebi,
    formula, mass, any of them null, or None. Ids count 100, formulas 95, masses 85 to 80, names as they
    score. Routes are folded in this order: a later one counts if it is above what stands, rounded.

    What the fold gives is the greatest of the rounded scores. So a species that is among the best of a key is among the
    `most` best of the route that gives it its score, by rounded score and base id; only those are folded, with all their routes.
    """
    spelled = written(spellings.where("trim(query) <> ''").select("key", "place", F.trim("query").alias("query")), "spelled")
    index = written(index.select("base", "names", "species", "kegg", "hmdb", "chebi", "formula", F.col("mass").alias("m")), "index")
    scores = _Scores(spelled, index, least)
    pairs = spelled.select("key", "query").distinct().join(shuffled(scores.best(most).select("query", "base")), "query").select("key", "base")
    no = F.lit(None).cast("string")
    if facts is not None:
        facts = written(facts.select("key", "kegg", "hmdb", ids.chebi(F.col("chebi")).alias("chebi"), "formula", "mass"), "facts")
        each = lambda df, of: df.select(of, F.explode(F.array(*[F.struct(F.lit(d).alias("db"), F.col(d).alias("id")) for d in ("kegg", "hmdb", "chebi")])).alias("x")).select(of, "x.*").where("id is not null")
        pairs = pairs.unionByName(each(facts, "key").join(shuffled(_least_of(each(index, "base"), ["db", "id"], most)), ["db", "id"]).select("key", "base"))
        canon = index.where("formula is not null").select("base", formula.canonical(F.col("formula")).alias("canon"))
        asked = facts.where("formula is not null").select("key", formula.canonical(F.col("formula")).alias("canon"))
        pairs = pairs.unionByName(asked.join(shuffled(_least_of(canon, ["canon"], most)), "canon").select("key", "base"))
        near = blocking.range_join(facts.where("mass is not null").select("key", "mass"), "mass", shuffled(index.select("base", "m")), "m", ppm / 1e6)
        of_mass = lambda: 85.0 - F.abs(F.col("m") - F.col("mass")) / F.greatest(F.col("mass") * (ppm / 1e6), F.lit(1e-9)) * 5.0
        w = Window.partitionBy("key").orderBy(F.round(of_mass(), 1).desc(), "base")
        pairs = pairs.unionByName(near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("key", "base"))
    pairs = written(pairs.distinct(), "pairs")
    asked = written(pairs.join(shuffled(spelled), "key").select("key", "place", "query", "base"), "asked")
    named = asked.join(shuffled(scores.of(asked.select("query", "base").distinct())), ["query", "base"])
    hit = lambda at, score, kind, matched: F.struct(at.cast("int").alias("at"), score.alias("score"), kind.alias("kind"), matched.alias("matched"))
    hits = named.select("key", "base", hit(F.col("place") + 5, F.col("score"), F.col("kind"), F.col("query")).alias("x"))
    if facts is not None:
        mine, theirs = facts.withColumnsRenamed({d: f"a_{d}" for d in ("kegg", "hmdb", "chebi", "formula")}), index.drop("names", "species")
        close = (F.col("mass") > 0) & (F.col("m") > 0) & (F.abs(F.col("m") - F.col("mass")) <= F.col("mass") * (ppm / 1e6))
        routes = [F.when(F.col(f"a_{d}") == F.col(d), hit(F.lit(k), F.lit(100.0), F.lit(f"xref:{d}"), no)) for k, d in enumerate(("kegg", "hmdb", "chebi"))]
        routes.append(F.when(formula.canonical(F.col("a_formula")) == formula.canonical(F.col("formula")), hit(F.lit(3), F.lit(95.0), F.lit("formula"), no)))
        routes.append(F.when(close, hit(F.lit(4), of_mass(), F.lit("mass"), no)))
        known = pairs.join(shuffled(mine), "key").join(shuffled(theirs), "base")
        hits = hits.unionByName(known.select("key", "base", F.explode(F.array_compact(F.array(*routes))).alias("x")))
    one = lambda score, kind, matched: F.struct(score.alias("score"), kind.alias("kind"), matched.alias("matched"))
    fold = F.aggregate(
        F.array_sort(F.collect_list("x")), one(F.lit(-1.0), no, no),
        lambda s, x: F.when(x["score"] > s["score"], one(F.round(x["score"], 1), x["kind"], x["matched"])).otherwise(s),
    )
    best = hits.groupBy("key", "base").agg(fold.alias("b")).select("key", "base", "b.*")
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), "base")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def suggest(named: DataFrame, index: DataFrame, most: int = 6) -> DataFrame:
    """Species to consider for each distinct name of named(name), by its normal form and then the spellings of both, in order: key (the name), base, score, kind, matched, rank."""
    spelled = names.normalized(named.select("name").distinct(), "name", "n").select("name", F.col("n.normalized").alias("query"))
    spelled = written(spelled, "names")
    forms = written(variants.expand(spelled.select("name").union(spelled.select("query")).distinct(), "name"), "spellings").select(F.col("name").alias("form"), "variant")
    tries = spelled.select("name", F.explode(F.array("name", "query")).alias("form")).join(forms, "form")
    others = tries.groupBy("name").agg(F.array_sort(F.collect_set("variant")).alias("v")).select(F.col("name").alias("key"), F.posexplode("v").alias("place", "query")).withColumn("place", F.col("place") + 1)
    every = written(spelled.select(F.col("name").alias("key"), F.lit(0).alias("place"), "query").unionByName(others), "tries")
    return search_all(every, None, index, most)


def screen(hits: DataFrame, name: str, hit_name: str, key: str = "key") -> DataFrame:
    """Hits with the verdict on their name against the one asked for, and their place, safest first, else as ranked."""
    judged = verdict.judged(hits, name, hit_name).withColumn("verdict", F.when(F.coalesce(hit_name, F.lit("")) == "", "unknown").otherwise(F.col("v.verdict")))
    w = Window.partitionBy(key).orderBy(verdict.rank(F.col("verdict")), "rank")
    return judged.withColumn("place", F.row_number().over(w)).drop("v")


def collisions(results: DataFrame, active: DataFrame) -> DataFrame:
    """label, mam, n, n_exact, first: species that several entries have under one model's label.

    results: ordinal, label, mam (array), relation, one row per entry and label; active: ordinal,
    label, mam, relation of the model in use, which counts where an entry has no result of that label.
    """
    rest = active.join(results.select("ordinal", "label"), ["ordinal", "label"], "left_anti")
    rows = results.unionByName(rest).select("ordinal", "label", "relation", F.explode("mam").alias("mam"))
    return rows.groupBy("label", "mam").agg(F.count("*").alias("n"), F.count_if(F.col("relation") == "exact").alias("n_exact"), F.min("ordinal").alias("first")).where("n > 1")


def top_dice(queries: DataFrame, index: DataFrame, above: float = 0.4, most: int = 5) -> DataFrame:
    """The plain scorer: Dice of trigrams above a bound, best first, later base first among equals."""
    named = index.select("base", F.explode("names").alias("name"))
    pairs = blocking.dice_join(queries.select("query").distinct(), "query", named, "name", above, extra=["base"])
    best = pairs.groupBy("query", "base").agg(F.max("dice").alias("dice")).withColumn("dice", F.round("dice", 3))
    w = Window.partitionBy("query").orderBy(F.col("dice").desc(), F.col("base").desc())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def within_ppm(asked: DataFrame, index: DataFrame, ppm: float = 25.0) -> DataFrame:
    """asked(key, mass) against species masses within ppm of the asked mass, scored 85 down to 80."""
    out = blocking.range_join(asked, "mass", index.select("base", F.col("mass").alias("m")), "m", ppm / 1e6)
    window = F.col("mass") * (ppm / 1e6)
    return out.select("key", "base", F.round(85.0 - F.abs(F.col("m") - F.col("mass")) / window * 5.0, 1).alias("score"))


def by_formula(asked: DataFrame, index: DataFrame) -> DataFrame:
    return asked.withColumn("canon", formula.canonical(F.col("formula"))).drop("formula").join(index.where("formula is not null").select("base", formula.canonical(F.col("formula")).alias("canon")), "canon")


def same_formula(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Per query, formulas that several of its hits share: isomers that no mass can separate."""
    rows = hits.join(index.where("formula is not null").select("base", formula.canonical(F.col("formula")).alias("canon")), "base")
    return rows.groupBy("query", "canon").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("base")), ";").alias("bases")).where("n > 1")


def log_width(tolerance: float) -> float:
    """Width of logarithmic buckets such that masses within tolerance of a mass are in its bucket or a neighbour."""
    return -math.log1p(-tolerance)

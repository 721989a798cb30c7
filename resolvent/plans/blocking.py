"""Joins that Spark would run as nested loops, turned into equi joins that lose no pair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .written import shuffled, written


def _is_short(c):
    """Fewer letters and digits than a trigram has."""
    return F.length(names.flat(c)) < 3


def _short_key(c):
    """The first three characters of a short name, whatever they are."""
    return F.substring(F.lower(c), 1, 3)


def _runs(c):
    """All runs of at most three characters, the empty one too."""
    low = F.lower(c)

    def of(n: int):
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, every).otherwise(F.array(F.lit("")))

    return F.concat(F.array(F.lit("")), of(1), of(2), of(3))


def _short(left: DataFrame, l_name: str, right: DataFrame, r_name: str) -> DataFrame:
    """Pairs of which one is a name of fewer than three letters and digits, and the other has the first three characters of it."""
    l, r = F.trim(F.col(l_name)), F.col(r_name)
    short_a, short_b = left.where(_is_short(l)), right.where(_is_short(r))
    found = left.select(l_name, F.lit(None).cast("string").alias(r_name)).limit(0)
    if not short_a.isEmpty():
        runs = right.select(r_name, F.explode(F.array_distinct(_runs(r))).alias("_gram"))
        found = found.unionByName(short_a.select(l_name, _short_key(l).alias("_gram")).join(shuffled(runs), "_gram").select(l_name, r_name))
    if not short_b.isEmpty():
        runs = left.select(l_name, F.explode(F.array_distinct(_runs(l))).alias("_gram"))
        found = found.unionByName(shuffled(runs).join(short_b.select(r_name, _short_key(r).alias("_gram")), "_gram").select(l_name, r_name))
    return found


def _ordered(sets: DataFrame, rarity: DataFrame) -> DataFrame:
    """sets (id, set) -> id, n, ordered: its members from the rarest on; what rarity (g, c) doesn't have comes first."""
    each = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("g"))
    each = shuffled(each).join(rarity, "g", "left")
    return each.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("ordered"))


def set_join(left: DataFrame, right: DataFrame, least: float, of: str = "dice") -> DataFrame:
    """(l, r): pairs of ids of sets (id, set; ids distinct) whose Dice (or Jaccard, of="jaccard") coefficient can be `least` or more, none lost.

    Sets are ordered by the rarity of their members on the right. Two sets that are alike enough share one
    of the first n - need + 1 members of each, need being the least overlap at the length of either alone; so commoner
    members are no keys at all. Of pairs that meet, those go whose lengths differ too much, or whose
    members after the first common one are too few for the overlap that both lengths ask for.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    part = least / (2 - least) if of == "dice" else least
    joint = least / 2 if of == "dice" else least / (1 + least)
    up = lambda c: F.ceil(c - 1e-9)
    rarity = right.select(F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("c"))

    def keys(sets: DataFrame, name: str) -> DataFrame:
        prefix = F.slice("ordered", 1, (F.col("n") - up(F.col("n") * part) + 1).cast("int"))
        return _ordered(sets, rarity).select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.posexplode(prefix).alias(f"at_{name}", "x")).select(name, f"n_{name}", f"at_{name}", F.col("x.g").alias("g"))

    met = keys(left, "l").join(shuffled(keys(right, "r")), "g").where((F.col("n_l") >= F.col("n_r") * part - 1e-9) & (F.col("n_r") >= F.col("n_l") * part - 1e-9))
    first = met.groupBy("l", "r").agg(F.first("n_l").alias("n_l"), F.first("n_r").alias("n_r"), F.min("at_l").alias("i"), F.min("at_r").alias("j"))
    return first.where(F.least(F.col("n_l") - F.col("i"), F.col("n_r") - F.col("j")) >= up((F.col("n_l") + F.col("n_r")) * joint)).select("l", "r")


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): pairs of texts of which the large contains the small, met through the small one's rarest trigram of letters and digits; texts without one aren't met.

    small, large: text, and low, what is compared.
    """
    grams = large.select(F.col("text").alias("large"), F.col("low").alias("_large"), F.explode(names.grams(F.col("low"))).alias("g"))
    rarity = grams.groupBy("g").agg(F.count("*").alias("c"))
    each = small.select(F.col("text").alias("small"), F.col("low").alias("_small"), F.explode(names.grams(F.col("low"))).alias("g"))
    each = shuffled(each).join(rarity, "g", "left")
    rarest = each.groupBy("small", "_small").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))["g"].alias("g"))
    return rarest.join(shuffled(grams), "g").where(F.contains("_large", "_small")).select("small", "large").distinct()


def like_names(left: DataFrame, l_name: str, right: DataFrame, r_name: str, least: float) -> DataFrame:
    """Distinct pairs of names among which are all that names.text_score gives `least` or more (over 10): by what each of its routes needs for that.

    Trigrams alike (a Dice coefficient of least / 60, or 0.8 if that is less), words alike (a Jaccard coefficient of
    (least - 10) / 60), or one text in the other; left names are trimmed for that.
    """
    if least <= 10:
        raise ValueError("least must be over 10: nearly every pair of names scores that")
    a = written(left.select(l_name).distinct().withColumn("low", F.lower(F.trim(l_name))), "asked")
    n = written(right.select(F.col(r_name).alias("id")).distinct(), "named")
    sets = lambda df, c, f: df.select("id", f(F.col(c)).alias("set")).where("size(set) > 0")
    q = a.select(F.col("low").alias("id")).distinct()
    dice, words = min(least / 60, 0.8), min(max((least - 10) / 60, 1e-6), 1.0)
    found = set_join(sets(q, "id", names.grams), sets(n, "id", names.grams), dice)
    bare = n.where(F.col("id").contains("("))
    found = found.union(set_join(sets(q, "id", names.grams), sets(bare, "id", lambda c: names.grams(names.without_brackets(c))), dice))
    found = found.union(set_join(sets(q, "id", names.tokens), sets(n, "id", names.tokens), words, "jaccard"))
    text = lambda df, l: df.select(F.col("id").alias("text"), l.alias("low"))
    asked, named = text(q, F.col("id")), text(n, F.lower("id"))
    found = found.union(contained(asked, named)).union(contained(named, asked).select("large", "small"))
    met = found.toDF("low", r_name).distinct().join(shuffled(a), "low").select(l_name, r_name)
    return met.unionByName(_short(a.select(l_name), l_name, n.select(F.col("id").alias(r_name)), r_name)).distinct()


def like_ids(left: DataFrame, l_name: str, right: DataFrame, base: str, ids: str) -> DataFrame:
    """Distinct pairs of a name and (base, ids) among which are all that names.id_score gives more than nothing: the name is one of the ids, or base contains it."""
    a = written(left.select(l_name).distinct().withColumn("low", F.lower(F.trim(l_name))), "asked")
    b = right.select(base, ids).distinct()
    own = b.select(base, ids, F.explode(F.array_distinct(F.concat(F.array(F.lower(base)), F.split(F.lower(ids), " ")))).alias("low"))
    same = a.join(shuffled(own), "low").select(l_name, base, ids)
    text = b.select(F.col(base).alias("text"), F.lower(base).alias("low")).distinct()
    inside = contained(a.select(F.col("low").alias("text"), "low").distinct(), text).toDF("low", base).join(shuffled(a), "low").select(l_name, base)
    inside = inside.unionByName(_short(a.where(_is_short(F.trim(l_name))).select(l_name), l_name, b.select(base).distinct(), base))
    return same.unionByName(inside.join(shuffled(b), base).select(l_name, base, ids)).distinct()


def may_score(left: DataFrame, l_name: str, right: DataFrame, r_name: str, extra: list[str], least: float) -> DataFrame:
    """Distinct pairs among which are all that names.name_score gives `least` or more (over 10). extra: the columns of the base id and of the species ids."""
    b = right.select(r_name, *extra).distinct()
    met = like_names(left, l_name, b, r_name, least).join(shuffled(b), r_name).select(l_name, r_name, *extra)
    return met.unionByName(like_ids(left, l_name, b, *extra).join(shuffled(b), extra).select(l_name, r_name, *extra)).distinct()


def dice_join(left: DataFrame, l_name: str, right: DataFrame, r_name: str, above: float, extra: list[str]) -> DataFrame:
    """Pairs with a Dice coefficient of trigram sets above a bound (0 or more), counted from the shared trigrams."""
    a = left.select(l_name, names.grams(F.col(l_name)).alias("_g")).select(l_name, F.size("_g").alias("_na"), F.explode("_g").alias("_gram"))
    b = right.select(r_name, *extra, names.grams(F.col(r_name)).alias("_g")).select(r_name, *extra, F.size("_g").alias("_nb"), F.explode("_g").alias("_gram"))
    shared = a.join(b, "_gram").groupBy(l_name, r_name, *extra).agg(F.count("*").alias("_n"), F.min("_na").alias("_na"), F.min("_nb").alias("_nb"))
    return shared.withColumn("dice", 2.0 * F.col("_n") / (F.col("_na") + F.col("_nb"))).where(F.col("dice") > above).drop("_n", "_na", "_nb")


def range_join(left: DataFrame, l_value: str, right: DataFrame, r_value: str, tolerance: float) -> DataFrame:
    """Pairs of positive values with |right - left| <= left * tolerance: logarithmic buckets and their neighbours."""
    width = -math.log1p(-tolerance)
    at = lambda c: F.floor(F.log(F.col(c)) / width)
    a = left.where(F.col(l_value) > 0).withColumn("_b", F.explode(F.array(at(l_value) - 1, at(l_value), at(l_value) + 1)))
    b = right.where(F.col(r_value) > 0).withColumn("_b", at(r_value))
    return a.join(b, "_b").where(F.abs(F.col(r_value) - F.col(l_value)) <= F.col(l_value) * tolerance).drop("_b")

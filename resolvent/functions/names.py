"""Name columns: normal forms, tokens, character grams, similarity, non-biological cues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import GREEK, SALTS, XENOBIOTICS


def strip(c: Column) -> Column:
    """Without white space at the ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def spelled_greek(c: Column) -> Column:
    return reduce(lambda x, g: F.replace(x, F.lit(g), F.lit(GREEK[g])), GREEK, c)


_ACRONYM = r"^([A-Za-z0-9]{2,7})\s*\((.{3,})\)$"
_NO_TEXTS = "cast(array() as array<string>)"


def normalized(df: DataFrame, name: str, out: str) -> DataFrame:
    """df with the column `out`: struct(normalized, key, parenthetical, alternatives, flags) of a reported name.

    A short capital acronym before its expansion in brackets gives way to the expansion; other
    brackets stay. Parts of combined names, the acronym and closed-up conjugates are alternatives.
    Each step is a column of its own that the next one reads, so nothing is computed twice.
    """
    columns = df.columns
    n = {k: f"_{out}_{k}" for k in ("s", "acronym", "is_acronym", "expansion", "inner", "base", "equals", "slash", "display")}
    c = {k: F.col(v) for k, v in n.items()}

    def parts(mark: str) -> Column:
        found = F.filter(F.transform(F.split(c["base"], mark, -1), strip), lambda x: x != "")
        return F.when(c["base"].contains(mark), found).otherwise(F.expr(_NO_TEXTS))

    several = lambda k: F.when(F.size(c[k]) > 1, c[k]).otherwise(F.expr(_NO_TEXTS))
    low = F.lower(c["base"])
    cut = lambda salt: strip(F.substring(c["base"], F.lit(1), F.length(c["base"]) - len(salt) - 1))
    display = reduce(lambda other, salt: F.when(low.endswith(" " + salt), cut(salt)).otherwise(other), reversed(SALTS), c["base"])
    spaced = {x: c["display"].rlike(f"(?i)[ -]{x}$") for x in ("carnitine", "coa")}
    closed = F.array_compact(F.array(*[F.when(v, F.regexp_replace(c["display"], f"(?i)[ -]{x}$", x)) for x, v in spaced.items()]))
    alternatives = F.concat(F.when(c["is_acronym"], F.array(c["acronym"], c["s"])).otherwise(F.expr(_NO_TEXTS)), several("equals"), several("slash"), closed)
    flags = F.array(
        F.when(c["is_acronym"], F.lit("abbrev_parenthetical")),
        F.when((F.size(c["equals"]) > 1) | (F.size(c["slash"]) > 1), F.lit("combined_name")),
        F.when(c["display"] != c["base"], F.lit("salt_stripped")),
        F.when(c["base"].rlike(_LOCANT), F.lit("has_digit_locant")),
        F.when(spaced["carnitine"] | spaced["coa"], F.lit("conjugate_spacing")),
        F.when(c["display"].rlike(r"(?i)\bcarnitine\b"), F.lit("acylcarnitine")),
    )
    aside = F.when(c["is_acronym"], c["expansion"]).when((F.length(c["inner"]) > 2) & ~c["inner"].rlike(r"^[RSrs+\-,/ ]+$"), c["inner"])
    steps = [
        {"s": _spaced_once(F.col(name))},
        {"acronym": F.regexp_extract(c["s"], _ACRONYM, 1), "expansion": strip(F.regexp_extract(c["s"], _ACRONYM, 2)), "inner": strip(F.regexp_extract(c["s"], r"\(([^)]+)\)", 1))},
        {"is_acronym": _is_acronym(c["acronym"])},
        {"base": F.when(c["is_acronym"], c["expansion"]).otherwise(c["s"])},
        {"equals": parts("="), "slash": parts("/"), "display": display},
    ]
    for step in steps:
        df = df.withColumns({n[k]: v for k, v in step.items()})
    whole = F.struct(c["display"].alias("normalized"), F.lower(c["display"]).alias("key"), aside.alias("parenthetical"), F.array_sort(F.array_distinct(alternatives)).alias("alternatives"), F.array_sort(F.array_compact(flags)).alias("flags"))
    return df.select(*[F.col(f"`{x}`") for x in columns], whole.alias(out))


_LOCANT = r"\b\d+[- ]"


def _spaced_once(c: Column) -> Column:
    return F.regexp_replace(strip(spelled_greek(strip(c))), r"(?U)\s+", " ")


def _is_acronym(c: Column) -> Column:
    return (c != "") & (F.upper(c) == c) & c.rlike("[A-Z]")


def has_locant(c: Column) -> Column:
    """The has_digit_locant flag of normalized() alone: no other part of the normal form is computed for it."""
    s = _spaced_once(c)
    return F.when(_is_acronym(F.regexp_extract(s, _ACRONYM, 1)), strip(F.regexp_extract(s, _ACRONYM, 2))).otherwise(s).rlike(_LOCANT)


def query_name(normalized: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(normalized, F.lit("")), original)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def flat(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def grams(c: Column, n: int = 3) -> Column:
    """The set of character n-grams of the letters and digits; empty below n characters."""
    s = flat(c)
    return F.when(F.length(s) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.expr("cast(array() as array<string>)"))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def without_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\([^)]*\)", " ")


def contaminant_tags(c: Column) -> Column:
    """Sorted tags of the non-biological classes that a name shows."""
    low = F.lower(c)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(tag)) for p, tag, _ in XENOBIOTICS]))))


def contaminant_origin(c: Column) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(origin)) for p, _, origin in XENOBIOTICS])


def name_parts(c: Column) -> Column:
    """What name_score needs of a name, to be computed once per name: struct(low, grams, bare, tokens)."""
    return F.struct(F.lower(c).alias("low"), grams(c).alias("grams"), grams(without_brackets(c)).alias("bare"), tokens(c).alias("tokens"))


def _best(routes: list[tuple[int, str, Column]]) -> Column:
    return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("order"), F.lit(kind).alias("kind")) for k, kind, s in routes]))


def _id_routes(ql: Column, base: Column, ids: Column) -> list[tuple[int, str, Column]]:
    bl = F.lower(base)
    same_id = (ql == bl) | F.array_contains(F.split(F.lower(ids), " "), ql)
    return [(0, "id-exact", F.when(same_id, 96.0).otherwise(0.0)), (1, "id-substring", F.when(~same_id & bl.contains(ql), 60.0 + 20.0 * F.length(ql) / F.length(bl)).otherwise(0.0))]


def _text_routes(q: Column, n: Column) -> list[tuple[int, str, Column]]:
    ql, nl = q["low"], n["low"]
    ratio = F.least(F.length(ql), F.length(nl)) / F.greatest(F.length(ql), F.length(nl))
    d = F.greatest(dice(q["grams"], n["grams"]), dice(q["grams"], n["bare"]))
    qt, nt = q["tokens"], n["tokens"]
    return [
        (2, "name-exact", F.when(ql == nl, 100.0).otherwise(0.0)),
        (3, "name-substring", F.when((ql != nl) & (nl.contains(ql) | ql.contains(nl)), 50.0 + 35.0 * ratio).otherwise(0.0)),
        (4, "name-tokens", F.when((ql != nl) & (F.size(qt) > 0) & (F.size(nt) > 0), 60.0 * jaccard(qt, nt) + F.when(subset(qt, nt), 10.0).otherwise(0.0)).otherwise(0.0)),
        (5, "name-trigram", F.when(ql != nl, F.when(d > 0.8, 100.0 * d).otherwise(60.0 * d)).otherwise(0.0)),
    ]


def id_score(ql: Column, base: Column, ids: Column) -> Column:
    """The part of name_score that a species' own ids give a lower-case query, whatever its names."""
    return _best(_id_routes(ql, base, ids))


def text_score(q: Column, n: Column) -> Column:
    """The part of name_score that a name gives, whichever species carry it."""
    return _best(_text_routes(q, n))


def name_score(q: Column, n: Column, base: Column, ids: Column) -> Column:
    """struct(score, order, kind) of a model species for a query, from the name_parts of both, its base id and its species ids, joined by spaces: the best route; the earlier of equals."""
    return _best(_id_routes(q["low"], base, ids) + _text_routes(q, n))

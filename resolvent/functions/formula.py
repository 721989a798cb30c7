"""Formula and mass columns. Masses are monoisotopic, in Da."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import ADDUCTS, AVERAGE_MASS, MONO_MASS


def parses(c: Column) -> Column:
    """Whether a formula is a plain sequence of known elements and counts."""
    known = "|".join(sorted(MONO_MASS, key=lambda x: (-len(x), x)))
    return c.rlike(f"^(?:(?:{known})[0-9]*)+$")


def counts(c: Column) -> Column:
    """A plain formula as an array of (element, count), each element once: C, H, then by letter; without carbon, all by letter."""
    parts = F.regexp_extract_all(c, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    one = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z]+", 0).alias("e"), F.coalesce(F.nullif(F.regexp_extract(x, "[0-9]+$", 0), F.lit("")), F.lit("1")).cast("int").alias("n")))
    organic = F.exists(one, lambda x: x["e"] == "C")
    order = lambda e: F.when(organic & (e == "C"), "0").when(organic & (e == "H"), "1").otherwise(F.concat(F.lit("2"), e))
    kinds = F.array_sort(F.array_distinct(F.transform(one, lambda x: F.struct(order(x["e"]).alias("o"), x["e"].alias("e")))))
    return F.transform(kinds, lambda k: F.struct(k["e"].alias("e"), F.aggregate(F.filter(one, lambda x: x["e"] == k["e"]), F.lit(0), lambda s, x: s + x["n"]).alias("n")))


def canonical(c: Column) -> Column:
    """Elements in Hill order with their counts; in capitals as it is where it isn't a plain formula."""
    c = F.trim(c)
    return F.when(parses(c), F.array_join(F.transform(counts(c), lambda x: F.concat(x["e"], F.when(x["n"] > 1, x["n"].cast("string")).otherwise(""))), "")).otherwise(F.upper(c))


def _mass(c: Column, of: dict[str, float]) -> Column:
    masses = F.create_map(*[F.lit(x) for e, m in of.items() for x in (e, m)])
    return F.when(parses(c), F.aggregate(counts(c), F.lit(0.0), lambda s, x: s + masses[x["e"]] * x["n"]))


def mono_mass(c: Column) -> Column:
    return _mass(c, MONO_MASS)


def average_mass(c: Column) -> Column:
    return _mass(c, AVERAGE_MASS)


def is_pool(c: Column) -> Column:
    """Whether a formula has a placeholder: R or X that starts no element's name."""
    return c.rlike("[RX](?![a-z])")


def verify(proposed: Column, observed: Column, observed_mass: Column, tolerance: float = 15.0) -> Column:
    """struct(formula_match, ppm_error, mass_match); null where it can't be told."""
    both = parses(proposed) & parses(observed)
    mass = mono_mass(proposed)
    ppm = (observed_mass - mass) / mass * 1e6
    return F.struct(F.when(both, canonical(proposed) == canonical(observed)).alias("formula_match"), ppm.alias("ppm_error"), (F.abs(ppm) <= tolerance).alias("mass_match"))


def neutral_masses(mz: Column, adducts: list[str], tolerance: float = 15.0) -> Column:
    """An array of (adduct, neutral_mono_mass, mass_low, mass_high); unknown adducts are left out."""
    rows = []
    for a in adducts:
        if a in ADDUCTS:
            m = mz - ADDUCTS[a]
            w = m * tolerance / 1e6
            rows.append(F.struct(F.lit(a).alias("adduct"), F.round(m, 5).alias("neutral_mono_mass"), F.round(m - w, 5).alias("mass_low"), F.round(m + w, 5).alias("mass_high")))
    return F.array(*rows)

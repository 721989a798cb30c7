"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every measurement is taken once per row, inside the row: no shuffle, no Python. Every rule is
evaluated once and sets its bit in `failures` if the row fails it. A policy is a version name and
the rules it enforces; verdicts and ablations are bit operations on the ledger, so a new policy
needs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts

REPEAT = 5
_GAP, _SYMBOL = "[\\x20\\x09-\\x0D]+", "[#*$%&|<>]"

#: Rules in the order of their bits: the row fails where the condition on its measurements holds.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 10,
    "repeated_words": lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
    "word_length": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    "symbols": lambda: 2 * F.col("n_symbols") > F.col("n_words"),
    "repeated_lines": lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    "exclamations": lambda: 2 * F.col("n_exclamations") > F.col("n_words"),
}
#: Policies by version. `base` is what every later one contains.
POLICIES = {"base": ("few_words", "repeated_words"), "2": ("few_words", "repeated_words", "symbols"), "3": tuple(RULES)}
CURRENT = "3"


def mask(policy: str) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in POLICIES[policy])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in windows of REPEAT words that are found twice or more; rows without such a window stop at the count of distinct windows."""
    hashes = _let(words, lambda w: F.when(F.size(w) < REPEAT, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - REPEAT, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(REPEAT)]))))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = _let(order, lambda o: F.filter(F.transform(o, lambda x, k: F.when((x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]), x["i"])), lambda p: p.isNotNull()))
        total = F.aggregate(F.array_sort(repeated), F.struct(F.lit(-REPEAT).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(REPEAT), p - s["last"])).alias("n")), lambda s: s["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(total)

    return _let(hashes, covered)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failures` (bits of RULES) of each row's whole text.

    Null, empty and wordless texts measure zero throughout, and fail few_words alone. Windows are
    told apart by 64-bit hashes within a text. Repeated rows give equal rows.
    """
    rows = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE))
    rows = rows.select("doc_id", "t", F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, _GAP)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    number = lambda c, name: c.cast("long").alias(name)
    measured = rows.select(
        "doc_id",
        number(F.size("w"), "n_words"),
        number(F.length(F.array_join("w", "")), "word_chars"),
        number(F.length("t") - F.length(F.regexp_replace("t", _SYMBOL, "")), "n_symbols"),
        _let(lines, lambda x: F.struct(number(F.size(x), "n"), number(F.size(x) - F.size(F.array_distinct(x)), "dup"))).alias("lines"),
        number(F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit(""))), "n_exclamations"),
        number(_repeat_words(F.col("w")), "n_repeat_words"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_exclamations", "n_repeat_words")
    bits = sum((F.when(rule(), 1 << k).otherwise(0) for k, rule in enumerate(RULES.values())), F.lit(0))
    return measured.withColumn("failures", bits.cast("long"))


def fails(policy: str) -> Column:
    return F.col("failures").bitwiseAND(mask(policy)) != 0


def judge(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed (policy `base`) and kept (neither `base` nor the given policy fails)."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails("base").alias("base_failed"), (~(fails("base") | fails(policy))).alias("kept"), "failures"
    )


def ablated(docs: DataFrame) -> DataFrame:
    """What each rule of each policy removes of docs, and what it alone removes."""
    return ablation(ledger(docs))


def ablation(found: DataFrame) -> DataFrame:
    """policy, rule, n_failed and n_only (rows that this rule alone removes) from a ledger.

    The ledger is counted by its bits first: at most 2**len(RULES) rows go on, whatever its size.
    """
    counts = found.groupBy("failures").agg(F.count("*").alias("n"))
    cases = F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask")) for p in POLICIES for k, name in enumerate(RULES) if name in POLICIES[p]])
    rows = counts.select("failures", "n", F.explode(cases).alias("c"))
    hit = F.col("failures").bitwiseAND(F.col("c.bit")) != 0
    only = F.col("failures").bitwiseAND(F.col("c.mask")) == F.col("c.bit")
    return rows.groupBy("c.policy", "c.rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tok AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
gram AS (SELECT r, p, x, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c, lead(x, 3) OVER o AS e, lead(x, 4) OVER o AS f FROM tok WINDOW o AS (PARTITION BY r ORDER BY p)),
seen AS (SELECT r, p, CASE WHEN f IS NOT NULL AND count(*) OVER (PARTITION BY r, x, b, c, e, f) > 1 THEN 1 ELSE 0 END AS twice FROM gram),
rep AS (SELECT r, sum(hit) AS n FROM (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM seen) GROUP BY r),
m AS (SELECT d.doc_id, len(w.w) AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS word_chars,
             length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(d.t) - length(replace(d.t, '!', '')) AS n_exclamations,
             len(w.lines) AS n_lines, len(w.lines) - len(list_distinct(w.lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
              + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_symbols > n_words THEN 8 ELSE 0 END)
              + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_exclamations > n_words THEN 32 ELSE 0 END) AS failures FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures::BIGINT AS failures FROM b
"""

ABLATION_ORACLE = f"""
WITH led AS (SELECT failures FROM ({ORACLE})),
rule(policy, rule, bit, mask) AS (VALUES {", ".join(f"('{p}', '{name}', {1 << k}, {mask(p)})" for p in POLICIES for k, name in enumerate(RULES) if name in POLICIES[p])})
SELECT policy, rule, sum(CASE WHEN failures & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed, sum(CASE WHEN failures & mask = bit THEN 1 ELSE 0 END)::BIGINT AS n_only
FROM led CROSS JOIN rule GROUP BY policy, rule
"""

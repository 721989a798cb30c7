"""Whole JSON ledgers as tables and back: entries, candidates, decisions, flags, and whatever else they hold.

A field becomes a typed column where its value has the column's type. All else, known or not, stays as
VARIANT in `rest`, so nothing is lost: to_json(tables(x)) equals x, upgraded. A ledger is one JSON
object and is parsed by one task; ledgers are read side by side, each under the name of its run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.written import written

SCHEMA = 2
#: Text columns of each table. Of entries, `accepted` (texts by name) and `gem_mam` (list of texts) are typed too.
TEXT = {
    "entries": ["original_name", "normalized", "final_class", "confidence", "origin", "gem_relation", "gem_model"],
    "candidates": ["source", "kegg", "hmdb", "chebi", "pubchem", "inchikey", "name", "formula"],
    "decisions": ["action", "rationale", "ts"],
}
#: What an entry of version 2 has at least.
DEFAULTS = {"gem": "{}", "gem_candidates": "[]", "gem_relation": "null", "gem_model": "null", "gem_curated": "false"}
_FIELDS, _ITEMS = "map<string, variant>", "array<variant>"


def _no_fields() -> Column:
    return F.parse_json(F.lit("{}")).cast(_FIELDS)


def _no_items() -> Column:
    return F.parse_json(F.lit("[]")).cast(_ITEMS)


def read(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's name), value: the text of every ledger under a path."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("run"), "value")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_text(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _fields(v: Column) -> Column:
    return F.when(F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), v.cast(_FIELDS))


def _items(v: Column) -> Column:
    return F.when(F.coalesce(_kind(v).startswith("ARRAY"), F.lit(False)), v.cast(_ITEMS))


def _variant(c: Column) -> Column:
    return F.parse_json(F.to_json(c))


def _lifted(df: DataFrame, fields: str, texts: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """df with the texts of a field map as columns, in place of the map the rest of it; lists: names that other tables hold."""
    f = F.col(fields)
    out = df.withColumns({t: F.when(_is_text(f[t]), f[t].cast("string")) for t in texts})
    return out.withColumn("rest", F.map_filter(fields, lambda k, v: ~(k.isin(texts) & _is_text(v)) & ~k.isin(list(lists)))).drop(fields)


def tables(ledgers: DataFrame, ts: str = "") -> dict[str, DataFrame]:
    """ledgers (run, value) -> meta, entries, candidates, decisions, flags; version 1 is upgraded as of ts.

    meta: run, rest (every other field of the ledger, its version and the upgrade's report included).
    entries: run, feature_id, texts, accepted, gem_mam, holds (which lists it had), rest.
    candidates, decisions: run, feature_id, position, texts, rest. flags: run, feature_id, flag, rest.
    A list or flag record of another shape than the reference's stays in its entry's rest. Null and
    empty texts are ledgers without entries; text that isn't JSON is an error.
    """
    whole = ledgers.select("run", F.coalesce(_fields(F.parse_json(F.when(F.trim("value") != "", F.col("value")))), _no_fields()).alias("top"))
    whole = whole.withColumn("was", F.coalesce(F.try_variant_get(F.col("top")["schema_version"], "$", "int"), F.lit(1)))
    entry = whole.select("run", "was", F.explode(F.coalesce(_fields(F.col("top")["entries"]), _no_fields())).alias("feature_id", "e")).select("run", "was", "feature_id", F.coalesce(_fields(F.col("e")), _no_fields()).alias("f"))
    old = F.col("was") < SCHEMA
    f = F.col("f")
    # version 1: bare names of flags become records, missing fields get their defaults, base ids lose a dangling mark
    names = F.filter(F.coalesce(_items(f["_flags"]), _no_items()), _is_text)
    record = F.parse_json(F.to_json(F.struct(F.array(F.struct(F.lit(ts).alias("ts"), F.lit("migration").alias("tool"), F.lit("carried over from schema v1").alias("evidence"))).alias("raised"))))
    record = _variant(F.map_concat(record.cast(_FIELDS), F.map_from_arrays(F.array(F.lit("acknowledged")), F.array(F.parse_json(F.lit("null"))))))
    had = F.coalesce(_fields(f["flags"]), _no_fields())
    carried = F.map_from_entries(F.transform(F.array_except(F.array_distinct(F.transform(names, lambda x: x.cast("string"))), F.map_keys(had)), lambda x: F.struct(x, record)))
    defaults = F.map_from_arrays(F.array(*map(F.lit, DEFAULTS)), F.array(*[F.parse_json(F.lit(v)) for v in DEFAULTS.values()]))
    upgraded = F.map_concat(F.map_filter("f", lambda k, v: ~k.isin("_flags", "flags")), F.map_filter(defaults, lambda k, v: ~F.map_contains_key("f", k)), F.map_from_arrays(F.array(F.lit("flags")), F.array(_variant(F.map_concat(had, carried)))))
    entry = entry.withColumn("moved", old & (F.size(names) > 0)).withColumn("f", F.when(old, upgraded).otherwise(f))
    mam = F.when(F.forall(F.coalesce(_items(f["gem_mam"]), _no_items()), _is_text), F.transform(_items(f["gem_mam"]), lambda x: x.cast("string")))
    mended = F.transform(mam, lambda x: F.when(old, F.coalesce(ids.repaired(x), x)).otherwise(x))
    texts_only = lambda v: F.forall(F.map_values(F.coalesce(_fields(v), _no_fields())), _is_text)
    accepted = F.when(texts_only(f["accepted"]), F.transform_values(_fields(f["accepted"]), lambda k, v: v.cast("string")))
    listed = lambda k: _items(f[k]).isNotNull() & F.forall(F.coalesce(_items(f[k]), _no_items()), lambda x: _fields(x).isNotNull())
    flagged = _fields(f["flags"]).isNotNull() & F.forall(F.map_values(F.coalesce(_fields(f["flags"]), _no_fields())), lambda x: _fields(x).isNotNull())
    holds = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in (("candidates", listed("candidates")), ("decisions", listed("decisions")), ("flags", flagged))]))
    entry = entry.withColumns({"gem_mam": mended, "repaired": F.filter(F.arrays_zip(mam.alias("from"), mended.alias("to")), lambda x: x["from"] != x["to"]), "accepted": accepted, "holds": holds})
    entry = written(entry, "entries")  # parsed and upgraded once for the tables that come of it
    lists = {k: entry.where(F.array_contains("holds", k)).select("run", "feature_id", F.col("f")[k].alias("x")) for k in ("candidates", "decisions", "flags")}
    out = {k: _lifted(df.select("run", "feature_id", F.posexplode(_items(F.col("x"))).alias("position", "v")).select("run", "feature_id", "position", _fields(F.col("v")).alias("f")), "f", TEXT[k]) for k, df in lists.items() if k != "flags"}
    out["flags"] = lists["flags"].select("run", "feature_id", F.explode(_fields(F.col("x"))).alias("flag", "v")).select("run", "feature_id", "flag", _fields(F.col("v")).alias("rest"))
    kept = F.map_filter("f", lambda k, v: ~F.array_contains("holds", k) & ~((k == "accepted") & F.col("accepted").isNotNull()) & ~((k == "gem_mam") & F.col("gem_mam").isNotNull()))
    report = entry.groupBy("run").agg(F.count_if("moved").alias("moved"), F.flatten(F.collect_list(F.transform("repaired", lambda x: F.struct(F.col("feature_id"), x["from"].alias("from"), x["to"].alias("to"))))).alias("repaired"))
    out["entries"] = _lifted(entry.withColumn("f", kept).drop("was", "moved", "repaired"), "f", TEXT["entries"])
    step = F.struct(F.lit("1->2").alias("schema"), F.lit(ts).alias("ts"), F.coalesce("moved", F.lit(0)).alias("flag_records_created"), F.coalesce("repaired", F.array()).alias("model_ids_repaired"))
    steps = _variant(F.concat(F.coalesce(_items(F.col("top")["migrations"]), _no_items()), F.array(_variant(step))))
    newer = F.map_from_arrays(F.array(F.lit("schema_version"), F.lit("migrations")), F.array(_variant(F.struct(F.lit(SCHEMA).alias("v"))).cast(_FIELDS)["v"], steps))
    meta = whole.join(report, "run", "left").withColumn("top", F.map_filter("top", lambda k, v: k != "entries"))
    out["meta"] = meta.select("run", F.when(old, F.map_concat(F.map_filter("top", lambda k, v: ~k.isin("schema_version", "migrations")), newer)).otherwise(F.col("top")).alias("rest"))
    return out


def _whole(rest: str, texts: list[str], more: dict[str, Column] | None = None) -> Column:
    """A field map again: the rest, and the columns that aren't null over it."""
    lifted = {t: F.when(F.col(t).isNotNull(), F.col(t).cast("variant")) for t in texts} | (more or {})
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in lifted.items()]), lambda x: x["v"].isNotNull())
    over = F.map_from_entries(pairs)
    return F.map_concat(F.map_filter(rest, lambda k, v: ~F.map_contains_key(over, k)), over)


def to_json(found: dict[str, DataFrame]) -> DataFrame:
    """run, value: each ledger of tables() as one JSON text again."""
    per = {}
    for k in ("candidates", "decisions"):
        one = found[k].select("run", "feature_id", "position", _variant(_whole("rest", TEXT[k])).alias("v"))
        per[k] = one.groupBy("run", "feature_id").agg(_variant(F.transform(F.array_sort(F.collect_list(F.struct("position", F.to_json("v").alias("v")))), lambda x: F.parse_json(x["v"]))).alias(k))
    flag = found["flags"].select("run", "feature_id", F.struct("flag", _variant(F.col("rest")).alias("v")).alias("x"))
    per["flags"] = flag.groupBy("run", "feature_id").agg(_variant(F.map_from_entries(F.collect_list("x"))).alias("flags"))
    e = found["entries"]
    for k, df in per.items():
        e = e.join(df.withColumnRenamed(k, f"_{k}"), ["run", "feature_id"], "left")
    empty = {"candidates": "[]", "decisions": "[]", "flags": "{}"}
    more = {k: F.when(F.array_contains("holds", k), F.coalesce(f"_{k}", F.parse_json(F.lit(v)))) for k, v in empty.items()}
    more |= {k: F.when(F.col(k).isNotNull(), _variant(F.col(k))) for k in ("accepted", "gem_mam")}
    e = e.select("run", F.struct("feature_id", _variant(_whole("rest", TEXT["entries"], more)).alias("v")).alias("x"))
    entries = e.groupBy("run").agg(_variant(F.map_from_entries(F.collect_list("x"))).alias("entries"))
    out = found["meta"].join(entries, "run", "left")
    return out.select("run", F.to_json(F.map_concat("rest", F.map_from_arrays(F.array(F.lit("entries")), F.array(F.coalesce("entries", F.parse_json(F.lit("{}"))))))).alias("value"))

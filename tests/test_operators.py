import random

import pytest
from pyspark.sql import functions as F

from resolvent.operators import audit, collide, report, resolve, sinks, species
from resolvent.plans import blocking
from resolvent.vocab import CAUSES


@pytest.mark.parametrize("in_order", [0, 20, 10**6])
def test_greedy_allocation(spark, in_order):
    rng = random.Random(1)
    rows = [(k % 3, k, sorted(rng.sample("abcdefghij", rng.randint(0, 4)))) for k in range(60)]
    got = {r.ordinal: r.target for r in resolve.allocate(spark.createDataFrame(rows, "run long, ordinal long, targets array<string>"), in_order).collect()}
    taken = {0: set(), 1: set(), 2: set()}
    for run, k, targets in rows:
        want = next((t for t in targets if t not in taken[run]), None)
        taken[run].add(want)
        assert got[k] == want


def test_a_chain_takes_no_round_an_entry(spark):
    rows = [(0, k, [f"t{k - 1}", f"t{k}"] if k else ["t0"]) for k in range(1000)] + [(None, 5, []), (1, 6, None)]
    asked = spark.createDataFrame(rows, "run long, ordinal long, targets array<string>")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {(r.run, r.ordinal): r.target for r in resolve.allocate(asked).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(0, k): f"t{k}" for k in range(1000)} | {(None, 5): None, (1, 6): None}


def test_range_join_loses_no_pair(spark):
    rng = random.Random(2)
    a, b = [rng.uniform(50, 2000) for _ in range(200)], [rng.uniform(50, 2000) for _ in range(200)]
    b += [x * 1.05 for x in a[:20]] + [x * 0.95 for x in a[:20]]
    left = spark.createDataFrame([(k, x) for k, x in enumerate(a)], "i int, x double")
    right = spark.createDataFrame([(k, x) for k, x in enumerate(b)], "j int, y double")
    got = {(r.i, r.j) for r in blocking.range_join(left, "x", right, "y", 0.05).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(y - x) <= x * 0.05}


def test_blocked_plans_have_no_nested_loop(spark):
    n = spark.createDataFrame([("glucose",), ("glucosamine",), ("ab",)], "a string")
    joined = blocking.dice_join(n, "a", n.withColumnRenamed("a", "b"), "b", 0.3, [])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and joined.count() == 4
    masses = spark.createDataFrame([(1, 180.0)], "key int, mass double")
    plan = species.within_ppm(masses, masses.select(F.col("key").alias("base"), "mass"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_top_k_is_limited_before_the_shuffle(spark):
    q = spark.createDataFrame([("glucose",)], "query string")
    m = species.index(spark.createDataFrame([(1, "B1c", "c", "D-Glucose", "C6H12O6", 0, 180.0, None, None, None), (2, "B2c", "c", "Glucosamine", None, 0, 179.0, None, None, None)], "ordinal long, species_id string, compartment string, name string, formula string, charge int, mass double, kegg string, hmdb string, chebi string"))
    found = species.search(q, m, most=1)
    assert [(r.base, r.kind) for r in found.collect()] == [("B1", "name-trigram")] or found.first().base == "B1"
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_search_finds_short_names_inside_words(spark):
    named = [(1, "B1c", "2PGA"), (2, "B2c", "PG"), (3, "B3c", "x--y"), (4, "B4c", "xa-by"), (5, "B5c", "glucose")]
    m = species.index(spark.createDataFrame([(k, s, "c", n, None, 0, 1.0, None, None, None) for k, s, n in named], "ordinal long, species_id string, compartment string, name string, formula string, charge int, mass double, kegg string, hmdb string, chebi string"))
    q = spark.createDataFrame([("PG",), ("3PGA",), ("--",), ("a-b",), ("u",)], "query string")
    got = {(r.query, r.base, r.score) for r in species.search(q, m).collect()}
    assert got >= {("PG", "B1", 67.5), ("3PGA", "B2", 67.5), ("--", "B3", 67.5), ("a-b", "B4", 71.0), ("u", "B5", 55.0)}


def test_crosswalk_takes_the_first_namespace(spark):
    s = spark.createDataFrame([("B1", "C1", None, None), ("B2", None, "HMDB0000002", "CHEBI:3"), ("B3", "C1", None, None)], "base string, kegg string, hmdb string, chebi string")
    a = spark.createDataFrame([(1, "kegg", "C1"), (1, "hmdb", "HMDB0000002"), (2, "chebi", "CHEBI:3"), (3, "kegg", "C9")], "ordinal long, db string, id string")
    assert sorted(tuple(r) for r in resolve.crosswalk(a, s).collect()) == [(1, "kegg", "B1;B3", 2), (2, "chebi", "B2", 1)]


def test_shared_ids(spark):
    h = spark.createDataFrame([(1, "Lc3Cer", "pubchem", "1"), (2, "nLc4Cer", "pubchem", "1"), (3, "Glucose", "kegg", "C1"), (4, " glucose", "kegg", "C1"), (5, "LysoPC(16:0)", "kegg", "C2"), (6, "LysoPC(18:2)", "kegg", "C2")], "ordinal long, name string, db string, id string")
    known = spark.createDataFrame([(5, "kegg", "C2")], "ordinal long, db string, id string")
    assert {(r.id, r.severity) for r in collide.severity(h, known).collect()} == {("1", "collision"), ("C1", "duplicate-name"), ("C2", "class-id-shared")}
    assert {(r.a, r.b, r.verdict) for r in collide.pairs(h).where("id = '1'").collect()} == {("Lc3Cer", "nLc4Cer", "conflict")}


def test_flag_states_and_rollup(spark):
    raised = spark.createDataFrame([(1, "a"), (2, "class_level_id"), (3, "class_level_id"), (4, "class_level_id")], "ordinal long, flag string")
    acked = spark.createDataFrame([(4, "class_level_id")], "ordinal long, flag string")
    holding = spark.createDataFrame([(2, "class_level_id")], "ordinal long, flag string")
    got = {r.ordinal: r.state for r in audit.flag_states(raised, acked, holding).collect()}
    assert got == {1: "open", 2: "open", 3: "self_resolved", 4: "acknowledged"}
    found = spark.createDataFrame([("no_pending", "M1"), ("no_pending", "M2")], "check string, offender string")
    none = spark.createDataFrame([], "check string, fingerprint string")
    e = spark.createDataFrame([(1,)], "ordinal long")
    first = audit.audit(spark, e, found, none)
    assert audit.rollup(first).first().verdict == "warn" and len(audit.LEVELS) == first.count() == 20
    ack = first.where("check = 'no_pending'").select("check", "fingerprint")
    assert audit.rollup(audit.audit(spark, e, found, ack)).first().verdict == "pass"
    more = found.unionByName(spark.createDataFrame([("no_pending", "M3")], "check string, offender string"))
    assert audit.rollup(audit.audit(spark, e, more, ack)).first().verdict == "warn"
    assert [r.check for r in audit.audit(spark, e, more, ack).where("stale").collect()] == ["no_pending"]
    assert [(r.check, r.level) for r in audit.audit(spark, e.where("false"), more, ack).collect()] == [("ingest", "warn")]


def test_class_level_sharing_is_a_warning(spark):
    e = spark.createDataFrame([(1,)], "ordinal long")
    none = spark.createDataFrame([], "check string, fingerprint string")
    level = lambda *x: {r.check: r.level for r in audit.audit(spark, e, spark.createDataFrame([("id_collisions", o) for o in x], "check string, offender string"), none).collect()}["id_collisions"]
    assert level("kegg:C1(class-level)") == "warn" and level("kegg:C1(class-level)", "kegg:C2") == "fail"


def test_acknowledging(spark):
    checks = spark.createDataFrame([("a", "warn", "f"), ("b", "fail", "g"), ("c", "pass", "")], "check string, level string, fingerprint string")
    asked = spark.createDataFrame([("a", "seen and accepted"), ("a", "  too short   "), ("a", None), ("b", "seen and accepted"), ("c", "seen and accepted"), ("d", "seen and accepted")], "check string, why string")
    got = sorted((r.check, r.outcome, r.fingerprint or "") for r in audit.acknowledge(checks, asked).collect())
    assert got == [("a", "acknowledged", "f"), ("a", "the reason is too short", ""), ("a", "the reason is too short", ""), ("b", "a failure can only be mended", ""), ("c", "it passes", ""), ("d", "unknown check", "")]


def test_causes(spark):
    rows = [("Glucse", "a Typo", "?"), ("x", "", "xref bridge (BridgeDb)"), ("x", "BridgeDb promotes it", "?"), ("2-PG/3-PG", "", "?"), ("Phosphoenolpyruvate=PEP", "", "?"), ("GABA", "", "?"), ("Spermine (SPM)", "", "?"), ("Butyryl carnitine", "", "?"), ("glucose-6-phosphate", "", "?"), ("Ortophosphate", "", "?"), ("Urea", "", "?")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, o string, logic string, route string")
    got = [r.c for r in df.select("k", report.cause(F.col("o"), F.col("logic"), F.col("route")).alias("c")).orderBy("k").collect()]
    typo, short, form, synonym, combined, vendor = CAUSES
    assert got == [typo, vendor, vendor, combined, short, short, short, form, form, form, synonym]

def test_coverage_of_nothing(spark):
    e = spark.createDataFrame([], "final_class string, kegg string, hmdb string, relation string")
    assert {(r.value, r.pct) for r in report.coverage(spark, e).collect()} == {(0, 0.0)}


def test_finalize_goes_on_after_a_failure(tmp_path, spark):
    def fail():
        raise ValueError("no")

    df = spark.createDataFrame([("a", None)], "x string, y string")
    got = sinks.finalize({"coverage": fail, "provenance": lambda: sinks.write_tsv(df, f"{tmp_path}/p")}, ["coverage", "provenance", "slides"])
    assert got == {"coverage": "ValueError: no", "provenance": "ok", "slides": "unknown step"}


@pytest.mark.parametrize("term,want", [("glu", ["Glucose", "glue"]), ("gl", ["Glucose", "glue"]), ("x", ["x"]), ("", [])])
def test_substring_search(spark, term, want):
    r = spark.createDataFrame([(0, "Glucose"), (1, "x"), (2, "glue")], "position long, record string")
    assert [x.record for x in resolve.substring_search(spark.createDataFrame([(term,)], "term string"), r).orderBy("rank").collect()] == want


def test_substring_search_broadcasts_no_runs(spark):
    r = spark.createDataFrame([(k, ["blue anvil", "red bolt", "Red Anvil"][k % 3]) for k in range(60)] + [(7, "red bolt")] * 2, "position long, record string")
    got = resolve.substring_search(spark.createDataFrame([("red",), ("an",)], "term string"), r)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(x.term, x.position) for x in got.orderBy("term", "rank").collect()] == [("an", k) for k in (0, 2, 3, 5, 6, 8)] + [("red", k) for k in (1, 2, 4, 5, 7, 8)]


def test_exported_code_runs(spark, tmp_path):
    import json as J
    import os
    import subprocess
    import sys

    from resolvent.operators import export
    from resolvent.registry import ORACLES, QUERIES

    tables = ["part", "lineitem", "events", "customer", "orders", "supplier"]
    found = export.steps(QUERIES | {"without_sql": QUERIES["coverage"]}, ORACLES, ["a17_model_stats", "f6_base_id", "without_sql"])
    assert [n for _, n, _ in found] == ["f6_base_id", "a17_model_stats"]
    (tmp_path / "run.py").write_text(export.script(found, tables))
    if os.path.isdir("/root/testdata/sf0.001"):
        out = subprocess.run([sys.executable, str(tmp_path / "run.py"), "/root/testdata/sf0.001"], capture_output=True, text=True, check=True).stdout
        assert out.split() == ["f6_base_id", "150", "a17_model_stats", "1"]
    assert [c["cell_type"] for c in J.loads(export.notebook(found, tables))["cells"]] == ["code", "markdown", "code", "markdown", "code"]


def test_folded_search(spark):
    rows = [(1, "B1c", "c", "Glucose", "C6H12O6", 0, 180.063, "C1", None, "CHEBI:5"), (2, "B2c", "c", "Galactose", "C6H12O6", 0, 180.064, None, None, None), (3, "B3c", "c", "Urea", "CH4N2O", 0, 60.03, None, "HMDB0000294", None)]
    m = species.index(spark.createDataFrame(rows, "ordinal long, species_id string, compartment string, name string, formula string, charge int, mass double, kegg string, hmdb string, chebi string"))
    spelled = spark.createDataFrame([("a", 0, "glucos"), ("a", 1, "Glucose"), ("b", 0, "b2C"), ("c", 0, " "), ("d", 0, "zzzz")], "key string, place int, query string")
    facts = spark.createDataFrame([("a", None, None, None, None, None), ("b", None, None, None, "C6H12O6", 180.063), ("c", "C1", "HMDB0000294", "5", None, None)], "key string, kegg string, hmdb string, chebi string, formula string, mass double")
    got = {(r.key, r.base): (r.score, r.kind, r.matched) for r in species.search_all(spelled, facts, m).collect()}
    assert got["a", "B1"] == (100.0, "name-exact", "Glucose") and got["b", "B2"] == (96.0, "id-exact", "b2C") and got["b", "B1"] == (95.0, "formula", None)
    assert got["c", "B1"] == (100.0, "xref:kegg", None) and got["c", "B3"] == (100.0, "xref:hmdb", None) and not any(k == "d" for k, _ in got)


def _most_joined(plan) -> int:
    """The most rows that a join of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _most_joined(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _most_joined(plan.plan())
    n = plan.metrics().get("numOutputRows")
    own = n.get().value() if "Join" in plan.nodeName() and n.isDefined() else 0
    return max([own, *[_most_joined(plan.children().apply(k)) for k in range(plan.children().size())]])


def test_folded_search_does_not_pair_all_that_share_a_name_or_formula(spark):
    rows = [(k, f"B{k:03}c", "c", "Glucose", "C6H12O6", 0, 500.0 + k, None, None, "CHEBI:5" if k == 199 else None) for k in range(200)]
    m = species.index(spark.createDataFrame(rows, "ordinal long, species_id string, compartment string, name string, formula string, charge int, mass double, kegg string, hmdb string, chebi string"))
    spelled = spark.createDataFrame([(k, 0, "glucose 1") for k in range(200)], "key int, place int, query string")
    facts = spark.createDataFrame([(k, None, None, "5", "C6H12O6", 500.0 + k) for k in range(200)], "key int, kegg string, hmdb string, chebi string, formula string, mass double")
    got = species.search_all(spelled, facts, m)
    found = {(r.key, r.rank): (r.base, r.score, r.kind) for r in got.collect()}
    assert len(found) == 200 * 25 and all(found[k, 1] == ("B199", 100.0, "xref:chebi") and [found[k, 1 + i] for i in (1, 24)] == [("B000", 95.0, "formula"), ("B023", 95.0, "formula")] for k in range(200))
    assert _most_joined(got._jdf.queryExecution().executedPlan()) < 200 * 60


def test_routing(spark):
    schema = "ordinal long, feature_id string, name string, kegg string, hmdb string, chebi string, pubchem string, inchikey string, final_class string, confidence string, origin string"
    no = [None] * 4
    rows = [
        (1, "M1", "x", "C1", *no, None, None, None), (2, "M2", "x", None, *no, None, None, None), (3, "M3", "Diethyl phthalate", None, *no, "exogenous-excluded", None, None),
        (4, "M4", "x", None, *no, "exogenous", None, None), (5, "M5", "Diethyl phthalate", "C1", *no, "exogenous", "M1", "industrial"), (6, "M6", "x", "C2", *no, None, None, None), (7, "M7", "x", None, *no, "nonsense", None, "mars"),
        (8, "M8", "4-thing 2-", "C1", *no, "KEGG-mapped", None, None),
    ]
    unbacked = spark.createDataFrame([(6,)], "ordinal long")
    got = {r.feature_id: tuple(r)[1:] for r in resolve.route(spark.createDataFrame(rows, schema), unbacked).collect()}
    assert got["M1"] == ("accept", "KEGG-mapped", "M2", "endogenous", "") and got["M2"] == ("accept", "unmapped", "M2", None, "")
    assert got["M3"] == ("exclude", "xenobiotic-excluded", "X", "plasticizer", "") and got["M4"] == ("accept", "exogenous", "M4", None, "exogenous without origin")
    assert got["M5"] == ("accept", "exogenous", "M1", "industrial", "origin implies another class; kept under a non-biological name")
    assert got["M6"][0] == "refused: id without a candidate" and got["M7"][0] == "refused: unknown class" and got["M8"][4] == "locant by a route that isn't exact"


def test_name_warnings(spark):
    h = spark.createDataFrame([(1, "LysoPC(16:0)", "kegg", "C1"), (2, "15-HETE", "kegg", "C2"), (3, "Spermine", "kegg", "C3")], "ordinal long, name string, db string, id string")
    c = spark.createDataFrame([(1, "kegg", "C1", "1-Acyl-sn-glycero-3-phosphocholine"), (2, "kegg", "C2", "5,15-DiHETE"), (3, "kegg", "C3", "Spermine"), (3, "kegg", "C3", "")], "ordinal long, db string, id string, note string")
    assert {(r.ordinal, r.verdict) for r in resolve.name_warnings(h, c).collect()} == {(1, "class-level"), (2, "conflict")}


def test_screen_puts_the_safest_first(spark):
    hits = spark.createDataFrame([("k", "15-HETE", "5,15-DiHETE", 1), ("k", "15-HETE", None, 2), ("k", "15-HETE", "15-HETE", 3)], "key string, name string, gem_name string, rank int")
    assert [(r.rank, r.verdict) for r in species.screen(hits, "name", "gem_name").orderBy("place").collect()] == [(3, "ok"), (1, "conflict"), (2, "unknown")]


@pytest.mark.parametrize("of, least", [("dice", 0.5), ("dice", 0.8), ("dice", 1.0), ("jaccard", 1 / 3), ("jaccard", 0.05)])
def test_set_join_loses_no_pair(spark, of, least):
    rng = random.Random(6)
    pool = [f"g{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(400)]
    sets = [set(rng.sample(pool, rng.randint(1, 14))) for _ in range(120)]
    a, b = [(f"a{k}", sorted(s)) for k, s in enumerate(sets[:60])], [(f"b{k}", sorted(s)) for k, s in enumerate(sets[60:] + sets[:5])]
    met = {(r.l, r.r) for r in blocking.set_join(*[spark.createDataFrame(x, "id string, set array<string>") for x in (a, b)], least, of).collect()}
    shared = lambda x, y: len(set(x) & set(y))
    like = lambda x, y: 2 * shared(x, y) / (len(x) + len(y)) if of == "dice" else shared(x, y) / len(set(x) | set(y))
    want = {(i, j) for i, x in a for j, y in b if like(x, y) >= least - 1e-12}
    assert want <= met and (least < 0.5 or len(met) < sum(shared(x, y) > 0 for _, x in a for _, y in b) / 2)


def test_may_score_finds_what_scores(spark):
    from resolvent.functions import names

    rng = random.Random(12)
    part = ["glucose", "phosphate", "acid", "D", "6", "lyso", "PC", "(16:0)", "(R)", "2", "PG", "acetyl", "-", "spermine", "a", "ß"]
    said = sorted({"".join(rng.choice(["", " ", "-"]) + rng.choice(part) for _ in range(rng.randint(1, 5))).strip() for _ in range(150)})
    q = spark.createDataFrame([(x,) for x in said[:50]] + [("2PGA",), ("pg",), ("B7_c",), ("",), (" glucose ",)], "query string")
    n = spark.createDataFrame([(x, f"B{k}", f"B{k}_c B{k}_m") for k, x in enumerate(said[30:])], "name string, base string, ids string")
    score = names.name_score(names.name_parts(F.trim("query")), names.name_parts(F.col("name")), F.col("base"), F.col("ids"))["score"]
    for least in (20.0, 30.0, 60.0, 95.0):
        want = {(r.query, r.base) for r in q.where("query <> ''").crossJoin(n).where(score >= least).select("query", "base").collect()}
        met = {(r.query, r.base) for r in blocking.may_score(q, "query", n, "name", ["base", "ids"], least).collect()}
        assert want <= met


def test_calls_on_the_model_broadcast_nothing(spark, monkeypatch):
    from resolvent.operators import assign

    seen = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = assign.written
    monkeypatch.setattr(assign, "written", lambda df, name: (seen.append((name, plan(df))), real(df, name))[1])
    m = species.index(spark.createDataFrame([(1, "B1c", "c", "Urea", "CH4N2O", 0, 60.0, "C1", None, None)], "ordinal long, species_id string, compartment string, name string, formula string, charge int, mass double, kegg string, hmdb string, chebi string"))
    asked = spark.createDataFrame([(1, ["B1"], "exact", "reviewed by hand"), (2, ["B1c"], "exact", "reviewed by hand"), (3, ["B9"], "exact", "reviewed by hand")], "ordinal long, mam array<string>, relation string, rationale string")
    entries = spark.createDataFrame([(1, "Urea"), (2, "Urea"), (3, "Urea")], "ordinal long, name string")
    stored = spark.createDataFrame([], "ordinal long, label string, mam array<string>, relation string, rationale string, names array<string>, curated boolean")
    got = assign.assign(asked, entries, m, spark.createDataFrame([(1, "B1"), (2, "B1")], "ordinal long, base string"), stored)
    assert {r.ordinal: (r.action, r.warnings) for r in got.collect()} == {1: ("assigned", []), 2: ("assigned", ["exact elsewhere: B1"]), 3: ("refused: not in the model: B9", [])}
    assert not [name for name, p in [*seen, ("result", plan(got))] if name in ("called", "calls", "result") and "Broadcast" in p]

import http.server
import json
import sys
import threading

import pytest
from pyspark.sql import functions as F

from resolvent import errors
from resolvent.plans import written
from resolvent.sources import outside, readers, settings
from resolvent.sources.store import Conflict, Store
from resolvent.streaming import decisions


def test_names(spark):
    df = spark.createDataFrame([(k, None if k == 2 else f"n{k}") for k in range(50)], "row long, n string").repartition(7)
    got = [(r.ordinal, r.feature_id, r.name) for r in readers.names(df, "n", 5).orderBy("ordinal").collect()]
    assert got == [(5 + k, f"M{5 + k:04d}", n) for k, n in enumerate(f"n{k}" for k in range(50) if k != 2)]


def test_table_with_preamble(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("made by a machine\n\nname\tmz\nglucose\t180\n\nurea\t60\n")
    assert [tuple(r) for r in readers.table(spark, str(tmp_path / "t.tsv"), header_row=2).collect()] == [("glucose", "180"), ("urea", "60")]
    (tmp_path / "q.csv").write_text('x\r\nmy col,b\r\n"a, b",2\r\n')
    out = readers.table(spark, str(tmp_path / "q.csv"), sep=",", header_row=1)
    assert out.columns == ["my col", "b"] and [tuple(r) for r in out.collect()] == [("a, b", "2")]


def test_old_ledger_is_mended(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"entries": {"M0000": {"original_name": "x", "gem_mam": ["tdchola_", "ok"], "_flags": ["class_level_id"]}}}))
    r = readers.ledger(spark, str(tmp_path / "l.json")).first()
    assert (r.feature_id, r.mam, r.flags, r.schema_version, r.migrated) == ("M0000", ["tdchola", "ok"], ["class_level_id"], 2, True)


def test_model(spark, tmp_path):
    (tmp_path / "m.v1.json").write_text(json.dumps({"metabolites": [{"id": "a_c", "compartment": "c", "name": "A", "charge": -1, "annotation": {"kegg.compound": ["C1", "C2"], "hmdb": "HMDB1"}}, {"id": "b_c"}]}))
    a, b = readers.model(spark, str(tmp_path / "m.v1.json")).orderBy("ordinal").collect()
    assert (a.species_id, a.kegg, a.hmdb, a.chebi, a.charge) == ("a_c", ["C1", "C2"], ["HMDB1"], [], -1) and b.kegg == []
    assert readers.model_label("/x/m.v1.json") == "m"


def test_payloads(spark):
    props = json.dumps({"PropertyTable": {"Properties": [{"CID": 5, "MolecularFormula": "C2H7NO3S", "InChIKey": "K", "MonoisotopicMass": "125.01466426"}]}})
    names = json.dumps({"InformationList": {"Information": [{"CID": 5, "Synonym": [f"s{k}" for k in range(30)]}]}})
    hit, miss = readers.compound(spark.createDataFrame([("a", props, names), ("b", None, None)], "query string, properties string, synonyms string")).orderBy("query").collect()
    assert (hit.found, hit.pubchem, hit.mass, len(hit.names)) == (True, "5", 125.01466426, 25) and (miss.found, miss.names) == (False, [])
    found = json.dumps({"response": {"docs": [{"label": "other", "obo_id": "CHEBI:1"}, {"label": "no id"}, {"label": " Taurine", "obo_id": "CHEBI:2"}]}})
    got = readers.term_search(spark.createDataFrame([("taurine", found)], "query string, payload string")).orderBy("place").collect()
    assert [(r.chebi, r.exact) for r in got] == [("CHEBI:2", True), ("CHEBI:1", False)]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    s = Store(spark, f"{tmp_path}/run")
    assert s.revision() == 0 and s.commit({"entries": df}, 0) == 1
    assert s.commit({"entries": df.unionByName(df)}, 1) == 2
    with pytest.raises(Conflict):
        s.commit({"entries": df}, 1)
    assert (s.read("entries").count(), s.read("entries", 1).count()) == (2, 1)


def test_stream_of_decisions(spark, tmp_path):
    rows = [(k, k % 3, ["view", "click"][k % 2]) for k in range(20)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(event_id * 600) ts", "user_id", "event_type", "1.0 value", "'{}' props")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    q = decisions.latest(decisions.read(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.event_id, r.n) for r in spark.table("latest").collect()} == {(0, 18, 7), (1, 19, 7), (2, 17, 6)}
    assert {c for c in decisions.counts(decisions.read(spark, f"{tmp_path}/in")).columns} == {"start", "event_type", "n"}


def test_terms(spark):
    full = {"_embedded": {"terms": [{"label": "taurine", "synonyms": ["2-aminoethanesulfonic acid", ""], "annotation": {"formula": ["x"], "generalized_empirical_formula": ["C2H7NO3S", "y"], "mass": "125.1", "inchi_key_string": []}}]}}
    rows = [("15891", json.dumps(full)), ("CHEBI:2", json.dumps({"_embedded": {"terms": []}})), ("3", None)]
    got = {r.id: r for r in readers.term(spark.createDataFrame(rows, "id string, payload string")).collect()}
    one = got["CHEBI:15891"]
    assert (one.found, one.names, one.formula, one.mass, one.inchikey) == (True, ["taurine", "2-aminoethanesulfonic acid"], "C2H7NO3S", 125.1, None)
    assert not got["CHEBI:2"].found and not got["CHEBI:3"].found and got["CHEBI:3"].names == []


def test_fetch_tells_kinds_of_misses_apart(spark):
    asked = spark.createDataFrame([("KEGG", "C1"), ("kegg", "C2"), ("kegg", "C3"), ("hmdb", "H1"), ("lipidmaps", "L1"), ("kegg", None)], "db string, id string")
    records = {"kegg": spark.createDataFrame([("C1", ["a"], "CH4"), ("C3", ["c"], None)], "id string, names array<string>, formula string")}
    failed = spark.createDataFrame([("kegg", "C3", "exit 1")], "db string, id string, error string")
    got = {r.id: (r.found, r.names, r.note is not None, r.error) for r in readers.fetch(asked, records, failed).collect()}
    assert got == {"C1": (True, ["a"], False, None), "C2": (False, [], False, None), "C3": (False, [], False, "exit 1"), "H1": (False, [], True, None), "L1": (False, [], False, "unsupported db lipidmaps")}


def test_dblinks_and_columns(spark):
    df = spark.createDataFrame([(["PubChem: 1 ", "ChEBI:  2 3", "ChEBI: 4"], 7)], "l array<string>, `my col` int")
    assert df.select(readers.dblink(F.col("l"), "ChEBI").alias("a"), readers.dblink(F.col("l"), "KEGG").alias("b")).first() == ("2 3", None)
    assert [r.name for r in readers.column(df.select("my col")).collect()] == ["7"] == [r.name for r in readers.column(df, "my col").collect()]
    assert spark.createDataFrame([("/a/b.c/M-1.v2.xml",)], "p string").select(readers.model_label_of(F.col("p")).alias("x")).first().x == "M-1" == readers.model_label("/a/b.c/M-1.v2.xml")


def test_sbml(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<sbml xmlns:fbc="f" xmlns:rdf="r"><model><listOfSpecies>
<species id="a_c" name="A" compartment="c" fbc:chemicalFormula="CH4" fbc:charge="-1"><annotation><rdf:li rdf:resource="https://identifiers.org/kegg.compound/C00001"/><rdf:li rdf:resource="https://identifiers.org/kegg.compound/C00002"/><rdf:li rdf:resource="https://identifiers.org/chebi/CHEBI:5"/></annotation></species>
<species id="b_c" name="B"/></listOfSpecies></model></sbml>""")
    a, b = readers.model_xml(spark, str(tmp_path / "m.xml")).orderBy("species_id").collect()
    assert (a.name, a.compartment, a.formula, a.charge, a.kegg, a.chebi, a.hmdb) == ("A", "c", "CH4", -1, ["C00001", "C00002"], ["CHEBI:5"], [])
    assert (b.compartment, b.kegg) == ("", [])


def test_failures():
    f = errors.unknown_entry("M1")
    assert f.row() == {"error": "unknown feature_id M1", "error_code": "unknown_entry", "means": errors.CODES["unknown_entry"], "suggested_next_tools": ["detect_state", "ingest_names"]}
    with pytest.raises(ValueError):
        errors.Failure("no_such_code", "x")


def test_settings(spark, tmp_path):
    assert settings.asset(spark, "model", str(tmp_path)) == str(tmp_path) and settings.asset(spark, "model", f"{tmp_path}/no") is None
    spark.conf.set("spark.resolvent.model", "/given")
    assert settings.asset(spark, "model", str(tmp_path)) == "/given"
    spark.conf.unset("spark.resolvent.model")
    with pytest.raises(errors.Failure):
        outside.http(spark, ["http://localhost:1/x"])


class _Answers(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = b'{"a": 1}' if self.path == "/ok" else b"not json"
        self.send_response(500 if self.path == "/bad" else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_outside(spark, tmp_path):
    server = http.server.HTTPServer(("127.0.0.1", 0), _Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (tmp_path / "p.py").write_text("import json, sys\nr = json.load(sys.stdin)\nprint('noise')\nif r['x'] == 1: json.dump({'y': 2}, open(r['out'], 'w'))\nif r['x'] == 2: sys.exit(3)\n")
    spark.conf.set(settings.OUTSIDE, "true")
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        got = {r.key[len(at) :]: (r.ok, r.payload, bool(r.error)) for r in outside.http(spark, [f"{at}/ok", f"{at}/bad", f"{at}/text"], delay=0).collect()}
        assert got == {"/ok": (True, '{"a": 1}', False), "/bad": (False, None, True), "/text": (False, None, True)}
        asked = spark.createDataFrame([(str(x), json.dumps({"x": x})) for x in (1, 2, 3)], "key string, request string")
        got = {r.key: (r.ok, r.payload, (r.error or "")[:9]) for r in outside.programs(asked, [sys.executable, str(tmp_path / "p.py")]).collect()}
        assert got == {"1": (True, '{"y": 2}', ""), "2": (False, None, "exit 3: "), "3": (False, None, "no answer")}
    finally:
        spark.conf.unset(settings.OUTSIDE)
        server.shutdown()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Spark:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://x:7077"
            getConf = staticmethod(lambda: Spark.conf)

    with pytest.raises(ValueError):
        written.shared_folder(Spark)


def test_ship(spark):
    import zipfile

    from resolvent.ship import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert "resolvent/__init__.py" in names and "resolvent/functions/names.py" in names


def test_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/run")
    row = lambda k, v, c=False: (k, "m", v, c)
    df = lambda *rows: spark.createDataFrame(list(rows), "ordinal long, label string, v string, curated boolean")
    s.commit({"other": df(row(1, "o"))}, 0)
    assert s.merge("t", df(*[row(k, "a", k == 7) for k in range(200)]), ["ordinal", "label"], 1) == 2
    before = s._manifest(2)["t"]
    kept = lambda old, new: old("curated") & ~new("curated")
    assert s.merge("t", df(row(7, "b"), row(8, "b"), row(None, "n"), row(900, "new", True)), ["ordinal", "label"], 2, kept) == 3
    after = s._manifest(3)["t"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 4
    got = {r.ordinal: r.v for r in s.read("t").collect()}
    assert len(got) == 202 and got[7] == "a" and got[8] == "b" and got[None] == "n" and got[900] == "new"
    assert {r.v for r in s.read("t", 2).collect()} == {"a"} and s.read("other").count() == 1
    with pytest.raises(Conflict):
        s.merge("t", df(row(1, "late")), ["ordinal", "label"], 2)
    assert s.merge("t", df(row(None, "again"), row(7, "by hand", True)), ["ordinal", "label"], 3, kept) == 4
    got = {r.ordinal: r.v for r in s.read("t").collect()}
    assert len(got) == 202 and got[None] == "again" and got[7] == "by hand"
    assert s.merge("t", df(), ["ordinal", "label"], 4) == 5 and s.read("t").count() == 202


def test_merge_into_a_table_that_was_written_whole(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/whole")
    df = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    s.commit({"t": df((1, "a"), (2, "a"))}, 0)
    s.merge("t", df((2, "b"), (3, "b")), ["k"], 1)
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "b"), (3, "b")]


def test_flag_states_go_on_after_a_restart(spark, tmp_path):
    """Two runs over one checkpoint give what all decisions give at once; of each kind the last five are remembered."""
    import random

    from resolvent.streaming import flags

    rng = random.Random(4)
    held = spark.createDataFrame([(k, "kegg", f"C{k}") for k in range(6)], "ordinal long, db string, id string")
    rows = [(rng.randint(0, 6), s, rng.choice(["accept", "backcheck", "view", None]) if s > 60 else "backcheck", "kegg", f"C{rng.randint(0, 2)}", rng.choice(["ok", "conflict", "class-level", None]), rng.choice(["class", "species"])) for s in range(120)] + [(None, 500, "accept", "kegg", "C1", None, None)]
    schema = "ordinal long, seq long, action string, db string, id string, verdict string, db_resolution string"
    spark.conf.set(*flags.PROVIDER)

    def run():
        q = flags.states(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), held).writeStream.outputMode("update")
        q.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(rows[:50], schema).write.parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame(rows[50:], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.conf.unset(flags.PROVIDER[0])
    got = {r.ordinal: r for r in flags.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    for k in range(7):
        own = [r for r in rows if r[0] == k and r[2]]
        checks = [r for r in own if r[2] == "backcheck" and k < 6 and r[4] == f"C{k}"]
        if own:
            assert got[k].n == len(own) and got[k].redecided == any(r[2] == "accept" for r in own)
            assert got[k].conflicts == sorted({f"kegg={r[4]}" for r in checks if r[5] == "conflict"}) and got[k].classes == sorted({f"kegg={r[4]}" for r in checks if r[5] == "class-level" or r[6] == "class"})
            assert got[k].history == ";".join(sorted(f"{a}:{','.join(map(str, [r[1] for r in own if r[2] == a][-5:]))}" for a in {r[2] for r in own}))
    assert set(got) == {r[0] for r in rows if r[0] is not None and r[2]}
    said = {tuple(r) for r in flags.as_decisions(spark.createDataFrame([(1, True, ["kegg=C=1"], [], 3, "")], flags.OUTPUT)).collect()}
    assert said == {(1, "accept", None, None, None, None), (1, "backcheck", "kegg", "C=1", "conflict", None)}

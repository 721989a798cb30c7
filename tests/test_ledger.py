"""Whole ledgers: round trips, upgrades, and values of unexpected shape."""

import json

import duckdb

from resolvent.registry import ORACLES, QUERIES
from resolvent.sources import ledger

NOW = {
    "created": "2024-01-01", "schema_version": 2, "revision": 7, "models": {"Recon": "/m.xml"}, "unknown": [1, {"a": None}], "number": 1.25,
    "entries": {
        "M0000": {
            "original_name": "glucose é", "normalized": None, "final_class": "KEGG-mapped", "confidence": 3, "accepted": {"kegg": "C00031", "hmdb": "HMDB0000122"}, "gem_mam": ["a", "b_"], "gem": {"Recon": {"mam": ["a"], "curated": True}},
            "candidates": [{"source": "kegg", "kegg": "C00031", "hmdb": None, "score": 0.5, "deep": {"x": [1, 2]}}, {}, {"source": 5}],
            "decisions": [{"action": "accept", "rationale": "r", "ts": "t", "model": "Recon", "mam": ["a"]}],
            "flags": {"class_level_id": {"raised": [{"ts": "t", "tool": "x", "evidence": "e"}], "acknowledged": None}, "other": {}},
        },
        "M0001": {"original_name": "", "accepted": {"kegg": None}, "candidates": [], "decisions": [], "flags": {}, "gem_mam": []},
        "M0002": {"candidates": "none", "decisions": [1, 2], "flags": ["x"], "accepted": None, "gem_mam": [1]},
        "M0003": {},
    },
}


def frame(spark, *found):
    return spark.createDataFrame([(f"r{k}", x if x is None or isinstance(x, str) else json.dumps(x)) for k, x in enumerate(found)], "run string, value string")


def back(found):
    return {r.run: json.loads(r.value) for r in ledger.to_json(found).collect()}


def test_round_trip(spark, tmp_path):
    found = ledger.tables(frame(spark, NOW, {"schema_version": 2, "entries": {}}))
    assert back(found) == {"r0": NOW, "r1": {"schema_version": 2, "entries": {}}}
    e = {r.feature_id: r for r in found["entries"].collect()}
    assert e["M0000"].accepted == {"kegg": "C00031", "hmdb": "HMDB0000122"} and e["M0000"].gem_mam == ["a", "b_"] and e["M0000"].confidence is None
    assert e["M0002"].holds == [] and e["M0001"].holds == ["candidates", "decisions", "flags"]
    assert sorted((r.position, r.source, r.kegg) for r in found["candidates"].collect()) == [(0, "kegg", "C00031"), (1, None, None), (2, None, None)]
    assert [(r.action, r.rationale) for r in found["decisions"].collect()] == [("accept", "r")]
    assert sorted(r.flag for r in found["flags"].collect()) == ["class_level_id", "other"]
    written = {}
    for k, df in found.items():
        df.write.parquet(f"{tmp_path}/{k}")
        written[k] = spark.read.parquet(f"{tmp_path}/{k}")
    assert back(written)["r0"] == NOW
    changed = dict(found, entries=found["entries"].replace("KEGG-mapped", "exogenous", ["final_class"]))
    assert back(changed)["r0"]["entries"]["M0000"]["final_class"] == "exogenous"


def test_upgrade_keeps_what_is_left_over(spark):
    old = {"created": "c", "odd": {"k": 1}, "migrations": [{"schema": "0->1"}], "entries": {
        "M0000": {"original_name": "x", "_flags": ["class_level_id", "b", "b"], "gem_mam": ["tdchola_", "ok"], "candidates": [{"source": "s", "own": 1}], "more": "m"},
        "M0001": {"flags": {"b": {"raised": [], "acknowledged": "a"}}, "_flags": ["b"], "gem_curated": True},
    }}
    got = back(ledger.tables(frame(spark, old), "now"))["r0"]
    record = {"raised": [{"ts": "now", "tool": "migration", "evidence": "carried over from schema v1"}], "acknowledged": None}
    assert got["schema_version"] == 2 and got["odd"] == {"k": 1} and got["created"] == "c"
    assert got["migrations"] == [{"schema": "0->1"}, {"schema": "1->2", "ts": "now", "flag_records_created": 2, "model_ids_repaired": [{"feature_id": "M0000", "from": "tdchola_", "to": "tdchola"}]}]
    first, second = got["entries"]["M0000"], got["entries"]["M0001"]
    assert first == {"original_name": "x", "gem_mam": ["tdchola", "ok"], "candidates": [{"source": "s", "own": 1}], "more": "m", "flags": {"class_level_id": record, "b": record}, "gem": {}, "gem_candidates": [], "gem_relation": None, "gem_model": None, "gem_curated": False}
    assert second["flags"] == {"b": {"raised": [], "acknowledged": "a"}} and second["gem_curated"] is True and "_flags" not in second


def test_nothing_in_it(spark, tmp_path):
    assert {k: set(v) for k, v in back(ledger.tables(frame(spark, None, "", {"schema_version": 2}))).items()} == {"r0": {"schema_version", "migrations", "entries"}, "r1": {"schema_version", "migrations", "entries"}, "r2": {"schema_version", "entries"}}
    assert all(df.count() == 0 for df in ledger.tables(frame(spark, NOW).where("false")).values())
    (tmp_path / "a.json").write_text(json.dumps(NOW))
    (tmp_path / "b.json").write_text(json.dumps(NOW, indent=2))
    assert back(ledger.tables(ledger.read(spark, str(tmp_path)))) == {"a.json": NOW, "b.json": NOW}


def test_large_keys_tied_lines_and_unknown_events(spark, tmp_path):
    """Runs whose names share their first six digits stay apart, of lines with one seq the first in the table is first, a decision without an action isn't the last."""
    con = duckdb.connect(config={"threads": 1})
    tables = {
        "part": "SELECT x * 100 + y AS p_partkey, 'name ' || y AS p_name FROM (SELECT unnest([0, 1, 1000000, 1000001, 1000002]) AS x), range(4) t(y)",
        "lineitem/0": "SELECT 5 AS l_orderkey, p_partkey AS l_partkey, p_partkey % 7 AS l_suppkey, 1 AS l_linenumber, ['R', 'A', 'N'][1 + (p_partkey + y) % 3] AS l_returnflag, 'F' AS l_linestatus FROM part, range(2) t(y) WHERE p_partkey % 4 < 3",
        "lineitem/1": "SELECT 5 AS l_orderkey, p_partkey AS l_partkey, 3 AS l_suppkey, 1 AS l_linenumber, 'A' AS l_returnflag, 'O' AS l_linestatus FROM part",
        "events": "SELECT p_partkey * 2 + y AS event_id, TIMESTAMP '2024-01-01' AS ts, p_partkey AS user_id, CASE WHEN y = 0 THEN 'signup' WHEN p_partkey % 2 = 0 THEN 'view' ELSE 'other' END AS event_type, '{}' AS props FROM part, range(2) t(y)",
    }
    (tmp_path / "lineitem.parquet").mkdir()
    for k, s in tables.items():
        name, _, file = k.partition("/")
        con.execute(f"COPY ({s}) TO '{tmp_path}/{name}.parquet{f'/{file}.parquet' if file else ''}'")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if file else ''}'")
    got = QUERIES["s4_ledgers"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['s4_ledgers']})").fetchall()
    assert len(want) == 20 and {r[got.columns.index("run")] for r in want} == {"000000", "000001", "100000"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

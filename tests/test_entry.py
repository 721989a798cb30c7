import os
import shutil
import subprocess
import sys

import pytest

from resolvent.registry import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    spark.catalog.clearCache()
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        have = [d[0] for d in cur.description]
        assert sorted(have) == columns
        at = [have.index(c) for c in columns]
        assert got == plain([[r[k] for k in at] for r in cur.fetchall()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="the generated tables are not here")
def test_the_data_reach_every_branch(duck):
    """What the SQL gives, and so what the queries that agree with it give."""
    seen = lambda name, c: {r[0] for r in duck.execute(f'SELECT DISTINCT {c} FROM ({ORACLES[name]})').fetchall()}
    assert {"ambiguous", "taken by another"} <= seen("w3_backfill", "outcome") and duck.execute(f"SELECT count(*) FROM ({ORACLES['k4_unmapped_harmonization']})").fetchone()[0] > 5
    assert all(n > 0 for n in seen("a5_flag_summary", "open")) and {"id_gap_generic_kegg", "id_name_conflicts"} <= seen("g1_g20_offenders", '"check"')
    assert {"class:structure-only", "class:unmapped", "class:exogenous"} <= {r[0] for r in duck.execute(f"SELECT metric FROM ({ORACLES['coverage']}) WHERE value > 0").fetchall()}
    refused = {x.split(": ")[1] for x in seen("gem_assign", "action") if x.startswith("refused")}
    assert refused == {"unknown entry", "unknown relation", "the relation needs a species", "the relation carries no species", "the reason is too short", "not in the model"}
    said = {w.split(": ")[0] for x in seen("gem_assign", "warnings") for w in x.split("; ") if w}
    assert said == {"not among the searched", "pool formula", "conflict", "class level", "thin reason for a stand-in", "exact elsewhere"}
    assert {"conflict", "class-level"} == seen("p7_name_warnings", "verdict") and {"ok", "conflict", "ambiguous"} <= seen("j5_pairwise", "verdict")


def test_imports_without_the_training_data_subpackage(tmp_path):
    for x in ("resolvent", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "resolvent" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'coverage' in e.queries() and not any(k.startswith('op1') for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir(SF):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

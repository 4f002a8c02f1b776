import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from gramweave.plans import queries

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("names", [("__spark_entry__.py", "gramweave"), ("__spark_entry__.py", "gramweave", "corpus_pipeline.py")])
def test_the_rest_imports_without_the_subpackage(tmp_path, names):
    for name in names:
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["find", str(tmp_path / "gramweave"), "-depth", "-path", "*llm*", "-delete"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mem_open' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gramweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")
def test_flagship(spark):
    found = __spark_entry__.entry(spark).collect()
    assert (len(found), max(r.d for r in found), sum(r.d for r in found)) == (3, 309, 779)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    rows = queries.QUERIES[name](spark, str(SMALL))
    sql = queries.ORACLE_SQL[name]
    assert sorted(rows.columns) == sorted(c[0] for c in con.execute(f"describe {sql}").fetchall())
    cols = ", ".join(f'"{c}"' for c in rows.columns)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, con.execute(f"select {cols} from ({sql})").fetchall()))

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_every_query_has_sql_and_no_sql_is_left_over():
    import tessera.queries as q

    assert q.QUERIES.keys() == q.ORACLES.keys()


def test_works_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "tessera"):
        target = tmp_path / name
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(REPO / name, target)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[-2]) >= 60 and out[-1] == "False"


NAMES = ("docs_scan", "tokenize", "positions", "vocab_cf", "postings_list", "fuzzy_join", "spell_obvious", "proximity", "snippets_range", "search_end_to_end")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test data")
    import tessera.queries as q

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    got = q.QUERIES[name](spark, str(folder))
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(columns).collect())
    want = con.sql(f"select {', '.join(columns)} from ({q.ORACLES[name]})").fetchall()
    assert rows == sorted(map(repr, want))

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import DATA
from oracle import connect, same

import __spark_entry__ as entry
from stonegraph.plans import dealt, layers, made, queries

CORE = queries.QUERIES | layers.QUERIES | made.QUERIES | dealt.QUERIES
SQL = queries.ORACLES | layers.ORACLES | made.ORACLES | dealt.ORACLES
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


#: Columns that the test tables leave empty.
ALWAYS_EMPTY = {("p3_readings", "resp"), ("p3_persons", "lang"), ("p3_orig_places", "corresp"), ("p3_orig_places", "parent_element"), ("p3_orig_places", "parent_no")}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    same(CORE[name](spark, str(DATA)), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = CORE[name](spark, str(DATA))
    rows = df.collect()
    assert rows and all(any(r[c] not in (None, '', 0) for r in rows) for c in df.columns if (name, c) not in ALWAYS_EMPTY)


def test_entry(spark):
    assert entry.entry(spark).columns == ["commit", "path", "change"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_the_llm_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in (root / "stonegraph").rglob("*.py"):
        if "llm" not in p.parts:
            assert "stonegraph.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
    code = "import sys; sys.modules['stonegraph.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not any(n.startswith('p9') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)

"""Every query with SQL against DuckDB, over the smallest tables; the others run."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_outside_imports_the_subpackage():
    root = Path(entry.__file__).parent
    for f in (root / "lodeweir").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lodeweir.llm" not in f.read_text()

"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from textmend import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(rows):
    def one(v):
        return "null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.SQL[name]})").fetchall()
    assert norm(df.select(*cols).collect()) == norm(sql)


def test_flagship(spark):
    rows = catalog.correct_documents(spark, SF).collect()
    assert len(rows) == 200 and all(r.total_words is not None for r in rows)

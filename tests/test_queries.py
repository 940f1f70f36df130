"""Every registered query of the core against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tidemark.plans import more_queries  # noqa: F401
from tidemark.plans import queries as Q

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    found = Q.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in found.collect()]
    assert rows
    if name in Q.ORACLE:
        want = duck.sql(Q.ORACLE[name])
        assert sorted(want.columns) == sorted(found.columns)
        columns = sorted(found.columns)
        own = sorted(tuple(str(r[c]) for c in columns) for r in rows)
        assert own == sorted(tuple(str(v) for _, v in sorted(zip(want.columns, r, strict=True))) for r in want.fetchall())


def test_empty_pages_of_any_length(spark, tmp_path):
    """Short pages, pages without html and such that end within a script have the rows of the SQL as well."""
    html = ["<p>short</p>", None, "", "<script>var t = 1;", "<!-- open", "<div id='root'>" + "x" * 300 + "</div>", "<p>" + "x" * 300]
    pages = [(4 * k + r, f"https://h.example/{k}", h) for k, h in enumerate(html) for r in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in Q.QUERIES["looks_empty"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(Q.ORACLE["looks_empty"]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

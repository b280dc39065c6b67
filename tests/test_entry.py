"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from risklake import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, db, name):
    cursor = db.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(tuple(map(canon, r)) for r in cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(canon, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) >= 0


def test_entry_is_importable_without_a_session():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

import duckdb
import pytest

import __spark_entry__ as entry
from risklake.llm import registry

SF = "/root/testdata/sf0.001"


def test_operators_and_the_pipeline():
    names = {n.split("_")[0] for n in registry.QUERIES}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in sql.description]
    expected = sorted(map(repr, sql.fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, SF).select(*columns).collect()) == expected

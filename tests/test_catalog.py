import duckdb
import pytest

import __spark_entry__ as entry
from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    return sorted(tuple("~" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(catalog.ORACLES[name])
    assert columns == sorted(want.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows(columns, [tuple(r) for r in got.select(*columns).collect()]) == rows(columns, want.select(picked).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

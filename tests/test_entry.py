import duckdb
import pytest

from papyra.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(v[i], 6) if isinstance(v[i], float) else v[i] for i in order]) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, want = catalog.queries()[name](spark, SF), db.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(want.columns, want.fetchall())


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered query of the table engine against its SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

if os.path.isdir(SF):
    from trialweave.plans.registry import QUERIES, SQL
else:
    QUERIES, SQL = {}, {}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(SQL[name])
    assert columns == sorted(want.columns)
    assert plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect())) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())

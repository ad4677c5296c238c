"""Every query with oracle SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shape(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("q_")))
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert shape(tuple(r) for r in got.select(*columns).collect()) == shape(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


MID = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(MID), reason="no test tables")
def test_assignment_floors_and_samples_keep_their_invariants(spark):
    from fieldsieve.plans import catalog

    given = catalog.QUERIES["q_assignment"](spark, MID).toPandas()
    assert given["uuid"].is_unique and given["assigned_view"].value_counts().to_dict() == catalog.ASSIGN
    wanted = {r.uuid: r.views for r in catalog.candidates(spark, MID).collect()}
    assert all(v in wanted[u] for u, v in zip(given["uuid"], given["assigned_view"], strict=True))
    raised = catalog.QUERIES["q_floors"](spark, MID).toPandas()
    assert raised["uuid"].is_unique and raised["view"].value_counts().to_dict() == catalog.ASSIGN and (raised["persons"] != "").mean() >= 0.3
    drawn = catalog.QUERIES["q_sample_random"](spark, MID).toPandas()
    assert (drawn.groupby("primary_view").size() == 8).all() and (drawn.groupby("primary_view")["pos"].min() == 0).all()

"""Each query of the panel against its SQL, at the smallest size."""

import duckdb
import pytest

from corrweave.plans.queries import QUERIES, SQL

TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def rows(table, columns):
    return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in columns])))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, tiny, name):
    ours, theirs = QUERIES[name](spark, tiny).toArrow(), con.execute(SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    assert rows(ours, columns) == rows(theirs, columns)
    assert len(ours)


@pytest.mark.parametrize("name", ["gcn_scores", "hallucinated_windows", "sweep_trials", "training_log"])
def test_others_give_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count()

import math

import duckdb
import pytest

import __spark_entry__
from __spark_entry__ import entry
from conftest import plan
from quillwave.plans.registry import ALL_ORACLES, ALL_QUERIES


def queries():
    return ALL_QUERIES


def oracle_sql():
    return ALL_ORACLES


# Iterative fits, and eigenvectors of more than two channels; the operators have tests of their own.
ROWS_ONLY = {
    "svm_classify", "mlp_classify", "fit_and_score", "csp_features", "csp_four_classes", "train_epochs", "kernel_svm_votes",
}


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for (name,) in connection.execute(
        f"SELECT DISTINCT parse_filename(file, true) FROM glob('{small}/*.parquet')"
    ).fetchall():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


def test_every_query_has_sql_or_a_reason():
    assert set(queries()) - set(oracle_sql()) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries()) <= set(__spark_entry__.queries())


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, small, name):
    mine = queries()[name](spark, small)
    columns = sorted(mine.columns)
    got = sorted((tuple(r) for r in mine.select(*columns).collect()), key=key)
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(duck.sql(f"SELECT {listed} FROM ({oracle_sql()[name]})").fetchall(), key=key)
    assert got == want
    # The smallest tables have no conflicting texts.
    assert got or name in ("label_conflicts", "stream_label_conflicts")


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, small, name):
    out = queries()[name](spark, small).collect()
    assert out
    assert not any(isinstance(v, float) and math.isnan(v) for r in out for v in r)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join(spark, small, name):
    if name in ROWS_ONLY:
        pytest.skip("covered by the operators' own tests")
    text = plan(queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert entry(spark).columns == ["doc_id", "k", "value"]

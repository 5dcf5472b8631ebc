"""Every registered query of the engine gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from cubeloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(str(tuple(r)) for r in frame.select(names).collect()) == sorted(map(str, result.fetchall()))


def test_number_texts_of_odd_amounts(spark, tmp_path):
    """Minus zero, ties of the fifth decimal, amounts too large for four decimals, nulls."""
    amounts = [-0.0, 0.0, -1e-5, 1e-5, -5e-5, 5e-5, -5e-324, None, 4.35, -2.5, 1000.0, -7.0, *(i / 20000 for i in range(-999, 1000, 2)), *(round(3.7 + i / 100000, 5) for i in range(999))]
    large = [2.0**38 + 0.1, 2.0**39 - 0.3, 549755813888.1234, 2.0**46 + 0.03125, 2.0**46 + 0.09375, 3.0**28 + 1 / 3, 922337203685476.1, 922337203685477.5]
    amounts += [sign * x for x in large for sign in (1, -1)] + [-922337203685477.5808]
    spark.createDataFrame(list(enumerate(amounts)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    rows = [tuple(r) for r in QUERIES["number_texts"](spark, str(tmp_path)).orderBy("c_custkey").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert rows == con.execute(ORACLES["number_texts"] + " ORDER BY c_custkey").fetchall()
    assert [r[2] for r in rows[:3]] == ["-0", "0", "-0"]


def test_entry(spark):
    assert entry.entry(spark).count() == 31
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL on the smallest tables."""

import re
from pathlib import Path

import pytest

import oracle

SF_DIR = "/root/testdata/sf0.001"
QUERIES = oracle.contract.queries()
SQL = oracle.contract.oracle_sql()
IDS = (
    [f"A{i:02d}" for i in range(1, 11)]
    + [f"B{i:02d}" for i in range(1, 19)]
    + [f"C{i:02d}" for i in range(1, 12)]
    + [f"D{i:02d}" for i in range(1, 21)]
    + [f"E{i:02d}" for i in range(1, 23)]
    + [f"F{i:02d}" for i in range(1, 11)]
    + [f"G{i:02d}" for i in range(1, 32)]
    + [f"H{i:02d}" for i in range(1, 12)]
    + [f"I{i:02d}" for i in range(1, 6)]
    + [f"J{i:02d}" for i in range(1, 10)]
)


@pytest.fixture(scope="module")
def connection():
    if not Path(SF_DIR).exists():
        pytest.skip("driver tables not present")
    return oracle.connect(SF_DIR)


def test_every_operator_is_registered():
    assert sorted({m.group() for name in QUERIES if (m := re.match(r"[A-J]\d\d", name))}) == sorted(IDS)


def test_entry(spark):
    frame = oracle.contract.entry(spark)
    assert frame.columns[0] == "material_key" and frame.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    problem = oracle.difference(frame.toPandas(), connection.execute(SQL[name]).fetchdf())
    assert problem is None, problem

"""Registered queries of the subpackage against their check queries, and their plans."""

import os

import duckdb
import pytest

from postlens.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("POSTLENS_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
NATIVE = {"op1_imatch", "op3_line_dedup"}
PER_DOCUMENT = {"op1_imatch", "op3_line_dedup", "op4_bpe", "op5_token_file", "op6_license_scan", "op8_simhash", "op10_language_id", "op11_secret_scan"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def comparable(table):
    columns = sorted(table.column_names)
    return columns, sorted(tuple(map(repr, r)) for r in zip(*(table.column(c).to_pylist() for c in columns)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_check_query(spark, duck, name):
    assert comparable(QUERIES[name](spark, FOLDER).toArrow()) == comparable(duck.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_whole_table(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Arrow" not in plan
    rows = frame.count()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert rows == documents if name in PER_DOCUMENT else rows > 0


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")]
    assert numbers == list(range(1, 14))

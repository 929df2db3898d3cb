"""A cut through the registered queries on the smallest tables, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical
from sparkevidence.plans.catalog import REGISTRY
from sparkevidence.plans.registry import TABLES

SAMPLE = (
    "chunk_fixed", "chunk_overlap_from_elements", "chunk_hierarchy", "chunk_table", "heading_hierarchy", "retrieve_keyword",
    "retrieve_vector", "hybrid_search", "rrf", "rerank_overlap", "expand_evidence", "verify_answers", "metrics_from_fusion",
    "evaluate_gates", "calibrate", "check_table_grid", "validate_query_cases", "route_documents", "descendants", "list_documents",
)


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(entry.queries()) and set(REGISTRY) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, small, db, name):
    got, want = entry.queries()[name](spark, small).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["chunk_overlap", "retrieve_keyword", "heading_path"])
def test_result_does_not_depend_on_partitions(spark, small, name):
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(canonical(entry.queries()[name](spark, small).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

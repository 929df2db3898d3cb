"""Annotations move without texts and slices; odd rows keep their errors, and the given small table its SQL."""

import duckdb

import __spark_entry__ as entry
from check import canonical
from sparkevidence.operators import rules
from sparkevidence.schemas import LOCATOR, SLICES


def test_odd_annotations(spark):
    rows = [  # element, table, cell, end, locator, kind -> wrong
        ("e1", None, None, 3, None, "text_span", False), ("e1", None, None, 4, None, "text_span", True),
        ("e1", None, None, None, None, "text_span", True), ("e1", None, None, 99, None, "cell", False),
        ("e1", None, None, 99, None, None, False), ("e2", None, None, 0, None, "text_span", True),
        ("e2", None, None, None, None, "cell", False), ("e3", None, None, 0, None, "text_span", False),
        ("ghost", None, None, None, None, None, True), (None, None, None, 0, None, "text_span", True),
        (None, "t1", "c1", None, None, "cell", False), (None, "t1", "ghost", None, None, "cell", True),
        (None, "ghost", None, None, None, "cell", True), (None, None, "c1", None, None, "cell", True),
        (None, "t1", "c1", None, '{"kind":"pdf"}', "cell", False), (None, "t1", "c1", None, "nowhere", None, True),
    ]
    given = spark.createDataFrame(
        [(f"a{n}", "d", "old" if n == 2 else "digest", *r[:3], 0, *r[3:6], dict.fromkeys(SLICES, "any" if n != 3 else "xx")) for n, r in enumerate(rows)],
        "case_id string, document_id string, source_digest string, element_id string, table_id string, cell_id string, start int, end int, "
        f"locator_key string, target_kind string, slices struct<{','.join(f'{s}:string' for s in SLICES)}>")
    place = (*[None] * 2, "pdf", *[None] * 11)
    shape = f"document_id string, id string, text string, locator {LOCATOR.simpleString()}"
    elements = spark.createDataFrame([("d", "e1", "abc", place), ("d", "e2", None, place), ("d", "e3", "", place)], shape)
    tables = spark.createDataFrame([("d", "t1", None, place)], shape)
    cells = spark.createDataFrame([("d", "t1", "c1"), ("d", "t1", "c1")], "document_id string, table_id string, id string")
    docs = spark.createDataFrame([("d", "digest")], "document_id string, content_digest string")
    found = rules.validate_annotations(given, elements, tables, cells, docs, {s: ("any",) for s in SLICES})
    want = {f"a{n}": ["LOCATOR_INVALID"] if r[-1] else [] for n, r in enumerate(rows)}
    want["a2"], want["a3"] = ["DOCUMENT_REFERENCE_BROKEN"], ["UNKNOWN_SLICE"]
    assert {r["case_id"]: r["errors"] for r in found.collect()} == want and found.count() == len(rows)
    assert "_text" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_given_table(spark, small):
    db = duckdb.connect()
    for name in ("customer", "orders", "lineitem"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    got, want = entry.queries()["validate_annotations"](spark, small).toPandas(), db.sql(entry.oracle_sql()["validate_annotations"]).df()
    assert len(want) and canonical(got) == canonical(want)

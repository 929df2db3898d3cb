"""What listings and closures write and read again."""

from sparkevidence.operators import lineage as X
from sparkevidence.plans import q_lineage as Q
from sparkevidence.plans.registry import Tables


def names_of(monkeypatch):
    written, real = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name, *by: (written.append(name), real(df, name, *by))[1])
    return written


def test_a_page_of_documents_joins_the_artifacts_once(spark, small, monkeypatch):
    written = names_of(monkeypatch)
    t = Tables(spark, small)
    page = Q.list_documents(t)
    assert written == ["document-page"] and page.count() > 0
    # The submissions, and with them the join to all artifacts, stand behind the written page.
    assert "c_custkey" not in page._jdf.queryExecution().analyzed().toString()


def test_written_edges_are_not_written_again(spark, monkeypatch):
    artifacts = spark.createDataFrame([("a", "x1"), ("b", "x2"), ("c", "x3"), ("d", "x4")], "artifact_id string, producing_attempt_id string")
    attempts = spark.createDataFrame([("x1", "FAILED"), ("x2", "SUCCEEDED"), ("x3", "SUCCEEDED"), ("x4", "SUCCEEDED")], "attempt_id string, state string")
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b")], "artifact_id string, parent_id string")
    written = names_of(monkeypatch)
    found = X.eligible_artifacts(artifacts, attempts, edges).collect()
    assert sorted(map(tuple, found)) == [("a", False), ("b", False), ("c", False), ("d", True)]
    assert "closure-edges" not in written


def test_artifacts_and_attempts_share_one_written_table(spark, small):
    t = Tables(spark, small)
    both = [df.inputFiles() for df in Q.graph(t)[:2]]
    assert sorted(both[0]) == sorted(both[1])


def test_indexes_without_a_held_locator_do_not_climb(spark, monkeypatch):
    """Nothing holds what b looks for, so its ancestors are not listed; it is in the result all the same."""
    frontiers, write = [], X.materialize

    def seen(df, name, *rest):
        out = write(df, name, *rest)
        if name == "frontier":
            frontiers.append(sorted(tuple(r) for r in out.select("index_id", "artifact_id").collect()))
        return out

    monkeypatch.setattr(X, "materialize", seen)
    lineage = spark.createDataFrame([("a", "p"), ("b", "p"), ("p", "q")], "artifact_id string, parent_id string")
    contents = spark.createDataFrame([("q", "k1"), ("p", "k2")], "artifact_id string, locator_key string")
    wanted = spark.createDataFrame([("a", "k1"), ("a", "gone"), ("b", "gone"), ("b", None)], "index_id string, locator_key string")
    found = {r.index_id: (r.artifact_id, r.depth) for r in X.source_of_evidence(wanted, lineage, contents).collect()}
    assert found == {"a": ("q", 2), "b": (None, None)}
    assert frontiers == [[("a", "a")], [("a", "p")], [("a", "q")], []]

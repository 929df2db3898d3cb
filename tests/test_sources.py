import json

import pytest
from pyspark.sql import functions as F

from sparkevidence.functions import text as T
from sparkevidence.operators import lineage as X
from sparkevidence.operators import rules
from sparkevidence.sources import datasets as D
from sparkevidence.sources import elements as L
from sparkevidence.sources import intake as N
from sparkevidence.streaming import intake as S


def test_words_equal_python_split_on_every_text(spark, small):
    odd = ["", " ", "a b　c", "\x1ca\x1db ", "x y\tz\n", "one"]
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + odd
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.words(F.col("t")).alias("w")).collect()
    assert all(r.w == texts[r.i].split() for r in got)


def test_redaction(spark):
    rows = ["plain  text", "my API-key here", "{json}", "a" * 32, "token economy", "tokens"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.redact(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["plain text", "[redacted]", "[redacted]", "[redacted]", "[redacted]", "tokens"]


def test_canonical_documents_read_with_a_fixed_schema(spark, tmp_path):
    doc = {
        "document_id": "d", "schema_version": "v1", "metadata": {"language": "en"},
        "elements": [{"id": "e", "kind": "heading", "reading_order": 0, "level": 1, "text": "T", "locator": {"kind": "html", "path": "/h1"}}],
        "tables": [],
    }
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "d.json").write_text(json.dumps(doc))
    row = L.canonical_elements(L.read_canonical(spark, str(tmp_path / "ok"))).first()
    assert (row.document_language, row.id, row.locator.path) == ("en", "e", "/h1")
    (tmp_path / "new").mkdir()
    (tmp_path / "new" / "d.json").write_text(json.dumps(doc | {"schema_version": "v9"}))
    with pytest.raises(Exception, match="unknown schema_version"):
        L.read_canonical(spark, str(tmp_path / "new")).collect()


def test_exchange_confidence_and_order(spark):
    item = lambda o, c, layout="paragraph": {"order": o, "text": "t", "language": "zh", "bbox": [0, 0, 1, 1], "confidence": c, "layout": layout}
    good = {"model_id": "m", "pages": [{"page_number": 1, "items": [item(0, .97, "heading"), item(1, .5)]}, {"page_number": 2, "items": [item(0, .94)]}]}
    gap = {"model_id": "m", "pages": [{"page_number": 2, "items": [item(0, .9)]}]}
    parsed = L.parse_exchange(spark.createDataFrame([("g", json.dumps(good)), ("b", json.dumps(gap)), ("j", "{")], "document_id string, content string"))
    rows = L.elements_from_exchange(parsed).orderBy("reading_order").collect()
    assert [(r.reading_order, r.kind, r.level, r.signal, r.locator.page_number) for r in rows] == [
        (0, "heading", 1, "PASS", 1), (1, "paragraph", None, "WARN", 1), (2, "paragraph", None, "PASS", 2)
    ]
    assert L.exchange_summary(L.elements_from_exchange(parsed)).first().bucket == "medium"
    assert {r.id for r in L.exchange_rejects(parsed).collect()} == {"b", "j"}


def test_intake_limits(spark):
    df = spark.createDataFrame([(1, "a.TXT", b"hi"), (2, "b", b""), (3, "c.pdf", b"%PDF-1")], "document_id int, name string, content binary")
    rows = {r.document_id: r for r in N.intake(df).collect()}
    assert set(rows) == {1, 3} and rows[1].extension == "txt" and rows[3].has_embedded_text
    assert [r.id for r in N.intake_rejects(df).collect()] == ["2"]


def test_stage_tables_and_export(spark, tmp_path):
    df = spark.createDataFrame([("i", "c1"), ("j", "c2")], "index_id string, chunk_id string")
    D.write_stage(df, "chunks", str(tmp_path))
    assert D.read_stage(spark, "chunks", str(tmp_path)).filter("index_id = 'j'").first().chunk_id == "c2"
    with pytest.raises(ValueError):
        D.write_stage(df, "whatever", str(tmp_path))
    seen = F.sha2(F.to_json(F.struct("case_id", "label")), 256)
    cases = spark.createDataFrame([("b", 1), ("a", 2)], "case_id string, label int").withColumn(
        "reviews", F.array(F.struct(seen.alias("content_digest")), F.struct(F.lit("old").alias("content_digest")))
    )
    D.export_dataset(cases, str(tmp_path / "out"))
    back = D.read_dataset(spark, str(tmp_path / "out"), cases.schema, ["case_id", "label"])
    assert {r.case_id: len(r.reviews) for r in back.collect()} == {"a": 1, "b": 1}


def test_closure_handles_diamonds_and_eligibility_flows_down(spark):
    artifacts = spark.createDataFrame([(c, "r", f"t{c}") for c in "abcde"], "artifact_id string, producing_run_id string, producing_attempt_id string")
    tries = spark.createDataFrame([(f"t{c}", "FAILED" if c == "b" else "SUCCEEDED") for c in "abcde"], "attempt_id string, state string")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")], "artifact_id string, parent_id string")
    sources = spark.createDataFrame([("a", "r")], "source_id string, run_id string")
    down = {r.artifact_id: r.depth for r in X.descendants(sources, artifacts, tries, edges).collect()}
    assert down == {"a": 0, "c": 1, "d": 2, "e": 3}
    good = {r.artifact_id for r in X.eligible_artifacts(artifacts, tries, edges).collect() if r.eligible}
    assert good == {"a", "c"}


def test_condition_types(spark):
    df = spark.sql("select 5 n, 'x' s, cast(null as int) z, true b")
    seen = {c: F.col(c) for c in df.columns}
    check = lambda e: df.select(rules.condition(e, seen).alias("v")).first().v
    assert check({"gte": ["n", 5]}) and not check({"gte": ["s", 1]}) and not check({"lte": ["z", 1]}) and not check({"gte": ["b", 0]})
    assert check({"eq": ["z", None]}) and not check({"in": ["s", "x"]}) and check({"not": {"in": ["s", ["y"]]}})
    assert check(None) and check({"all": []}) and not check({"any": []})


def test_streaming_intake_knows_every_content_it_has_seen(spark, tmp_path):
    """A copy that arrives in a later batch, hours later or late, is not chunked again; empty contents are rejected."""
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "document_id string, name string, content string, arrived_at timestamp"
    batches = (
        "('a', 'a.txt', 'one two\\nthree', timestamp'2024-01-01'), ('b', 'b.txt', 'one two\\nthree', timestamp'2024-01-01'), "
        "('c', 'c.txt', 'other', timestamp'2024-01-01'), ('d', 'd.txt', '', timestamp'2024-01-01')",
        "('e', 'e.txt', 'other', timestamp'2024-01-01 05:00:00'), ('f', 'f.txt', 'late', timestamp'2020-01-01')",
    )
    for rows in batches:
        spark.sql(f"select * from values {rows} t(document_id, name, content, arrived_at)").coalesce(1).write.mode("append").parquet(str(source))
        query = S.start_intake(spark.readStream.schema(schema).parquet(str(source)), str(out), str(tmp_path / "ckpt"))
        query.awaitTermination(120)
        assert query.exception() is None
    made = spark.read.parquet(str(out / "chunks")).collect()
    assert sorted(r.content for r in made) == ["late", "one two\nthree", "other"]
    assert [r.id for r in spark.read.parquet(str(out / "rejects")).collect()] == ["d"]


def test_no_size_limit_of_sources(spark):
    big = spark.range(1).select(F.lit("x").alias("document_id"), F.lit("x.txt").alias("name"), F.expr("repeat('a', 17 * 1024 * 1024)").alias("content"))
    assert N.intake(big).first().byte_size == 17 * 1024 * 1024 and N.intake_rejects(big).isEmpty()


def test_lineage_seventy_levels_deep(spark):
    edges = spark.range(70).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    loop = edges.union(spark.createDataFrame([("70", "0")], "source string, target string"))
    seeds = spark.createDataFrame([("0", "0")], "root string, node string")
    assert X.closure(seeds, loop).agg(F.max("depth")).first()[0] == 70


def test_evidence_leaves_the_frontier_at_its_first_hit(spark, monkeypatch):
    """Ancestors behind the first hit are never listed; ties go to the smallest id, cycles end, orphans stay without a source."""
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("i", "n0"), ("i", "m0"), ("m0", "n1"), ("loop", "pool"), ("pool", "loop")]
    lineage = spark.createDataFrame(edges, "artifact_id string, parent_id string")
    contents = spark.createDataFrame(
        [("n1", "a"), ("n0", "b"), ("m0", "b"), ("n9", "a"), ("i", "other"), ("own", "a"), (None, "a")], "artifact_id string, locator_key string")
    wanted = [("i", "a"), ("own", "a"), ("loop", "a"), ("lone", "z"), (None, "a"), ("i", "a")]
    written, write = [], X.materialize
    monkeypatch.setattr(X, "materialize", lambda df, name, *by: written.append((name, write(df, name, *by))) or written[-1][1])

    def ask(rows):
        written.clear()
        found = X.source_of_evidence(spark.createDataFrame(rows, "index_id string, locator_key string"), lineage, contents)
        return {r["index_id"]: (r["artifact_id"], r["depth"]) for r in found.collect()}

    assert ask(wanted) == {"i": ("n1", 2), "own": ("own", 0), "loop": (None, None), "lone": (None, None), None: (None, None)}
    listed = {r["artifact_id"] for name, df in written if name == "frontier" for r in df.filter("index_id = 'i'").collect()}
    assert listed == {"i", "n0", "m0", "n1"}
    assert ask([("i", "b")]) == {"i": ("m0", 1)}
    assert ask([]) == {}


def test_streaming_heartbeats_match_the_batch_form(spark, tmp_path):
    beats = spark.sql("select * from values ('w1', timestamp'2024-01-01 00:00:00'), ('w1', timestamp'2024-01-01 00:00:30'), ('w2', timestamp'2024-01-01 00:00:00') t(worker_id, ts)")
    beats.coalesce(1).write.parquet(str(tmp_path / "beats"))
    stream = spark.readStream.schema("worker_id string, ts timestamp").parquet(str(tmp_path / "beats"))
    query = S.newest_heartbeats(stream).writeStream.outputMode("update").format("memory").queryName("beats").trigger(availableNow=True).start()
    query.awaitTermination(120)
    seen = {r.worker_id: r.last_seen for r in spark.table("beats").collect()}
    stale = {r.worker_id: r.stale for r in S.stale_workers(beats, F.lit("2024-01-01 00:00:35").cast("timestamp")).collect()}
    assert seen == {r.worker_id: r.last_seen for r in S.newest_heartbeats(beats).collect()} and stale == {"w1": False, "w2": True}

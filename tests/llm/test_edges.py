"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkevidence.llm import chat, classifier, decontam, html, langid, licenses, lm, packing, quality_rules, simhash

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977} z{i}" for i in range(30_000))
ROWS = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (None, "one two three", "en", "a", 13), (3, " \n\t ", "de", "b", 4), (4, "word", "en", "a", 4),
    (4, "word", "en", "a", 4), (5, "word", "en", "a", 4), (6, LONG, "en", "a", len(LONG)), (7, "Ünïcödé \x1c ſ \U0001F600 mit license", "de", None, 1),
    (None, None, None, None, None),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like those that the operators compute or use inside."""
    out = spark.createDataFrame(ROWS, DOCS)
    for name in ("n_words", "score", "fp", "w", "length", "block", "piece", "kind", "x", "id", "held", "part", "host", "raw", "label"):
        out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (6, 1, 1), (6, None, None), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(0, "w0 z0 w1 z1 w2 z2 w3 z3 w4 z4 w5 z5"), (1, None), (2, ""), (None, "word"), (3, "... ?")], "item_id long, text string")


def operators(labels, items):
    return {
        "rules": lambda d: quality_rules.score_rules(d),
        "classifier": lambda d: classifier.classify(d, labels),
        "simhash": lambda d: simhash.near_duplicates(d),
        "licenses": lambda d: licenses.scan(d),
        "lm": lambda d: lm.score(d),
    }


@pytest.mark.parametrize("name", ["rules", "classifier", "simhash", "licenses", "lm"])
def test_one_row_for_each_row(docs, empty, labels, items, name):
    run = operators(labels, items)[name]
    got = run(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    equal = [r for r in got if r["doc_id"] == 4]
    assert len(equal) == 2 and equal[0] == equal[1]
    assert run(empty).collect() == []


def test_packing_edges(docs, empty):
    rows = packing.pack(docs, VOCABULARY).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == 3
    assert [r["length"] for r in sorted((r for r in rows if r["doc_id"] == 6), key=lambda r: r["piece"])][:-1] == [4096] * (sum(r["doc_id"] == 6 for r in rows) - 1)
    assert len([r for r in rows if r["doc_id"] == 4]) == 2
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 4096
    assert packing.pack(empty, VOCABULARY).collect() == []


def test_decontamination_edges(spark, docs, empty, items):
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()}
    assert found == {(6, 0), (4, None), (5, None)}
    none = items.filter("false")
    assert decontam.leaks(empty, items).collect() == [] and decontam.leaks(docs, none).collect() == []
    assert decontam.decontaminate(docs, none).count() == len(ROWS) and decontam.decontaminate(docs, items).columns == docs.columns


def test_pages_edges(spark, docs):
    rows = [(1, None, None), (2, "http://a.b", ""), (None, "x", "<p>Text"), (3, "http://a.b/c", "<" * 5000 + "<p>a&amp;b <b>c"), (3, "http://a.b/c", "<" * 5000 + "<p>a&amp;b <b>c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2)).withColumn("path", F.lit(3))
    got = sorted((r["page_id"] or 0, r["text"].lstrip("<").strip(), r["n_chars"]) for r in html.extract(pages).collect())
    assert got == [(0, "Text", 4), (1, "", 0), (2, "", 0), (3, "a&b c", 5007), (3, "a&b c", 5007)]
    assert html.extract(pages.filter("false")).collect() == []
    known = langid.identify(docs, pages).collect()
    assert len(known) == len(ROWS) + len(rows)
    assert {r["lang"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), pages).collect()} == {None}
    assert langid.identify(docs.filter("false"), pages.filter("false")).collect() == []


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "a"), (3, None, "user", "a"), (None, 0, "user", "lost"), (4, 0, "x", ""), (4, 0, "x", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("nth", F.lit("clash")).withColumn("a", F.lit(0))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat.render(turns).collect()}
    assert got == {1: (2, 1, "<|user|>\na\n<||>\n\n"), 4: (2, 1, "<|x|>\n\n<|x|>\n\n")}
    assert chat.render(turns.filter("false")).collect() == []


def test_stages_keep_the_columns_and_take_edges(spark, docs, empty, tmp_path, items, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        got = out.collect()
        if function is corpus_pipeline.packed:
            assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
        else:
            assert out.columns == docs.columns and len(got) <= len(ROWS)
        assert function(spark, empty, str(tmp_path)).collect() == []


def test_near_copies_keep_the_smallest_id(spark, docs):
    kept = simhash.keep_one(docs).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["text"] == "word") == [4]
    # Blank texts have one fingerprint, null ids come last.
    assert [r["doc_id"] for r in kept if not (r["text"] or "").strip()] == [1]

import math

import pytest

from pyspark.sql import functions as F

from sparkevidence.functions import normal
from sparkevidence.operators import aggregates as A
from sparkevidence.operators import answer_metrics as M
from sparkevidence.operators import comparison as E
from sparkevidence.operators import quality as Q
from sparkevidence.operators import ranking as K
from sparkevidence.schemas import SLICES, locator


def cases(spark, ids=("A", "B")):
    return spark.createDataFrame([("q", list(ids))], "case_id string, relevant_ids array<string>")


def inventory(spark, rows):
    return spark.createDataFrame([("q", i, r, d) for i, r, d in rows], "case_id string, source_id string, rank int, decision string")


def by_metric(df):
    return {r.metric_id.split(".")[2]: r for r in df.collect()}


def test_recall_and_mrr_by_hand(spark):
    got = by_metric(K.ranked_metrics(cases(spark), inventory(spark, [("X", 1, None), ("A", 2, None), ("B", 3, None)]), "retrieval", 2))
    assert (got["recall"].value, got["mrr"].value, got["hit"].value) == (.5, .5, 1.0) and got["ndcg"].value > 0
    assert got["recall"].matched_count == 1 and got["recall"].labelled_count == 2


def test_repeated_source_counts_once_in_ndcg(spark):
    got = by_metric(K.ranked_metrics(cases(spark), inventory(spark, [("A", 1, None), ("A", 2, None)]), "retrieval", 5))
    assert abs(got["ndcg"].value - 1 / (1 + 1 / math.log2(3))) < 1e-12


def test_excluded_decisions_never_score_and_no_labels_is_a_status(spark):
    got = by_metric(K.ranked_metrics(cases(spark), inventory(spark, [("A", 1, "limit_excluded")]), "rerank", 5))
    assert got["hit"].value == 0.0
    none = by_metric(K.ranked_metrics(cases(spark, ()), inventory(spark, [("A", 1, None)]), "rerank", 5))
    assert none["recall"].status == Q.INSUFFICIENT_LABELS and none["recall"].value is None


def test_context_ignores_k_and_empty_selection_does_not_apply(spark):
    got = by_metric(K.context_metrics(cases(spark), inventory(spark, [("A", 1, "included"), ("X", 2, "included"), ("B", 3, "included")])))
    assert abs(got["precision"].value - 2 / 3) < 1e-12 and got["recall"].value == 1.0
    none = by_metric(K.context_metrics(cases(spark), inventory(spark, [("A", 1, "excluded_budget")])))
    assert none["precision"].status == Q.NOT_APPLICABLE and none["recall"].value == 0.0


def test_fact_spans_keep_original_positions(spark):
    facts = spark.createDataFrame([("q", ["blue  SKY", "ﬁne"], "answerable")], "case_id string, expected_facts array<string>, answerability string")
    answers = spark.createDataFrame([("q", "The Blue   Sky is fine; blue sky!")], "case_id string, answer string")
    spans = {(r.span_start, r.span_end) for r in M.fact_matches(facts, answers, "expected_facts").collect()}
    assert spans == {(4, 14), (18, 22), (24, 32)}
    row = M.fact_metric(facts, answers).first()
    assert row.value == 1.0 and row.labelled_count == 2


def test_duplicate_and_malformed_citations_count_as_generated(spark):
    key = "cit_" + "a" * 32
    case = spark.createDataFrame([("q", [key, "cit_" + "b" * 32])], "case_id string, required_citation_keys array<string>")
    answers = spark.createDataFrame([("q", [key, key, "bad"])], "case_id string, citation_keys array<string>")
    evidence = spark.createDataFrame([("q", key)], "query_id string, citation_key string")
    checked = spark.createDataFrame([("q", [key], [])], "case_id string, resolved_citation_keys array<string>, missing_citation_keys array<string>")
    matches = M.citation_matches(answers, evidence, checked)
    assert sorted(r.decision_id for r in matches.collect()) == ["malformed", "resolved", "resolved"]
    assert abs(M.citation_precision(case, answers, matches).first().value - 2 / 3) < 1e-12
    recall = M.citation_recall(case, answers, matches).first()
    assert recall.value == .5 and recall.missing_keys == ["cit_" + "b" * 32]


def slices(**given):
    return F.struct(*[F.lit(given.get(s, "any")).alias(s) for s in SLICES])


def test_one_failing_slice_makes_calibration_ineligible(spark):
    labels = spark.createDataFrame([("a", "GOOD"), ("b", "GOOD"), ("c", "BAD"), ("d", "GOOD")], "case_id string, label string")
    labels = labels.withColumn("slices", F.when(F.col("case_id") == "d", slices(language="de")).otherwise(slices(language="en")))
    results = spark.createDataFrame([("a", "GOOD"), ("b", "GOOD"), ("c", "BAD"), ("d", "BAD")], "case_id string, label string")
    strict = [A.SlicePolicy({"language": "en"}, 1, .9), A.SlicePolicy({"language": "de"}, 1, .9)]
    got = {r.selector: r for r in A.calibrate(labels, results, "GOOD", strict).collect()}
    assert got["language=en"].status == "ELIGIBLE" and got["language=de"].status == "INELIGIBLE"
    assert got["overall"].agreement == .75 and got["overall"].status == "ELIGIBLE" and got["overall"].eligibility == "INELIGIBLE"
    fine = {r.selector: r for r in A.calibrate(labels, results, "GOOD", strict[:1]).collect()}
    assert fine["overall"].eligibility == "ELIGIBLE"
    missing = {r.selector: r for r in A.calibrate(labels, results.filter("case_id <> 'a'"), "GOOD", strict[:1]).collect()}
    assert missing["language=en"].agreement is None and missing["overall"].eligibility == "INELIGIBLE"


def report(spark, value, status="VALUE", owner="retrieval", **more):
    df = spark.createDataFrame([("r1", "m@1", owner, "q", status, value)], "report_id string, metric_id string, owner string, case_id string, status string, value double")
    return df.withColumn("slices", slices(**more))


def test_gates(spark):
    gates = A.gate_table(spark, [A.Gate("g", "m@1", "retrieval", {"language": "en"}, threshold=.9)])
    assert A.evaluate_gates(report(spark, .2, language="en"), gates).first().state == "FAIL"
    assert A.evaluate_gates(report(spark, .95, language="en"), gates).first().state == "PASS"
    assert A.evaluate_gates(report(spark, .2, language="de"), gates).first().reason == "NO_SELECTED_REPORTS"
    assert A.evaluate_gates(report(spark, None, Q.NOT_APPLICABLE, language="en"), gates).first().state == "INSUFFICIENT"
    judge = A.gate_table(spark, [A.Gate("j", "m@1", "judge")])
    drifted = report(spark, 1.0, owner="judge").withColumn("eligibility", F.lit("DRIFTED"))
    assert A.evaluate_gates(drifted, judge).first().state == "INELIGIBLE"
    bad = A.gate_table(spark, [A.Gate("b", "m@1", "retrieval", {}, "any_failure", failure_code="invalid_citation")])
    matches = spark.createDataFrame([("r1", "Malformed")], "report_id string, decision_id string")
    row = A.evaluate_gates(report(spark, 1.0), bad, matches).first()
    assert (row.state, row.value) == ("FAIL", 0.0)
    assert A.evaluate_gates(report(spark, 1.0), bad, matches.filter("false")).first().state == "PASS"


def test_baseline_zero_has_no_relative_delta(spark):
    row = E.compare_runs(report(spark, 0.0), report(spark, .5)).first()
    assert (row.relative_state, row.absolute, row.relative) == ("UNDEFINED_BASELINE_ZERO", .5, None)
    lone = E.compare_runs(report(spark, 0.0), report(spark, .5).filter("false")).first()
    assert lone.relative_state == "NOT_MEANINGFUL"


def test_environment_change_is_decided_first(spark):
    rows = report(spark, .5)
    assert E.replay_diff(rows, rows, ["case_id"], ["value"]).first().state == "STABLE"
    assert E.replay_diff(rows, rows, ["case_id"], ["value"], "a", "b").first().state == "ENVIRONMENT_CHANGED"
    changed = rows.withColumn("value", F.lit(.6))
    assert E.replay_diff(rows, changed, ["case_id"], ["value"]).first().state == "MODEL_OUTPUT_CHANGED"


def test_hard_only_recommendation(spark):
    gates = spark.createDataFrame([("c", "FAIL", "soft"), ("c", "PASS", "hard")], "comparison_id string, state string, severity string")
    assert E.recommendation(gates).first().recommendation == "BASELINE_RETAINED"
    assert E.recommendation(gates, True).first().recommendation == "CANDIDATE_ELIGIBLE"


def element(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, id string, kind string, reading_order int, text string, at string")
    return df.withColumn("locator", locator(kind=F.lit("html"), path=F.col("at")))


def test_ingestion_metrics_by_hand(spark):
    expected = element(spark, [("d", f"e{i}", "paragraph", i, t, f"/{i}") for i, t in enumerate(["alpha beta", "gamma", "delta"])])
    observed = element(spark, [("d", "e0", "paragraph", 0, "alpha bexa", "/0"), ("d", "e1", "code", 2, "gamma", "/1"), ("d", "e2", "paragraph", 1, "ｄelta", "/2")])
    labels = expected.select("document_id", F.col("id").alias("element_id"), F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("label"))
    cer, wer = Q.cer(labels, observed).first(), Q.wer(labels, observed).first()
    assert abs(cer.value - (1 - 1 / 20)) < 1e-12 and cer.matched_count == 0
    assert abs(wer.value - (1 - 1 / 4)) < 1e-12
    assert abs(Q.element_f1(labels, expected, observed).first().value - 4 / 6) < 1e-12
    order = Q.reading_order(labels, expected, observed).first()
    assert abs(order.value - 1 / 3) < 1e-12 and order.matched_count == 1
    single = Q.reading_order(labels.filter("element_id = 'e0'"), expected, observed).first()
    assert single.status == Q.INSUFFICIENT_LABELS and single.value is None
    assert Q.unlabelled(expected, labels.filter("false"), Q.CER).first().status == Q.NOT_APPLICABLE


def test_word_distance_is_levenshtein_over_words(spark):
    from sparkevidence.functions.normal import ordered_pairs, word_distance

    df = spark.sql("select split('a b c d', ' ') l, split('b x d e', ' ') r")
    assert df.select(word_distance(F.col("l"), F.col("r")).alias("d")).first().d == 3
    values = [(i * 37) % 101 for i in range(300)]
    want = sum(values[i] < values[j] for i in range(300) for j in range(i + 1, 300))
    made = spark.createDataFrame([(values,)], "v array<long>").select(ordered_pairs("v").alias("n"))
    assert made.first().n == want


def test_fact_spans_point_into_the_original_answer(spark):
    rows = [("Revenue\u3000increased. Revenue  INCREASED again.", "revenue increased"), ("stra\u00dfe \ufb01n", "strasse"), ("a \ufb01n", "fin"), (" x", "x"), ("", "x"), (None, "x"), ("aaa", "aa")]
    df = spark.createDataFrame(rows, "answer string, fact string").coalesce(1)
    got = [[(s.span_start, s.span_end) for s in r.s] for r in df.select(normal.fact_spans("answer", "fact").alias("s")).collect()]
    assert got == [[(0, 17), (19, 37)], [(0, 6)], [(2, 4)], [(1, 2)], [], [], [(0, 2)]]


def test_word_distance_with_seventy_thousand_words(spark):
    many = [f"w{i}" for i in range(70_000)]
    assert normal.edit_distance(many, ["w0", "x", "w69999"]) == 69_998
    assert normal.edit_distance("a b c d".split(), "a c x d".split()) == 2 and normal.edit_distance([], ["a"]) == 1


def test_table_labels_without_cells_or_table_count(spark):
    tables = spark.createDataFrame([("d", "t1", 2), ("d", "t2", 1)], "document_id string, id string, rows int").withColumn("columns", F.lit(1)).withColumn(
        "locator", F.struct(F.lit("spreadsheet").alias("kind"), F.col("id").alias("range")))
    cells = spark.createDataFrame([("d", "t1", 0), ("d", "t1", 1)], "document_id string, table_id string, row int").select(
        "*", F.lit(0).alias("column"), F.lit(1).alias("row_span"), F.lit(1).alias("column_span"), F.lit(False).alias("is_header"))
    labels = spark.createDataFrame([("d", "t1"), ("d", "t2"), ("d", "ghost")], "document_id string, table_id string")
    twice = tables.unionByName(tables.withColumn("id", F.concat("id", F.lit("-copy"))))
    row = Q.table_structure(labels, tables, cells, twice, cells).first()
    assert (row.labelled_count, row.matched_count) == (3, 2) and abs(row.value - 2 / 3) < 1e-9


@pytest.mark.parametrize("n,fanout", [(0, 3), (1, 3), (9, 3), (1000, 7), (100, 2), (65, 64)])
def test_catalog_of_ids_with_one_long_beginning(spark, n, fanout):
    from sparkevidence.operators import comparison as E

    ids = spark.range(n).selectExpr("concat(repeat('p', 40), lpad(id, 6, '0')) id").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on more data
    try:
        numbered = E.numbered_by_range(ids, "id")
        assert n < 1000 or numbered.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [int(r.child[40:]) for r in sorted(numbered.collect(), key=lambda r: r.position)] == list(range(n))
    want, size, level = [], n, 0
    while size > (level > 0):
        groups = -(-size // fanout)
        want += [(level, p, min(fanout, size - p * fanout)) for p in range(groups)]
        size, level = groups, level + 1
    assert sorted(map(tuple, E.catalog_levels(ids, "id", fanout).collect())) == want


def test_edit_distance_in_whole_numbers():
    import random
    import time

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert normal.edit_distance(a, b) == table(a, b)
    began = time.time()
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    other = list(long)
    for at in range(0, 40_000, 100):
        other[at] = "x"
    # Every hundredth word is changed, the first of them among the seven that are left out.
    assert normal.edit_distance(long, other[7:]) == 399 + 7 and time.time() - began < 60


def test_order_pairs_over_many_blocks(spark):
    """Random orders with ties, cut into small blocks; and a document of 200,000 labels."""
    import random

    rng = random.Random(4)
    rows = [(f"d{d}", rng.randrange(60), rng.randrange(50)) for d in range(4) for _ in range((0, 1, 90, 300)[d])]
    made = spark.createDataFrame(rows, "document_id string, reading_order int, obs int")
    got = {r.document_id: r.m for r in Q._agreeing_pairs(made, 16).collect()}
    for d in ("d1", "d2", "d3"):
        own = sorted((e, o) for k, e, o in rows if k == d)
        assert got[d] == sum(own[i][1] < own[j][1] for i in range(len(own)) for j in range(i + 1, len(own)))
    n = 200_000
    # Runs of eight backwards: of every run no pair agrees, all others do.
    long = spark.range(n).selectExpr("'x' document_id", "cast(id as int) reading_order", "cast(id - id % 8 + 7 - id % 8 as int) obs")
    assert Q._agreeing_pairs(long, 4096).first().m == n * (n - 1) // 2 - n // 8 * 28

import random

import pytest
from pyspark.sql import functions as F

from sparkevidence.operators import chunking as C
from sparkevidence.operators import rules
from sparkevidence.operators import structure as S
from sparkevidence.schemas import ENRICHMENT, locator


def greedy(tokens, breaks, limit, overlap, most):
    """The definition, one segment at a time."""
    groups, current, start_of = [], [], 0
    for i, size in enumerate(tokens):
        full = current and (sum(tokens[j] for j in current) + size > limit or len(current) >= most)
        if current and (breaks[i] or full):
            groups.append((current[0], current[-1] + 1))
            kept, used = [], 0
            if not breaks[i]:
                for j in reversed(current):
                    if used + tokens[j] > min(overlap, limit - size):
                        break
                    kept.insert(0, j)
                    used += tokens[j]
            current = kept
        current.append(i)
    if current:
        groups.append((current[0], current[-1] + 1))
    return groups


@pytest.mark.parametrize("overlap", [0, 5])
def test_pack_equals_the_definition_across_blocks(spark, overlap):
    rng = random.Random(7)
    docs = {f"d{n}": [rng.randint(1, 9) for _ in range(rng.choice([1, 7, 40, 133]))] for n in range(30)}
    docs["ones"] = [1] * 200
    rows = [(d, i, s, f"{d}:{i}") for d, sizes in docs.items() for i, s in enumerate(sizes)]
    segs = spark.createDataFrame(rows, "document_id string, pos long, tokens int, content string")
    made = C.pack(segs, "pos", 12, overlap, block=16).select(
        "document_id", "start", F.size("group").alias("n"), F.col("group")[0]["content"].alias("first")
    ).collect()
    got = {}
    for r in made:
        assert r.first == f"{r.document_id}:{r.start}"
        got.setdefault(r.document_id, set()).add((r.start, r.start + r.n))
    for d, sizes in docs.items():
        assert got[d] == set(greedy(sizes, [False] * len(sizes), 12, overlap, 10**9)), d


def test_a_document_of_many_blocks(spark):
    """200,000 segments in 25,000 blocks: composed over three levels, by several tasks."""
    n = 200_000
    segs = spark.range(n).selectExpr("'d' document_id", "id pos", "cast(1 + pmod(xxhash64(id), 4) as int) tokens")
    stored = [r.tokens for r in segs.orderBy("pos").collect()]
    want, start, used = [], 0, 0
    for i, t in enumerate(stored):
        if used + t > 8:
            want.append(start)
            start, used = i, 0
        used += t
    want.append(start)
    made = C.pack(segs, "pos", 8, block=8)
    assert sorted(r.start for r in made.select("start").collect()) == want
    assert made.rdd.getNumPartitions() > 1


def test_entries_of_composed_maps(spark):
    rows = [("d", i, [(i + 1) % 3, (2 * i) % 3, 0]) for i in range(40)] + [("e", 0, [2, 1, 0])]
    found = C._entries(spark.createDataFrame(rows, "document_id string, at long, map array<int>"), 3).collect()
    at, want = 0, [0]
    for _, _, m in rows[:40]:
        at = m[at]
        want.append(at)
    assert [r.entry for r in sorted(found, key=lambda r: r.at) if r.document_id == "d"] == want
    assert [r.entry for r in sorted(found, key=lambda r: r.at) if r.document_id == "e"] == [0, 2]


def test_a_table_over_several_blocks(spark):
    """Rows of one table in many blocks; groups as a loop over its rows makes them."""
    n, most, here = 700, 12, locator(kind=F.lit("spreadsheet"), sheet_name=F.lit("s"), range=F.lit("A1"))
    cells = spark.range(n).selectExpr(
        "'d' document_id", "'tab' table_id", "concat('x', id) id", "cast(id as int) row", "0 column", "1 row_span", "1 column_span",
        "concat_ws(' ', transform(sequence(1, cast(1 + pmod(xxhash64(id), 11) as int)), i -> concat('w', id))) text", "false is_header")
    for caption, head in (("Sales of all", 4), ("", 0), ("a b c d e f g h i j k", 12)):
        elements = spark.createDataFrame(
            [("d", 0, "c", "caption", caption, None), ("d", 1, "t", "table", None, "tab")],
            "document_id string, reading_order int, id string, kind string, text string, table_id string",
        ).withColumns({"level": F.lit(None).cast("int"), "parent_id": F.lit(None).cast("string"), "locator": here})
        tables = spark.createDataFrame([("d", "tab", "t", n, 1, "c", ["n"])],
            "document_id string, id string, element_id string, rows int, columns int, caption_element_id string, related_element_ids array<string>",
        ).withColumn("locator", here)
        lines = {r.row: f"c0[1x1]={r.text}" for r in cells.collect()}
        want, own, used = [], [], head
        for i in range(n):
            size = len(lines[i].split())
            if used > 0 and used + size > most:
                want.append(own)
                own, used = [], head
            own.append(lines[i])
            used += size
        want.append(own)
        prefix = [f"Table: {caption}"] if caption else []
        found = C.render_tables(tables, cells, elements, most, 16).orderBy("part").collect()
        assert [r.content for r in found] == ["\n".join(prefix + own) for own in want] and [r.part for r in found] == list(range(len(want)))


def test_pack_bounds_items(spark):
    segs = spark.createDataFrame([("d", i, 1) for i in range(50)], "document_id string, pos long, tokens int")
    made = C.pack(segs, "pos", 100, 0, max_items=7, block=10).select(F.size("group").alias("n")).collect()
    assert sorted(r.n for r in made) == [1] + [7] * 7


def tree(spark, rows):
    made = spark.createDataFrame(rows, "document_id string, reading_order int, kind string, level int, text string")
    return made.select(
        "*", F.concat_ws("-", "document_id", "reading_order").alias("id"), F.lit(None).cast("string").alias("parent_id"),
        locator(kind=F.lit("word_processing"), paragraph_index=F.col("reading_order")).alias("locator"),
    )


def test_headings_equal_a_stack_across_blocks(spark):
    rng = random.Random(3)
    rows, paths, parents = [], {}, {}
    for d in range(12):
        stack = []
        for i in range(rng.choice([5, 60])):
            level = rng.randint(1, 4) if rng.random() < 0.5 else None
            key = (f"d{d}", i)
            if level:
                while stack and stack[-1][0] >= level:
                    stack.pop()
            parents[key] = f"d{d}-{stack[-1][1]}" if stack else None
            if level:
                stack.append((level, i))
            rows.append((f"d{d}", i, "heading" if level else "paragraph", level, f"t{i}"))
            paths[key] = [f"t{at}" for _, at in stack]
    elements = tree(spark, rows)
    for r in S.heading_path(elements, block=8).collect():
        assert r.hierarchy_context == paths[(r.document_id, r.reading_order)]
    bad = {r.id for r in S.hierarchy_rejects(elements, block=8).collect()}
    kept = S.heading_hierarchy(elements, block=8).collect()
    assert kept or bad
    for r in kept:
        assert r.document_id not in bad
        assert r.parent_id == parents[(r.document_id, r.reading_order)]


def test_skipped_level_rejects_the_document_but_any_first_level_is_fine(spark):
    elements = tree(spark, [("ok", 0, "heading", 3, "a"), ("ok", 1, "heading", 4, "b"), ("no", 0, "heading", 1, "a"), ("no", 1, "heading", 3, "b")])
    assert {r.document_id for r in S.heading_hierarchy(elements).collect()} == {"ok"}
    assert [r.id for r in S.hierarchy_rejects(elements).collect()] == ["no"]


def test_hierarchy_and_parent_child_strategies(spark):
    rows = [("d", 0, "heading", 1, "Root"), ("d", 1, "paragraph", None, "alpha beta"), ("d", 2, "heading", 2, "Child"), ("d", 3, "paragraph", None, "gamma")]
    made = C.chunk(tree(spark, rows), C.ChunkConfig("hierarchy", 8)).orderBy("start").collect()
    assert [(c.content, c.hierarchy_context) for c in made] == [("Root\nalpha beta", ["Root"]), ("Child\ngamma", ["Root", "Child"])]
    family = C.chunk(tree(spark, rows), C.ChunkConfig("parent_child", 3, 0, 4)).collect()
    parents = {c.chunk_id: c for c in family if c.parent_chunk_id is None}
    children = [c for c in family if c.parent_chunk_id]
    assert children and all(c.chunk_id in parents[c.parent_chunk_id].child_chunk_ids for c in children)
    assert sum(len(p.child_chunk_ids) for p in parents.values()) == len(children)


def test_oversized_segment_rejects_its_document(spark):
    rows = [("d", 0, "paragraph", None, "a b c d"), ("e", 0, "paragraph", None, "a b")]
    config = C.ChunkConfig("fixed", 3)
    assert {c.document_id for c in C.chunk(tree(spark, rows), config).collect()} == {"e"}
    assert [r.id for r in C.chunk_rejects(tree(spark, rows), config).collect()] == ["d"]


def sheet(spark):
    place = lambda r: locator(kind=F.lit("spreadsheet"), sheet_name=F.lit("s"), range=F.lit(r))
    elements = spark.createDataFrame(
        [("d", 0, "c", "caption", "Revenue table", None), ("d", 1, "t", "table", None, "tab"), ("d", 2, "n", "paragraph", "a note", None)],
        "document_id string, reading_order int, id string, kind string, text string, table_id string",
    ).withColumns({"level": F.lit(None).cast("int"), "parent_id": F.lit(None).cast("string"), "locator": place("A1")})
    tables = spark.createDataFrame(
        [("d", "tab", "t", 3, 2, "c", ["n"])],
        "document_id string, id string, element_id string, rows int, columns int, caption_element_id string, related_element_ids array<string>",
    ).withColumn("locator", place("A1"))
    cells = spark.createDataFrame(
        [("d", "tab", "h", 0, 0, 1, 2, "Revenue", True), ("d", "tab", "a", 1, 0, 1, 1, "Q1", False), ("d", "tab", "b", 1, 1, 1, 1, "10", False),
         ("d", "tab", "e", 2, 0, 1, 1, "Q2", False), ("d", "tab", "f", 2, 1, 1, 1, "20", False)],
        "document_id string, table_id string, id string, row int, column int, row_span int, column_span int, text string, is_header boolean",
    )
    return elements, tables, cells


def test_table_repeats_caption_and_headers_in_each_row_group(spark):
    elements, tables, cells = sheet(spark)
    parts = [r.content for r in C.render_tables(tables, cells, elements, 8).orderBy("part").collect()]
    prefix = "Table: Revenue table\nHeaders: Revenue\n"
    assert parts == [prefix + "c0[1x2]=Revenue", prefix + "c0[1x1]=Q1 | c1[1x1]=10", prefix + "c0[1x1]=Q2 | c1[1x1]=20"]
    made = C.chunk(elements, C.ChunkConfig("table", 8), tables, cells).orderBy("start").collect()
    assert [c.source_element_ids for c in made] == [["c"]] + [["c", "t", "n"]] * 3 + [["n"]]


def test_table_row_above_the_limit_rejects(spark):
    elements, tables, cells = sheet(spark)
    assert [r.id for r in C.table_rejects(tables, cells, elements, 2).collect()] == ["d"]
    assert C.chunk(elements, C.ChunkConfig("table", 2), tables, cells).count() == 0


def test_list_rendering(spark):
    df = spark.sql("select 'l' id, 'list' kind, cast(null as string) text, array(named_struct('text','a','level',0), named_struct('text','b','level',2)) items")
    assert C.render_elements(df).first().content == "- a\n    - b"


def test_layout_order(spark):
    df = spark.createDataFrame(
        [("d", "right", 0, None, 1, 0.1, 0.6), ("d", "title", 1, None, 1, 0.1, 0.1), ("d", "next", 2, "title", 2, 0.0, 0.0), ("x", "kid", 0, None, 1, 0.5, 0.0),
         ("x", "mum", 1, None, 2, 0.0, 0.0)],
        "document_id string, id string, reading_order int, parent_id string, p int, y double, x double",
    ).withColumn("locator", locator(kind=F.lit("pdf"), page_number=F.col("p"), y0=F.col("y"), x0=F.col("x")))
    swapped = df.withColumn("parent_id", F.when(F.col("id") == "kid", "mum").otherwise(F.col("parent_id")))
    made = {(r.document_id, r.id): r.reading_order for r in S.layout_order(swapped).collect()}
    assert made == {("d", "title"): 0, ("d", "right"): 1, ("d", "next"): 2}


def test_enrichment_of_another_chunk_is_refused(spark):
    rows = spark.sql("select 'd' document_id, id chunk_id, 'one two' content, 2 token_count, array('e') source_element_ids, "
                     "array(named_struct('element_id', 'e')) citations, cast(null as string) parent_chunk_id, array() child_chunk_ids, "
                     "map() enrichments from values ('a'), ('b') t(id)").withColumn("child_chunk_ids", F.col("child_chunk_ids").cast("array<string>"))
    kind = f"map<string,{ENRICHMENT}>"
    made = C.enrich(rows.withColumn("enrichments", F.from_json(F.lit("{}"), kind)), {"k": [1, 2]}, "p", "c")
    assert {r.enrichments["k"].source_chunk_id for r in made.collect()} == {"a", "b"} and rules.check_chunks(made).isEmpty()
    moved = made.withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id"))
    assert {r.rule for r in rules.check_chunks(moved).collect()} == {"enrichment_provenance"}

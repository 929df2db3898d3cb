"""Filtered retrieval of chunks for a whole table of queries at once.

Queries: (query_id string, index_id string, text string[, embedding array<double>]).
Search documents: (index_id, chunk_id, document_id, keyword_text, language, metadata map,
enrichments map, hierarchy_context, citations, parent_chunk_id, child_chunk_ids[, embedding]).
Lexical retrieval asks a stored index (see stored); search documents in its place are indexed first.
Vectors are scored block against block (see functions.blocks).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import stable_id
from ..functions.blocks import DOC_ROWS, best_of_pairs, doc_blocks, query_blocks, tiles
from ..functions.text import terms
from ..session import materialize
from .stored import StoredIndex, as_index, asked_postings, collection_stats, frequencies, lexical_best, salts, vector_best

# Scores are rounded before ranking, so that the order of float additions cannot decide.
DIGITS = 9


@dataclass(frozen=True)
class Filters:
    language: str | None = None
    document_class: str | None = None
    metadata: Mapping[str, str | None] = field(default_factory=dict)
    enrichments: Mapping[str, str] = field(default_factory=dict)

    def keys(self) -> list[str]:
        named = [*self.metadata, *self.enrichments]
        named += ["language"] if self.language else []
        named += ["document_class"] if self.document_class else []
        return sorted(named)

    def condition(self) -> Column:
        tests = [F.lit(True)]
        if self.language:
            tests.append(F.col("language") == self.language)
        fields = dict(self.enrichments)
        if self.document_class:
            tests.append(_enriched("document_class", self.document_class))
        tests += [F.col("metadata")[k].eqNullSafe(F.lit(v)) for k, v in self.metadata.items()]
        tests += [_enriched(k, v) for k, v in fields.items()]
        combined = tests[0]
        for test in tests[1:]:
            combined = combined & F.coalesce(test, F.lit(False))
        return combined


def _enriched(key: str, value: str | None) -> Column:
    entry = F.col("enrichments")[key]
    return F.map_contains_key("enrichments", key) & entry["value"].eqNullSafe(F.lit(value))


def eligible(search_docs: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return search_docs.filter(filters.condition())


def filtered_count(search_docs: DataFrame, queries: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Chunks of the index that the filters take away, per query."""
    counts = search_docs.groupBy("index_id").agg(
        F.count_if(~filters.condition()).alias("filtered_count"), F.count(F.lit(1)).alias("index_size")
    )
    return queries.select("query_id", "index_id").join(counts, "index_id")


# ---------------------------------------------------------------- lexical scores


def query_terms(queries: DataFrame) -> DataFrame:
    return (
        queries.select("query_id", "index_id", F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("query_id", "index_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def query_weights(queries: DataFrame, words: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """Every query with its term weights (query count times idf); a query without hits has none."""
    weighted = words.join(df, ["index_id", "term"]).join(stats, "index_id").select(
        "query_id", "index_id", "avgdl", "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w")
    )
    lists = weighted.groupBy("query_id", "index_id").agg(
        F.sort_array(F.collect_list(F.struct("term", "w"))).alias("_l"), F.max("avgdl").alias("avgdl")
    )
    found = queries.select("query_id", "index_id").join(lists, ["query_id", "index_id"], "left")
    return found.select(
        "index_id", F.col("query_id").alias("id"),
        F.coalesce(F.transform("_l", lambda x: x["term"]), F.array().cast("array<string>")).alias("terms"),
        F.coalesce(F.transform("_l", lambda x: x["w"]), F.array().cast("array<double>")).alias("weights"),
        F.coalesce("avgdl", F.lit(1.0)).alias("avgdl"),
    )


def _top(totals: DataFrame, limit: int, shown: tuple[str, ...] = ()) -> DataFrame:
    per_query = Window.partitionBy("query_id", "index_id")
    order = per_query.orderBy(F.desc("raw"), "chunk_id")
    kept = totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    best = F.max("raw").over(per_query)
    scaled = F.when(best > 0, F.col("raw") / best).otherwise(F.lit(0.0))
    return kept.select("query_id", "index_id", "chunk_id", "rank", F.round(scaled, DIGITS).alias("safe_score"), *shown)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id", "index_id").orderBy(F.desc("raw"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def lexical_weights(asked: DataFrame, queries: DataFrame, words: DataFrame, stats: DataFrame) -> DataFrame:
    """Term weights of every query from the asked postings' frequencies and the collection's size and mean length."""
    return query_weights(queries, words, frequencies(asked), stats)


def eligible_heads(docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The `limit` smallest chunk ids of each queried index: chunks without a score rank in id
    order, so no other chunk without one can reach the result."""
    order = Window.partitionBy("index_id").orderBy("chunk_id")
    asked = queries.select("index_id").distinct()
    heads = docs.join(asked, "index_id", "left_semi")
    return heads.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def lexical_rows(index: StoredIndex, queries: DataFrame, limit: int, documents: DataFrame | None = None, shown: tuple[str, ...] = ()) -> DataFrame:
    """The `limit` best BM25 scores per query and index, with the columns `shown` of their documents.

    documents: the eligible rows of index.documents, if not all; frequencies and means are theirs then.
    """
    words = query_terms(queries)
    asked = asked_postings(index, words, documents)
    stats = index.stats if documents is None else collection_stats(documents)
    found = lexical_best(asked, lexical_weights(asked, queries, words, stats), limit, DIGITS)
    return _named(found, index, queries, limit, documents, shown)


def _named(found: DataFrame, index: StoredIndex, queries: DataFrame, limit: int, documents: DataFrame | None, shown: tuple[str, ...]) -> DataFrame:
    """Ranked rows from what the shards found above zero, and from the smallest ids where that is less than `limit`."""
    # Rows that tie with the last place stay until their ids are known.
    place = Window.partitionBy("query_id", "index_id").orderBy(F.desc("raw"))
    cut = found.select("index_id", "query_id", "shard", "place", "raw").withColumn("_r", F.rank().over(place)).filter(F.col("_r") <= limit).drop("_r")
    # Written, so that these few rows go to the documents and not all documents to them.
    cut = materialize(cut, "found-rows")
    docs = (index.documents if documents is None else documents).select("index_id", "shard", "place", "chunk_id", *shown)
    scored = cut.join(docs, ["index_id", "shard", "place"]).select("query_id", "index_id", "chunk_id", "raw", *shown)
    heads = eligible_heads(docs, queries, limit).join(queries.select("query_id", "index_id"), "index_id").select(
        "query_id", "index_id", "chunk_id", F.lit(0.0).alias("raw"), *shown)
    both = scored.unionByName(heads).repartition("query_id", "index_id").groupBy("query_id", "index_id", "chunk_id").agg(
        F.max("raw").alias("raw"), *[F.any_value(c).alias(c) for c in shown])
    return _top(both, limit, shown)


def retrieve_from_postings(index: StoredIndex, queries: DataFrame, limit: int = 10) -> DataFrame:
    """BM25 over a stored index: (query_id, index_id, chunk_id, rank, safe_score)."""
    return lexical_rows(index, queries, limit)


# ---------------------------------------------------------------- retrievers


_SHOWN = ("document_id", "hierarchy_context", "citations")


def _lexical(
    index: StoredIndex, queries: DataFrame, limit: int, contributor: str, kind: str, documents: DataFrame | None, **extra: Column,
) -> DataFrame:
    """Ranked rows of the index as candidates; what they show comes with the join that names them."""
    shown = tuple(c for c in _SHOWN if c in index.documents.columns)
    ranked = lexical_rows(index, queries, limit, documents, shown)
    return ranked.select(*candidate(contributor, kind, index.documents.columns, **extra))


def _filtered(index: StoredIndex, filters: Filters) -> DataFrame | None:
    return eligible(index.documents, filters) if filters != Filters() else None


def candidate(contributor: str, kind: str, columns: list[str], **extra: Column) -> list[Column]:
    """Columns of a candidate row; citations split into aligned id and locator arrays."""
    path = F.when(F.size("hierarchy_context") > 0, F.col("hierarchy_context")) \
        if "hierarchy_context" in columns else F.lit(None).cast("array<string>")
    cited = "citations" in columns
    none = F.lit(None).cast("array<string>")
    return [
        F.col("query_id"),
        F.lit(contributor).alias("contributor_id"),
        stable_id("cnd", F.col("index_id"), F.lit(contributor), F.col("chunk_id")).alias("candidate_id"),
        F.col("index_id"), F.col("document_id"), F.col("chunk_id"),
        (F.transform("citations", lambda c: c["element_id"]) if cited else none).alias("element_ids"),
        (F.transform("citations", lambda c: c["locator"]) if cited else none).alias("locators"),
        F.col("rank"), F.col("safe_score"), F.lit(kind).alias("score_kind"),
        F.struct(
            path.alias("hierarchy_path"),
            extra.get("relation", F.lit(None).cast("string")).alias("relation"),
            extra.get("table_element_ids", none).alias("table_element_ids"),
            extra.get("matched_filter_keys", none).alias("matched_filter_keys"),
        ).alias("projection"),
    ]


def retrieve_keyword(
    search_docs: DataFrame | StoredIndex, queries: DataFrame, limit: int = 10, filters: Filters = Filters(),
    contributor: str = "keyword",
) -> DataFrame:
    index = as_index(search_docs, vectors=False)
    return _lexical(index, queries, limit, contributor, "bm25", _filtered(index, filters))


def retrieve_metadata(
    search_docs: DataFrame | StoredIndex, queries: DataFrame, limit: int = 10, filters: Filters = Filters(),
    contributor: str = "metadata",
) -> DataFrame:
    index = as_index(search_docs, vectors=False)
    keys = F.array(*[F.lit(k) for k in filters.keys()]).cast("array<string>")
    return _lexical(index, queries, limit, contributor, "metadata_bm25", _filtered(index, filters), matched_filter_keys=keys)


def retrieve_table(
    search_docs: DataFrame | StoredIndex, queries: DataFrame, limit: int = 10, filters: Filters = Filters(),
    contributor: str = "table",
) -> DataFrame:
    sheet = lambda c: c["locator"]["kind"] == "spreadsheet"
    index = as_index(search_docs, vectors=False)
    docs = eligible(index.documents, filters).filter(F.exists("citations", sheet))
    ids = F.transform(F.filter("citations", sheet), lambda c: c["element_id"])
    return _lexical(index, queries, limit, contributor, "table_bm25", docs, table_element_ids=ids)


def related_chunks(docs: DataFrame, relation: str) -> DataFrame:
    """Eligible chunks that are parents or children of eligible chunks; each once."""
    if relation == "self":
        return docs
    if relation == "parent":
        linked = docs.select("index_id", F.col("parent_chunk_id").alias("chunk_id"))
    elif relation == "children":
        linked = docs.select("index_id", F.explode("child_chunk_ids").alias("chunk_id"))
    else:
        raise ValueError(f"unknown relation {relation}")
    return docs.join(linked, ["index_id", "chunk_id"], "left_semi")


def hierarchy_text() -> Column:
    """What an index for hierarchy retrieval holds: the heading path, then the chunk."""
    return F.concat_ws(" ", F.array_join("hierarchy_context", " "), F.col("keyword_text"))


def retrieve_hierarchy(
    search_docs: DataFrame | StoredIndex, queries: DataFrame, limit: int = 10, filters: Filters = Filters(),
    relation_mode: str = "self", contributor: str = "hierarchy",
) -> DataFrame:
    """A stored index must have been written with `hierarchy_text`."""
    index = as_index(search_docs, hierarchy_text(), vectors=False)
    docs = _filtered(index, filters)
    if relation_mode != "self":
        docs = related_chunks(index.documents if docs is None else docs, relation_mode)
    relation = F.lit(None if relation_mode == "self" else relation_mode).cast("string")
    return _lexical(index, queries, limit, contributor, "hierarchy_bm25", docs, relation=relation)


def vector_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select("index_id", F.col(key).alias("id"), F.col("embedding").alias("vector"))


def nearest(docs: DataFrame, queries: DataFrame, limit: int, clamp: bool = True) -> DataFrame:
    """The `limit` largest dot products per query and index: (query_id, index_id, chunk_id, raw, rank)."""
    own, asked = vector_rows(docs, "chunk_id"), vector_rows(queries, "query_id")
    counted = lambda rows: rows.select("index_id", F.lit(1).alias("rows"))
    dealt = tiles(counted(own), counted(asked), salts(docs))
    pairs = best_of_pairs(doc_blocks(own), query_blocks(asked, DOC_ROWS), limit, DIGITS, clamp, dealt)
    return _best(pairs, limit)


def retrieve_vector(
    search_docs: DataFrame | StoredIndex, queries: DataFrame, limit: int = 10, filters: Filters = Filters(),
    contributor: str = "vector",
) -> DataFrame:
    """Exact cosine of unit vectors; both sides carry `embedding`. Mixed dimensions fail the job."""
    index = as_index(search_docs, lexical=False)
    documents = _filtered(index, filters)
    shown = tuple(c for c in _SHOWN if c in index.documents.columns)
    found = vector_best(index, queries, limit, DIGITS, documents)
    return _named(found, index, queries, limit, documents, shown).select(*candidate(contributor, "cosine", index.documents.columns))


def retrieval_metrics(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Per query and index: candidates, filtered chunks, and whether nothing was found."""
    keys = ["query_id", "index_id"]
    found = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("candidates"))
    return counts.join(found, keys, "left").select(
        *keys,
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        "filtered_count",
        F.col("candidates").isNull().alias("no_candidates"),
    )

"""Rendering, chunk packing, chunk identities and enrichment.

Greedy packing looks sequential, but where the next group starts depends only on where this one
starts. Each block of segments therefore gives a small table "entry offset -> exit offset" (at most
`max_tokens` entries, because a segment has at least one word). Tables are composed FAN at a time, level
after level, which gives the entry of every block; then every block emits its own groups. A document longer
than one block is packed by many tasks, and so is a table: its rows are packed beside the words of its prefix.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import stable_id
from ..functions.text import token_count, words
from ..session import materialize
from .scans import BLOCK, block_of, blocked_row_number, blocked_scan
from .structure import path_from_marks, path_marks


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed"
    max_tokens: int = 256
    overlap_tokens: int = 0
    max_children: int = 32

    def __post_init__(self) -> None:
        if self.strategy not in ("fixed", "hierarchy", "table", "parent_child"):
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.max_tokens < 1 or not 0 <= self.overlap_tokens < self.max_tokens or self.max_children < 1:
            raise ValueError("chunk limits are out of range")

    @property
    def identity(self) -> str:
        return f"v1:{self.strategy}:{self.max_tokens}:{self.overlap_tokens}:{self.max_children}"


# ---------------------------------------------------------------- rendering


def render_text(kind: Column, text: Column, items: Column) -> Column:
    """Text of one element; kinds without text render to ''."""
    lines = F.transform(
        items, lambda i: F.concat(F.repeat(F.lit("  "), i["level"]), F.lit("- "), i["text"])
    )
    return (
        F.when(kind == "list", F.coalesce(F.array_join(lines, "\n"), F.lit("")))
        .when(kind.isin("heading", "paragraph", "caption", "code"), F.coalesce(text, F.lit("")))
        .otherwise(F.lit(""))
    )


def render_elements(elements: DataFrame) -> DataFrame:
    """Elements with their rendered `content`; empty ones are dropped."""
    items = F.col("items") if "items" in elements.columns else F.lit(None).cast(
        "array<struct<text:string,level:int>>"
    )
    return elements.withColumn("content", render_text(F.col("kind"), F.col("text"), items)).filter(
        F.size(words(F.col("content"))) > 0
    )


def table_rows(cells: DataFrame) -> DataFrame:
    """One line per starting row: `c{col}[{rows}x{cols}]=text` ordered by column."""
    cell = F.format_string("c%d[%dx%d]=%s", "column", "row_span", "column_span", "text")
    return cells.groupBy("document_id", "table_id", "row").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("column", cell.alias("text")))), lambda c: c["text"]
            ),
            " | ",
        ).alias("line")
    )


def table_prefix(tables: DataFrame, cells: DataFrame, elements: DataFrame) -> DataFrame:
    """Caption and header lines repeated in front of every row group."""
    headers = (
        cells.filter("is_header").groupBy("document_id", "table_id")
        .agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("row", "column", "text"))), lambda c: c["text"]),
            " | ").alias("_headers"))
    )
    captions = elements.filter("kind = 'caption'").select(
        "document_id", F.col("id").alias("caption_element_id"), F.col("text").alias("_caption")
    )
    lines = F.array_compact(
        F.array(
            F.when(F.length("_caption") > 0, F.concat(F.lit("Table: "), F.col("_caption"))),
            F.when(F.col("_headers").isNotNull(), F.concat(F.lit("Headers: "), F.col("_headers"))),
        )
    )
    return (
        tables.withColumnRenamed("id", "table_id")
        .join(captions, ["document_id", "caption_element_id"], "left")
        .join(headers, ["document_id", "table_id"], "left")
        .select("document_id", "table_id", "element_id", "rows", F.array_join(lines, "\n").alias("prefix"))
    )


def render_tables(
    tables: DataFrame, cells: DataFrame, elements: DataFrame, max_tokens: int = 256, block: int = BLOCK
) -> DataFrame:
    """Row groups of each table as text. Tables with an oversized row or prefix are left out
    (see `table_rejects`); rows without starting cells are blank and join nothing.

    A group holds as many rows as fit beside the prefix; a row that does not fit stands alone, and in front of
    such a first row stands the prefix alone.
    """
    keys = ["document_id", "table_id"]
    prefixes = table_prefix(tables, cells, elements).withColumn("_head", token_count(F.col("prefix")))
    lines = table_rows(cells).withColumn("size", token_count(F.col("line")))
    numbered = materialize(blocked_row_number(lines, keys, block_of("row", block), [F.col("row")], "pos", 0), "table-lines")
    # By rows, so that a table of any length is no list: its largest row and its first one.
    measured = numbered.groupBy(*keys).agg(F.max("size").alias("_most"), F.max(F.when(F.col("pos") == 0, F.col("size"))).alias("_lead"))
    fits = materialize(prefixes.join(measured, keys).filter((F.col("_head") <= max_tokens) & (F.col("_most") <= max_tokens)), "tables")
    room = F.greatest(F.lit(1), F.lit(max_tokens) - F.col("_head"))
    segs = numbered.join(fits.select(*keys, room.alias("limit")), keys).select(
        F.struct(*keys).alias("document_id"), "pos", F.least("size", "limit").alias("tokens"), "line", "limit")
    packed = pack(segs, "pos", max_tokens, block=block, limit=True)
    groups = blocked_row_number(packed, ["document_id"], block_of("start", block), [F.col("start")], "_n", 0).select(
        F.col("document_id.document_id").alias("document_id"), F.col("document_id.table_id").alias("table_id"), "_n",
        F.transform("group", lambda g: g["line"]).alias("_body"))
    alone = (F.col("_head") > 0) & (F.col("_head") + F.col("_lead") > max_tokens)
    heads = fits.filter(alone).select(*keys, F.lit(-1).cast("long").alias("_n"), F.array().cast("array<string>").alias("_body"))
    text = F.array_join(F.filter(F.concat(F.array("prefix"), F.col("_body")), lambda x: x != ""), "\n")
    return groups.unionByName(heads).join(fits, keys).select(
        *keys, "element_id", (F.col("_n") + alone.cast("int")).cast("int").alias("part"), text.alias("content"))


def table_rejects(tables: DataFrame, cells: DataFrame, elements: DataFrame, max_tokens: int = 256) -> DataFrame:
    rows = table_rows(cells).filter(token_count(F.col("line")) > max_tokens).select("document_id")
    heads = table_prefix(tables, cells, elements).filter(token_count(F.col("prefix")) > max_tokens)
    return rows.unionByName(heads.select("document_id")).distinct().select(
        F.lit("document").alias("entity"), F.col("document_id").alias("id"),
        F.lit("table_row_tokens").alias("rule"), F.lit("CANONICAL_FIELD_UNBOUNDED").alias("code"),
    )


# ---------------------------------------------------------------- packing


def _steps(tokens: np.ndarray, breaks: np.ndarray, max_tokens: int, overlap: int, max_items: int):
    """For every possible group start: where the group stops and where the next one starts.

    `breaks` marks segments that always open a new group, without overlap.
    """
    n = len(tokens)
    total = np.concatenate([[0], np.cumsum(tokens)])
    starts = np.arange(n)
    stop = np.searchsorted(total, total[:-1] + max_tokens, side="right") - 1
    opening = np.where(breaks, starts, n)
    next_break = np.append(np.minimum.accumulate(opening[::-1])[::-1], n)[1:]
    stop = np.minimum(np.minimum(stop, starts + max_items), next_break)
    following = np.append(tokens, 0)[stop]
    room = np.maximum(np.minimum(overlap, max_tokens - following), 0)
    back = np.searchsorted(total, total[stop] - room, side="left")
    nxt = np.maximum(np.minimum(back, stop), starts + 1)
    return stop, np.where(stop == next_break, stop, nxt)


def _walk(tokens, breaks, limit: int | None, limits: tuple[int, int, int]):
    own = limits if limit is None else (limit, *limits[1:])
    return _steps(np.asarray(tokens, dtype=np.int64), np.asarray(breaks, dtype=bool), *own)


def _given(limit: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in limit]


def _exits(limits: tuple[int, int, int], block: int):
    reach = min(limits[0], limits[2])

    @F.pandas_udf("array<int>")
    def exits(tokens: pd.Series, breaks: pd.Series, limit: pd.Series) -> pd.Series:
        def one(sizes: np.ndarray, marks: np.ndarray, own: int | None) -> np.ndarray:
            _, nxt = _walk(sizes, marks, own, limits)
            at = np.arange(min(reach, len(sizes)))
            while (inside := at < block).any():
                at[inside] = nxt[at[inside]]
            return (at - block).astype(np.int32)

        return pd.Series([one(t, b, x) for t, b, x in zip(tokens, breaks, _given(limit))])

    return exits


def _ranges(limits: tuple[int, int, int], block: int | None):
    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def ranges(tokens: pd.Series, breaks: pd.Series, entry: pd.Series, limit: pd.Series) -> pd.Series:
        def one(sizes: np.ndarray, marks: np.ndarray, at: int, own: int | None) -> list[dict]:
            stop, nxt = _walk(sizes, marks, own, limits)
            last = len(sizes) if block is None else min(block, len(sizes))
            groups = []
            while at < last:
                groups.append({"start": int(at), "stop": int(stop[at])})
                at = nxt[at]
            return groups

        return pd.Series([one(t, b, int(e), x) for t, b, e, x in zip(tokens, breaks, entry, _given(limit))])

    return ranges


def _sizes() -> Column:
    return F.transform("segs", lambda s: s["tokens"].cast("int"))


def _slice_groups(blocks: DataFrame, ranges, breaks: Column, limit: Column) -> DataFrame:
    return blocks.select(
        "*", F.posexplode(ranges(_sizes(), breaks, F.col("entry").cast("int"), limit)).alias("_n", "_g")
    ).withColumn(
        "group", F.slice("segs", F.col("_g.start") + 1, F.col("_g.stop") - F.col("_g.start"))
    )


def _breaks(strategy: str) -> Column:
    """Where a block's segments must open a group: at a new heading path, or around tables."""
    segs = F.col("segs")
    if strategy == "hierarchy":
        return F.transform(segs, lambda s, i: (i > 0) & (s["context"] != F.get(segs, i - 1)["context"]))
    if strategy == "table":
        return F.transform(segs, lambda s, i: (i > 0) & (s["is_table"] | F.get(segs, i - 1)["is_table"]))
    return F.transform(segs, lambda s: F.lit(False))


#: Exit maps composed in one row.
FAN = 512


def _runs(maps: DataFrame, fan: int) -> DataFrame:
    """Maps of `fan` consecutive blocks as a list: (document_id, run, maps)."""
    run = F.floor(F.col("at") / fan).cast("long").alias("run")
    return maps.groupBy("document_id", run).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "map"))), lambda x: x["map"]).alias("maps"))


def _entries(maps: DataFrame, fan: int = FAN) -> DataFrame:
    """(document_id, at, entry): where each block behind a mapped one begins, from maps (document_id, at, map).

    Maps are composed in runs of `fan`, and these in runs again: what the top level lists of a document is one
    map for every fan * fan blocks. On the way back each run hands its entry to its members.
    """
    through = lambda maps: F.aggregate(
        F.slice(maps, 2, fan), maps[0], lambda acc, m: F.transform(acc, lambda e: F.element_at(m, e + 1)))
    first = _runs(maps, fan)
    second = _runs(first.select("document_id", F.col("run").alias("at"), through(F.col("maps")).alias("map")), fan)
    top = second.select("document_id", F.col("run").alias("at"), through(F.col("maps")).alias("map")).groupBy("document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "map"))), lambda x: x["map"]).alias("maps"))
    chain = lambda start: F.aggregate(
        "maps", F.array(start), lambda acc, m: F.concat(acc, F.array(F.element_at(m, F.element_at(acc, -1) + 1))))
    tops = top.select("document_id", F.posexplode(chain(F.lit(0))).alias("run", "entry"))

    def down(runs: DataFrame, entries: DataFrame) -> DataFrame:
        begun = runs.join(entries, ["document_id", "run"])
        each = begun.select("document_id", "run", F.posexplode(chain(F.col("entry"))).alias("_n", "entry"))
        # The end of a full run is also the beginning of the next one.
        return each.select("document_id", (F.col("run") * fan + F.col("_n")).alias("run"), "entry").distinct()

    return down(first, down(second, tops)).withColumnRenamed("run", "at")


def _gathered(segments: DataFrame, position: str) -> DataFrame:
    """One row for each document, none longer than a block: (document_id, segs)."""
    payload = [c for c in segments.columns if c not in ("document_id", position)]
    return segments.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("_pos"), *payload))).alias("segs"))


def pack(
    segments: DataFrame,
    position: str,
    max_tokens: int,
    overlap: int = 0,
    max_items: int | None = None,
    strategy: str = "fixed",
    block: int | None = BLOCK,
    limit: bool = False,
) -> DataFrame:
    """Greedy groups of consecutive segments: rows (document_id, start, group array<struct>).

    `position` counts from 0 without gaps per document; every segment has 1..max_tokens tokens.
    block None: every document is one block, which no map has to enter.
    limit: segments bring a smaller bound of their document's groups in a column of that name.
    """
    limits = (max_tokens, overlap, max_items or max_tokens)
    halo = min(limits[0], limits[2])
    breaks = _breaks(strategy)
    bound = F.col("segs")[0]["limit"].cast("int") if limit else F.lit(None).cast("int")
    start = F.col("group")[0]["_pos"].cast("long").alias("start")
    if block is None:
        rows = _gathered(segments, position).withColumn("entry", F.lit(0))
        return _slice_groups(rows, _ranges(limits, None), breaks, bound).select("document_id", start, "group")
    width = max(block, halo)
    own = block_of(position, width)
    copies = F.when(
        (F.col(position) % width < halo) & (own > 0), F.array(own, own - 1)
    ).otherwise(F.array(own))
    keys = ["document_id", "_blk"]
    payload = [c for c in segments.columns if c not in (*keys, position)]
    blocks = (
        segments.withColumn("_blk", F.explode(copies))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(F.col(position).alias("_pos"), *payload))).alias("segs"))
    )
    # Written once: only blocks with another one behind them have a map, and every level of the composition reads them.
    maps = materialize(blocks.filter(F.size("segs") > width).select(
        "document_id", F.col("_blk").alias("at"), _exits(limits, width)(_sizes(), breaks, bound).alias("map")), "exit-maps")
    entries = _entries(maps).withColumnRenamed("at", "_blk")
    entered = blocks.join(entries, keys, "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    grouped = _slice_groups(entered, _ranges(limits, width), breaks, bound)
    return grouped.select("document_id", start, "group")


def pack_in_row(df: DataFrame, segs: str, max_tokens: int, overlap: int = 0) -> DataFrame:
    """The same groups where all segments of a document already sit in one row: no shuffle."""
    ready = df.withColumnRenamed(segs, "segs").withColumn("entry", F.lit(0))
    grouped = _slice_groups(ready, _ranges((max_tokens, overlap, max_tokens), None), _breaks("fixed"), F.lit(None).cast("int"))
    return grouped.withColumn("start", F.col("_g.start").cast("long")).withColumn(
        "ordinal", F.col("_n").cast("long")
    ).drop("_n", "_g", "segs", "entry")


# ---------------------------------------------------------------- chunks


def make_chunk(config: ChunkConfig, group: Column, parent: Column, default_language: Column) -> list[Column]:
    """Columns of a finished chunk from its array of segments."""
    content = F.array_join(F.transform(group, lambda s: s["content"]), "\n")
    cited = F.array_distinct(F.flatten(F.transform(group, lambda s: s["citations"])))
    ids = F.transform(cited, lambda c: c["element_id"])
    spoken = F.filter(F.transform(group, lambda s: s["language"]), lambda x: x.isNotNull())
    return [
        stable_id(
            "chk", F.col("document_id"), F.lit(config.identity), F.array_join(ids, ","),
            F.coalesce(parent, F.lit("")), content,
        ).alias("chunk_id"),
        content.alias("content"),
        F.aggregate(group, F.lit(0), lambda a, s: a + s["tokens"].cast("int")).alias("token_count"),
        ids.alias("source_element_ids"),
        cited.alias("citations"),
        parent.alias("parent_chunk_id"),
        group[0]["context"].alias("hierarchy_context"),
        F.coalesce(F.get(spoken, F.lit(0)), default_language).alias("language"),
    ]


def text_chunks(
    docs: DataFrame, config: ChunkConfig = ChunkConfig(), element_words: int = 480, keep: Sequence[str] = ()
) -> DataFrame:
    """Plain page text straight to chunks inside each document's row: a scan and nothing else.

    Input (document_id, pages array<string>, language). Documents with a segment above the limit
    are rejected whole, exactly as on the element path.
    """
    from ..schemas import locator
    from ..sources.elements import page_elements

    segs = F.transform(
        page_elements(F.col("pages"), F.col("document_id"), element_words),
        lambda e: F.struct(
            e["text"].alias("content"),
            token_count(e["text"]).alias("tokens"),
            F.array(
                F.struct(
                    e["id"].alias("element_id"),
                    locator(
                        kind=F.lit("pdf"), page_number=e["page_number"],
                        x0=F.lit(0.0), y0=F.lit(0.0), x1=F.lit(1.0), y1=F.lit(1.0),
                    ).alias("locator"),
                )
            ).alias("citations"),
            F.array().cast("array<string>").alias("context"),
            F.lit(None).cast("string").alias("language"),
        ),
    )
    rows = docs.select("document_id", "language", *keep, segs.alias("_segs"))
    if element_words > config.max_tokens:
        rows = rows.filter(~F.exists("_segs", lambda s: s["tokens"] > config.max_tokens))
    grouped = pack_in_row(rows, "_segs", config.max_tokens, config.overlap_tokens)
    none = F.lit(None).cast("string")
    return grouped.select(
        "document_id", *keep, "start", "ordinal",
        *make_chunk(config, F.col("group"), none, F.col("language")),
        F.array().cast("array<string>").alias("child_chunk_ids"),
    )


def chunk_ordinals(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add `ordinal`, the place of a chunk in its document's index order (parents come first)."""
    level = F.col("parent_chunk_id").isNotNull().cast("int")
    bucket = level * F.lit(1 << 40) + block_of("start", block)
    return blocked_row_number(chunks, ["document_id"], bucket, [level, F.col("start")], "ordinal", 0)


def segments(
    elements: DataFrame,
    config: ChunkConfig,
    tables: DataFrame | None = None,
    cells: DataFrame | None = None,
    block: int | None = BLOCK,
) -> DataFrame:
    """Renderable segments numbered from 0 per document, with the document's largest segment.

    Heading paths, numbering and the maximum come from one scan over the elements.
    """
    items = F.col("items") if "items" in elements.columns else F.lit(None).cast(
        "array<struct<text:string,level:int>>"
    )
    language = F.col("language") if "language" in elements.columns else F.lit(None).cast("string")
    own_text = render_text(F.col("kind"), F.col("text"), items)
    own = F.array(F.struct(F.col("id").alias("element_id"), "locator"))
    rows = elements.withColumn("language", language).withColumn("_own", own_text).withColumn("_size", token_count(F.col("_own")))
    rows = rows.withColumn("citations", own).withColumn("_n", (F.col("_size") > 0).cast("int"))
    parts = None
    if tables is not None:
        parts = materialize(render_tables(tables, cells, elements, config.max_tokens, block).select(
            "document_id", F.col("element_id").alias("id"), "part", "content", token_count(F.col("content")).alias("tokens")), "table-parts")
        counted = parts.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("_many"), F.max("tokens").alias("_most"))
        table = F.col("kind") == "table"
        rows = rows.join(counted.join(table_citations(tables, elements), ["document_id", "id"]), ["document_id", "id"], "left")
        rows = (
            rows.withColumn("_n", F.when(table, F.coalesce("_many", F.lit(0))).otherwise(F.col("_n")).cast("int"))
            .withColumn("_size", F.when(table, F.col("_most")).otherwise(F.col("_size")))
            .withColumn("citations", F.when(table, F.col("_cited")).otherwise(F.col("citations")))
        )
    rows = rows.select("document_id", "id", "reading_order", "kind", "level", "text", "language", "citations", "_own", "_size", "_n")
    scanned = blocked_scan(
        rows, ["document_id"], "reading_order", path_marks(),
        sums={"_first": F.col("_n")}, maxima={"largest": F.when(F.col("_n") > 0, F.col("_size"))}, width=block,
    ).filter("_n > 0")
    shown = ["document_id", "content", "tokens", "context", "citations", "language", "is_table", "largest"]
    ready = scanned.withColumn("context", path_from_marks()).withColumn("is_table", F.col("kind") == "table")
    plain = ready.filter("NOT is_table") if parts is not None else ready
    out = plain.select(*[c for c in shown if c not in ("content", "tokens")], F.col("_own").alias("content"), F.col("_size").alias("tokens"), F.col("_first").alias("pos"))
    if parts is not None:
        # A table's parts meet its element by row, so no table is a list.
        own_parts = ready.filter("is_table").drop("tokens", "content").join(parts, ["document_id", "id"])
        out = out.unionByName(own_parts.select(*shown, (F.col("_first") + F.col("part")).alias("pos")))
    return out.select("document_id", "pos", *shown[1:])


def table_citations(tables: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements cited by a table's chunks: itself, caption and related, in reading order."""
    wanted = tables.select(
        "document_id", F.col("element_id").alias("_owner"),
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array("element_id"),
                    F.coalesce("related_element_ids", F.array().cast("array<string>")),
                    F.array_compact(F.array("caption_element_id")),
                )
            )
        ).alias("element_id"),
    )
    located = elements.select("document_id", F.col("id").alias("element_id"), "reading_order", "locator")
    ordered = F.array_sort(
        F.collect_list(F.struct("reading_order", "element_id", "locator")),
        lambda a, b: (a["reading_order"] - b["reading_order"]).cast("int"),
    )
    return (
        wanted.join(located, ["document_id", "element_id"])
        .groupBy("document_id", F.col("_owner").alias("id"))
        .agg(
            F.transform(
                ordered,
                lambda c: F.struct(c["element_id"].alias("element_id"), c["locator"].alias("locator")),
            ).alias("_cited")
        )
    )


def chunk(
    elements: DataFrame,
    config: ChunkConfig = ChunkConfig(),
    tables: DataFrame | None = None,
    cells: DataFrame | None = None,
    languages: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Chunks of every document under one strategy; rejected documents give none.

    Documents of up to a block of elements move once and are chunked where they lie; longer ones are cut into blocks.
    Tables have rows of their own, so with them all documents are cut.
    """
    if tables is not None:
        return _chunk(elements, config, tables, cells, languages, block)
    long = materialize(elements.groupBy("document_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select("document_id"), "long-documents")
    if long.isEmpty():
        return _chunk(elements, config, None, None, languages, None)
    short = _chunk(elements.join(long, "document_id", "left_anti"), config, None, None, languages, None)
    return short.unionByName(_chunk(elements.join(long, "document_id", "left_semi"), config, None, None, languages, block))


def _chunk(
    elements: DataFrame, config: ChunkConfig, tables: DataFrame | None, cells: DataFrame | None, languages: DataFrame | None, block: int | None,
) -> DataFrame:
    segs = segments(elements, config, tables, cells, block).filter(F.col("largest") <= config.max_tokens)
    if tables is not None:
        refused = table_rejects(tables, cells, elements, config.max_tokens)
        segs = segs.join(refused.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    if config.strategy == "parent_child" and block is None:
        return _linked(_families_in_row(segs.drop("largest"), config, languages), config)
    groups = pack(
        segs.drop("largest"), "pos", config.max_tokens, config.overlap_tokens,
        strategy=config.strategy, block=block,
    )
    if languages is not None:
        groups = groups.join(languages, "document_id", "left")
    else:
        groups = groups.withColumn("document_language", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    if config.strategy == "parent_child":
        return _linked(_families(groups, config, block), config)
    return groups.select(
        "document_id", "start", *make_chunk(config, F.col("group"), none, F.col("document_language")),
        F.array().cast("array<string>").alias("child_chunk_ids"),
    )


def _tokens_of(group: Column) -> Column:
    return F.aggregate(group, F.lit(0), lambda a, s: a + s["tokens"].cast("int"))


def _families(groups: DataFrame, config: ChunkConfig, block: int) -> DataFrame:
    """The packed children packed again: (document_id, kids)."""
    kids = blocked_row_number(
        groups.select("document_id", "document_language", "start", "group", _tokens_of(F.col("group")).alias("tokens")),
        ["document_id"], block_of("start", block), [F.col("start")], "child", 0,
    )
    packed = pack(kids, "child", config.max_tokens, 0, config.max_children, block=block)
    return packed.select("document_id", F.col("group").alias("kids"))


def _families_in_row(segs: DataFrame, config: ChunkConfig, languages: DataFrame | None) -> DataFrame:
    """The same families of documents within one block, packed twice inside their row."""
    plain, free = _breaks(config.strategy), F.lit(None).cast("int")
    rows = _gathered(segs, "pos")
    named = rows.join(languages, "document_id", "left") if languages is not None else rows.withColumn("document_language", F.lit(None).cast("string"))
    ranges = _ranges((config.max_tokens, config.overlap_tokens, config.max_tokens), None)
    cut = named.withColumn("_r", ranges(_sizes(), plain, F.lit(0), free)).withColumn(
        "_g", F.transform("_r", lambda g: F.slice("segs", g["start"] + 1, g["stop"] - g["start"])))
    kids = F.transform("_g", lambda g: F.struct(
        g[0]["_pos"].cast("long").alias("start"), g.alias("group"), _tokens_of(g).alias("tokens"), F.col("document_language")))
    ready = cut.select("document_id", kids.alias("segs"), F.lit(0).alias("entry"))
    packed = _slice_groups(ready, _ranges((config.max_tokens, 0, config.max_children), None), plain, free)
    return packed.select("document_id", F.col("group").alias("kids"))


def _linked(families: DataFrame, config: ChunkConfig) -> DataFrame:
    """Parents, children and their links come out of one row."""
    none = F.lit(None).cast("string")
    no_ids = F.array().cast("array<string>")
    language = F.col("kids")[0]["document_language"]
    flat = F.flatten(F.transform("kids", lambda k: k["group"]))
    parents = families.select(
        "document_id", "kids", F.col("kids")[0]["start"].alias("start"),
        F.struct(*make_chunk(config, flat, none, language)).alias("_p"),
    )
    made = parents.withColumn(
        "_c",
        F.transform(
            "kids",
            lambda k: F.struct(
                k["start"].alias("start"),
                F.struct(*make_chunk(config, k["group"], F.col("_p.chunk_id"), k["document_language"])).alias("c"),
            ),
        ),
    )
    links = F.transform("_c", lambda k: k["c"]["chunk_id"])
    rows = F.concat(
        F.array(F.struct("start", F.col("_p").alias("c"), links.alias("kids"))),
        F.transform("_c", lambda k: F.struct(k["start"].alias("start"), k["c"].alias("c"), no_ids.alias("kids"))),
    )
    return made.select("document_id", F.explode(rows).alias("r")).select(
        "document_id", "r.start", "r.c.*", F.col("r.kids").alias("child_chunk_ids")
    )


def chunk_rejects(elements: DataFrame, config: ChunkConfig, tables=None, cells=None) -> DataFrame:
    segs = segments(elements, config, tables, cells)
    return segs.filter(F.col("largest") > config.max_tokens).select("document_id").distinct().select(
        F.lit("document").alias("entity"), F.col("document_id").alias("id"),
        F.lit("segment_tokens").alias("rule"), F.lit("CANONICAL_FIELD_UNBOUNDED").alias("code"),
    )


# ---------------------------------------------------------------- enrichment and counts


def enrich(
    chunks: DataFrame, fields: dict[str, str | int | float | bool | list], producer: str, config_digest: str
) -> DataFrame:
    """Add constant fields with their producer and the chunk they were made for; lists are kept as JSON.
    Chunks that already hold one of the fields are left out."""
    kinds = {str: "string", bool: "boolean", int: "integer", float: "number", list: "list"}

    def shown(value: object) -> str:
        if isinstance(value, list):
            return json.dumps(value, ensure_ascii=False)
        return str(value).lower() if isinstance(value, bool) else str(value)

    added = F.create_map(
        *[
            part
            for name, value in fields.items()
            for part in (
                F.lit(name),
                F.struct(
                    F.lit(shown(value)).alias("value"),
                    F.lit(kinds[type(value)]).alias("value_type"),
                    F.lit(producer).alias("producer"),
                    F.lit(config_digest).alias("config_digest"),
                    F.col("chunk_id").alias("source_chunk_id"),
                ),
            )
        ]
    )
    taken = F.lit(False)
    for name in fields:
        taken = taken | F.map_contains_key("enrichments", name)
    return chunks.filter(~taken).withColumn("enrichments", F.map_concat("enrichments", added))


def enrich_rejects(chunks: DataFrame, fields: Sequence[str], config: ChunkConfig) -> DataFrame:
    """Chunks whose id does not follow from their content, or that already hold a field."""
    expected = stable_id(
        "chk", F.col("document_id"), F.lit(config.identity), F.array_join("source_element_ids", ","),
        F.coalesce("parent_chunk_id", F.lit("")), F.col("content"),
    )
    taken = F.lit(False)
    for name in fields:
        taken = taken | F.map_contains_key("enrichments", name)
    return chunks.filter(taken | (expected != F.col("chunk_id"))).select(
        F.lit("chunk").alias("entity"), F.col("chunk_id").alias("id"),
        F.when(taken, F.lit("enrichment_exists")).otherwise(F.lit("chunk_identity")).alias("rule"),
        F.lit("CANONICAL_INPUT_INVALID").alias("code"),
    )


def chunk_metrics(chunks: DataFrame, strategy: str = "fixed") -> DataFrame:
    """Per document: chunks, tokens, parent links, and all chunks as table groups in table mode."""
    tables = F.count(F.lit(1)) if strategy == "table" else F.lit(0).cast("long")
    return chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("token_count").cast("long").alias("total_tokens"),
        F.count_if(F.col("parent_chunk_id").isNotNull()).alias("parent_links"),
        tables.alias("table_groups"),
    )

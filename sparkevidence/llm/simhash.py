"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonring candidates.

Fingerprints are computed inside their rows and staged without the texts. Rows of one fingerprint are
gathered first (with map-side combining), so thousands of copies become one candidate.

Two fingerprints within `distance` bits, cut into m segments on a ring, have a starting segment from which
every chain of l consecutive segments differs in at most l * distance / m bits (pigeonring). The first
chains whose budget is below one bit must be equal: they are the bucket key. Pairs of a bucket must then
keep every longer chain's budget before the full Hamming check.

A bucket of more than `PAIRED` fingerprints never lists its pairs. Its members are instead written under
every value within one bit of them (outside the key): two fingerprints are within two bits exactly if they
share such a value, and a value has at most 65 different neighbours, so groups are bounded and each gives
a star instead of pairs. Both ways find the same links; no bucket is cut.

Components come from rounds of large-star and small-star over staged edges, so the plan stays short and
no list of neighbours is ever collected.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other;
fewer words than a shingle are one shingle; repeated rows stay separate rows of one component; a null id
takes no part in the smallest id, and a component of null ids only has a null component_id; an empty table
gives an empty result; only id and text are read, so other columns never clash.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, map_texts, stage

SHINGLE = 3
DISTANCE = 2
SEGMENTS = 5
#: Buckets up to this size are compared pair by pair; larger ones through values within one bit.
PAIRED = 32
SEED = 42
#: The wider search of keep_one(): five-word shingles, and the share of both texts' shingles that near copies have in common.
SIMILAR_SHINGLE = 5
NEAR = (4, 5)
#: Shares of all hashes in which a text's shingles are counted, to tell texts apart before their shingles are moved.
BINS = 256
#: Share of the texts asked for shingles of many texts, in how many of them, and how many shingles are ordered by it.
ASKED, COMMON, ORDERED = 1 / 16, 4, 100_000
#: Rows of a block of a bucket, and rows of a bucket that all others are held against first.
BLOCK, CENTRES = 128, 4
#: Rows of the largest group of a bucket that a row left apart is held against at once, and how often at most.
DEALT, ROUNDS = 32, 2
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Columns `keep` and `fp` (long) for each row."""
    return map_texts(docs, keep, text, lambda texts: {"fp": np.array([fingerprint(t, shingle) for t in texts], np.int64)}, "fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chain_masks(segments: int, start: int) -> list[int]:
    """Bits of the chains of 1, 2, ... segments from `start` around the ring."""
    edges = [64 * i // segments for i in range(segments + 1)]
    out, mask = [], 0
    for k in range(segments):
        i = (start + k) % segments
        mask |= ((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1)
        out.append(mask)
    return out


def equal_chain(segments: int, distance: int) -> int:
    """How many consecutive segments must be equal: the longest chain with a budget below one bit."""
    return max(n for n in range(1, segments + 1) if n * distance < segments)


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """Links (a < b) between the fingerprints of `distinct` (column fp, each once) within `distance` bits.

    Links of a bucket above `paired` are stars around its smallest member within one bit of a common
    value; together they connect exactly what all pairs would connect. That way needs distance 2.
    """
    if distance != 2 or segments <= distance:
        raise ValueError("links() is built for a distance of two bits and at least three segments")
    n = equal_chain(segments, distance)
    masks = [chain_masks(segments, i) for i in range(segments)]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(m[n - 1]))).alias("key")) for i, m in enumerate(masks)
    ])).alias("k")).select("fp", "k.seg", "k.key")
    shared = keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(shared, ["seg", "key"])

    small = members.filter(F.col("n") <= paired).groupBy("seg", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select("seg", "fps", F.explode("fps").alias("a")).select(
        "seg", "a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & _within(F.col("seg"), F.col("a"), b, masks, n, distance))).alias("b"))

    free = [[k for k in range(64) if not m[n - 1] >> k & 1] for m in masks]
    spots = F.element_at(F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << k)) for k in bits]) for bits in free]), F.col("seg") + 1)
    near = members.filter(F.col("n") > paired).select("fp", "seg", F.explode(spots).alias("flip")).select(
        "fp", "seg", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    balls = near.groupBy("seg", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    stars = balls.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return pairs.select("a", "b").unionByName(stars).distinct()


def _within(seg: Column, a: Column, b: Column, masks: list[list[int]], equal: int, distance: int) -> Column:
    """Budgets of the chains longer than the equal one, then the whole distance."""
    differ = a.bitwiseXOR(b)
    segments = len(masks)
    keeps = F.lit(True)
    for length in range(equal + 1, segments):
        chain = F.element_at(F.array(*[F.lit(_signed(m[length - 1])) for m in masks]), seg + 1)
        keeps = keeps & (F.bit_count(differ.bitwiseAND(chain)) <= length * distance // segments)
    return keeps & (F.bit_count(differ) <= distance)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node reachable."""
    current, path = stage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        both = current.unionByName(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("node"), F.least("hi", "m").alias("m"))
        large = both.filter("lo > hi").join(least, F.col("hi") == F.col("node")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(
            F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        following, new_path = stage(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "edges")
        seen = following.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop_staged(edges.sparkSession, path)
        current, path = following, new_path
        if seen == mark or not seen[0]:
            return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = seen


def assign(staged: DataFrame, key: str) -> DataFrame:
    """key, fp and component_id of every row of a staged table of fingerprints."""
    distinct, _ = stage(staged.groupBy("fp").agg(F.min(key).alias("first")), "fingerprints")
    roots = components(links(distinct.select("fp")))
    linked = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named, _ = stage(linked, "roots")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return staged.join(by_fp, "fp").select(key, "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id for every row."""
    staged, _ = stage(fingerprints(docs, [key], text), "fp")
    return assign(staged, key).select(F.col(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of the text's word shingles, sorted without sign; fewer words than a shingle are one."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)).view(np.int64)


def chosen(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose numbers `key` (long, not negative) stand in the column of that name of ids, found where they lie.

    Each 32,768 consecutive numbers are one bitmap and all bitmaps are broadcast: a bit for each row, so that neither
    texts nor lists move for rows that nobody asks for. Made for row numbers, which are dense within a partition.
    """
    page, bit = F.shiftright(key, 15), F.col(key).bitwiseAND(F.lit((1 << 15) - 1))
    maps = ids.select(page.alias("__page"), bit.alias("__bit")).repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substr("__bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = F.pmod(F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(F.lit(7)))), F.lit(2)) == 1
    return rows.withColumn("__page", page).join(F.broadcast(maps), "__page").filter(here).select(*[F.col(f"`{c}`") for c in rows.columns])


def alike(pairs: DataFrame, docs: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """The pairs (a, b) of rows of docs (id, text) that have at least `near` of their shingles in common, counted exactly."""
    own, _ = stage(map_texts(chosen(docs, _ends(pairs)), ["id"], "text",
                             lambda texts: {"own": [shingles(t) for t in texts]}, "own array<long>"), "shingles")
    sides = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("one")), "a").join(
        own.select(F.col("id").alias("b"), F.col("own").alias("two")), "b")
    part, whole = near
    common = F.size(F.array_intersect("one", "two"))
    return sides.filter(common * (part + whole) >= (F.size("one") + F.size("two")) * part).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def counts(own: np.ndarray) -> np.ndarray:
    """How many of a text's shingles fall into each of `BINS` shares of all hashes, 127 at most."""
    return np.minimum(np.bincount(own.view(np.uint64) >> np.uint64(64 - BINS.bit_length() + 1), minlength=BINS), 127).astype(np.int8)


def enough(pairs: DataFrame, heads: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """The pairs (a, b) of rows of heads (id, size, counts) whose counts() allow enough common shingles for near copies.

    Counts differ by no more than the shingles that only one of the two holds, so the bound loses no pair. They are a
    small part of what alike() has to move.
    """
    part, whole = near
    asked = chosen(heads, _ends(pairs))
    side = lambda i, n: asked.select(F.col("id").alias(i), F.col("size").alias(f"{i}_size"), F.col("counts").alias(n))
    both = pairs.join(side("a", "one"), "a").join(side("b", "two"), "b")
    apart = F.aggregate(F.zip_with("one", "two", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    sizes = F.col("a_size") + F.col("b_size")
    return both.filter((sizes - apart) * (part + whole) >= 2 * sizes * part).select("a", "b")


def common_shingles(docs: DataFrame, text: str = "text", share: float = ASKED, least: int = COMMON, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts hold, sorted, and their places from the rarer to the more common.

    They only set the order in which prefix() takes shingles. Any order finds the same pairs; this one keeps
    passages of many texts out of the prefixes of texts that have enough other shingles.
    """
    some = map_texts(docs.sample(share, seed=SEED), [], text, lambda texts: {"own": [shingles(t) for t in texts]}, "own array<long>")
    counts = some.select(F.explode("own").alias("value")).groupBy("value").count().filter(F.col("count") >= least)
    top = counts.orderBy(F.desc("count"), "value").limit(most).collect()
    values = np.array([r["value"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(top) - order).astype(np.int64)


def prefix(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], near: tuple[int, int] = NEAR) -> np.ndarray:
    """The first of a text's shingles, in an order that all texts share, of which a near copy must hold one.

    Near copies have at least `near` of the larger set in common, so no more than the rest of it can be missing.
    """
    part, whole = near
    values, places = common
    free = own.view(np.uint64)
    rank = np.zeros(len(own), np.int64)
    if len(values):
        at = np.minimum(np.searchsorted(values, free), len(values) - 1)
        rank = np.where(values[at] == free, places[at], 0)
    return own[np.argsort(rank, kind="stable")][: len(own) + (part * len(own)) // -whole + 1 if len(own) else 0]


def signed(texts: list[str], common: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray | list]:
    sets = [shingles(t) for t in texts]
    return {
        "__fp": np.array([fingerprint(t) for t in texts], np.int64), "__set": [xxhash.xxh128_digest(own.tobytes()) for own in sets],
        "__size": np.array([len(own) for own in sets], np.int32), "__prefix": [prefix(own, common) for own in sets],
        "__counts": [counts(own) for own in sets]}


def _reach(x: Column, y: Column, near: tuple[int, int] = NEAR) -> Column:
    """Whether sets (size, at) can be near copies if the shingle at these places is the first that they share.

    Both prefixes have one order, so no more than the shorter rest can be common then. Of near copies the first
    common shingle passes, so one of their meetings is always left.
    """
    part, whole = near
    most = F.least(x["size"] - x["at"], y["size"] - y["at"])
    return most * (part + whole) >= (x["size"] + y["size"]) * part


def meetings(heads: DataFrame, near: tuple[int, int] = NEAR) -> DataFrame:
    """Rows (value, own) of prefixes whose shingle another prefix holds too, one of a size that _reach() allows.

    own is (id, size, at): a row, its number of shingles, and the shingle's place in its prefix; on the way the two
    numbers are one. Shuffled once. In the order of sizes a row has a possible partner before it if the farthest
    reach of the rows before it is enough, and behind it if its own reach is enough for the next one. A shingle stands
    once in a prefix, so no bucket is more than a small part.
    """
    part, whole = near
    both = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    held = heads.select("id", "size", F.posexplode("prefix").alias("at", "value")).select("value", "id", both.alias("both")).repartition("value")
    size, at = F.shiftright("both", 32), F.col("both").bitwiseAND(F.lit((1 << 32) - 1))
    bucket = Window.partitionBy("value").orderBy(F.shiftright("both", 32))
    placed = held.withColumn("need", size * part).withColumn("reach", size * whole - at * (part + whole))
    before = F.max("reach").over(bucket.rowsBetween(Window.unboundedPreceding, -1))
    seen = placed.withColumn("before", before).withColumn("next", F.lead("need").over(bucket))
    own = F.struct("id", size.cast("int").alias("size"), at.cast("int").alias("at"))
    return seen.filter("before >= need OR next <= reach").select("value", own.alias("own"))


def stars(met: DataFrame, centres: int = CENTRES) -> DataFrame:
    """Each row of a bucket with some of the bucket's rows.

    They are the first in as many orders by hash, so a large group of near copies holds one of them soon.
    """
    chosen = [F.min_by("own", F.xxhash64("own.id", F.lit(k))) for k in range(centres)]
    middle = met.groupBy("value").agg(F.array_distinct(F.array(*chosen)).alias("centres"))
    sides = met.join(middle, "value").select("own", F.explode("centres").alias("centre")).filter(
        (F.col("own.id") != F.col("centre.id")) & _reach(F.col("own"), F.col("centre")))
    return sides.select(F.greatest("own.id", "centre.id").alias("a"), F.least("own.id", "centre.id").alias("b")).distinct()


def _rooted(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold rows not connected yet: (value, own), own with its root."""
    known = met.join(roots, F.col("own.id") == F.col("node"), "left").select(
        "value", F.struct("own.id", "own.size", "own.at", F.coalesce("root", "own.id").alias("root")).alias("own"))
    mixed = known.groupBy("value").agg(F.count("*").alias("n"), F.min("own.root").alias("lo"), F.max("own.root").alias("hi")).filter("lo < hi")
    return known.join(mixed.select("value", "n"), "value")


def crowded(rooted: DataFrame, centres: int = CENTRES) -> bool:
    """Whether the pairs of unconnected rows in the buckets are more than some for each row."""
    rows, pairs = _apart(rooted).agg(F.sum("n"), F.sum("pairs")).first()
    return bool(rows) and pairs > centres * rows


def _apart(rooted: DataFrame) -> DataFrame:
    """(value, n, pairs, most): rows and unconnected pairs of a bucket, and (rows, root) of its largest root."""
    sizes = rooted.groupBy("value", "own.root").agg(F.count("*").alias("many"))
    square = lambda c: F.col(c).cast("double") * F.col(c)
    return sizes.groupBy("value").agg(F.sum("many").alias("n"), F.sum(square("many")).alias("same"), F.max(F.struct("many", "root")).alias("most")).select(
        "value", "n", ((square("n") - F.col("same")) / 2).alias("pairs"), "most")


def _full(rooted: DataFrame, centres: int = CENTRES) -> DataFrame:
    return _apart(rooted).filter(F.col("pairs") > centres * F.col("n"))


def stars_between(rooted: DataFrame, turn: int, centres: int = CENTRES, dealt: int = DEALT) -> DataFrame:
    """Pairs of rows of the largest root of a bucket and other rows of it, where the unconnected pairs are many.

    The rows of that root are dealt into parts of about `dealt`, and each other row meets one part, another in each bucket and turn: its
    pairs are bounded, and a row that is like a share of a large group soon finds one of that share.
    """
    full = _full(rooted, centres).select(
        "value", "most", F.ceil(F.col("most.many") / dealt).cast("int").alias("parts"))
    rows = rooted.select("value", "own").join(full, "value").select(
        "value", "own", (F.col("own.root") == F.col("most.root")).alias("inside"),
        F.pmod(F.xxhash64("own.id", "value", F.lit(turn)), F.col("parts")).alias("part"))
    inside = rows.filter("inside").select("value", "part", F.col("own").alias("x"))
    others = rows.filter("NOT inside").select(F.col("value").alias("v"), F.col("part").alias("p"), F.col("own").alias("y"))
    met = inside.join(others, (F.col("value") == F.col("v")) & (F.col("part") == F.col("p")) & _reach(F.col("x"), F.col("y")))
    return met.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root) after the rows of the pairs (a, b) are connected too."""
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    ends = pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
    last = components(ends)
    # A root has no row of its own in roots, nor has a row without links; both get one here once they are connected.
    moved = roots.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
    return moved.select("node", F.coalesce("last", "root").alias("root")).unionByName(last)


def open_pairs(met: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of a bucket whose rows are not connected yet.

    A bucket's rows are dealt into blocks of about `block`, and each two blocks meet in a group of their own, so a list stays bounded
    however many rows a bucket has.
    """
    return _listed(_rooted(met, roots), block)


def _listed(rooted: DataFrame, block: int = BLOCK) -> DataFrame:
    dealt = rooted.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("own.id"), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = other.groupBy("value", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q")).agg(
        F.collect_list(F.struct("own.id", "own.root", "own.size", "own.at", "part")).alias("rows")).filter(F.size("rows") > 1)
    sides = cells.select("p", "q", "rows", F.explode("rows").alias("x"))

    def apart(y: Column) -> Column:
        x = F.col("x")
        return (y["id"] < x["id"]) & (y["root"] != x["root"]) & ((F.col("p") == F.col("q")) | (y["part"] != x["part"])) & _reach(x, y)

    return sides.select("x", F.explode(F.filter("rows", apart)).alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs, one for each group of near copies: the one with the smallest key (null last), then the first read.

    A group joins texts whose fingerprints are linked and texts whose five-word shingles are alike (`NEAR`). Two
    fingerprint bits are much narrower than that (see README), so the second search has prefixes of its own; it
    runs over one row of each different set of shingles. Each bucket is first held against a few of its rows, which
    connects large groups by stars; then all pairs follow that are still unconnected.

    Texts without words (null, empty, blank) are one group, repeated rows are copies of each other, very long texts
    are compared whole, and an empty table stays empty. Columns whose names begin with __ are the caller's risk.
    """
    columns, spark = docs.columns, docs.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = stage(df, name)
        paths.append(path)
        return out

    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    common = common_shingles(docs, text)
    both = map_texts(numbered, [*columns, "__row"], text, lambda texts: signed(texts, common),
                     "__fp long, __set binary, __size int, __prefix array<long>, __counts array<tinyint>")
    staged, _ = stage(both, "docs")
    linked = assign(staged.select("__row", F.col("__fp").alias("fp")), "__row").select("__row", F.col("component_id").alias("group"))
    filled = staged.filter("__size > 0").select(F.col("__row").alias("id"), F.col("__set").alias("set"), F.col("__size").alias("size"), F.col("__prefix").alias("prefix"), F.col("__counts").alias("counts"))
    firsts = kept(filled.groupBy("set").agg(F.min("id").alias("node")), "sets")
    # One node for all texts of equal shingles; edges stand between nodes, so copies add none.
    nodes = filled.select(F.col("id").alias("__row"), "set").join(firsts, "set").select("__row", "node")
    named = kept(linked.join(nodes, "__row", "left").select("__row", "group", F.coalesce("node", "__row").alias("node")), "nodes")
    heads = named.select(F.col("__row").alias("group"), F.col("node").alias("head"))
    linking = named.join(heads, "group").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    met = kept(meetings(chosen(filled.select("id", "size", "prefix"), firsts.select(F.col("node").alias("id")))), "prefixes")
    words = staged.select(F.col("__row").alias("id"), F.col(f"`{text}`").alias("text"))
    heads = filled.select("id", "size", "counts")
    near = kept(enough(kept(stars(met), "stars"), heads), "pairs")
    roots = kept(components(linking.unionByName(alike(near, words))), "first-roots")
    # Rows that the first stars left apart from large groups are held against shares of them, as long as there are many pairs and some are alike.
    # Only the buckets with many such pairs are looked at again; the roots of the others may be older ones, which lists more pairs and loses none.
    rooted = kept(_rooted(met, roots), "apart")
    if crowded(rooted):
        full = kept(_full(rooted).select("value"), "full")
        rest, busy = kept(rooted.join(full, "value", "left_anti"), "rest"), kept(rooted.join(full, "value", "left_semi"), "busy")
        for turn in range(ROUNDS):
            some = kept(stars_between(busy, turn), "stars")
            more = kept(alike(kept(enough(some, heads), "pairs"), words), "more-links")
            if more.isEmpty():
                break
            roots = kept(joined(roots, more), "more-roots")
            busy = kept(_rooted(busy.select("value", "own"), roots), "busy")
            rooted = rest.unionByName(busy)
            if turn + 1 < ROUNDS and not crowded(rooted):
                break
    # What is still apart: pairs of different roots, joined as edges between those roots.
    late = alike(kept(enough(kept(_listed(rooted), "listed"), heads), "pairs"), words)
    ends = joined(roots, late)
    groups = named.join(ends, "node", "left").select("__row", F.coalesce("root", "node").alias("__group"))
    ids = staged.select("__row", F.col(f"`{key}`").alias("__key"))
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__row").alias("row"))
    keepers, _ = stage(groups.join(ids, "__row").groupBy("__group").agg(F.min(order).alias("best")).select(F.col("best.row").alias("__row")), "keepers")
    for path in paths:
        drop_staged(spark, path)
    # The texts stay where they lie.
    return chosen(staged, keepers, "__row").select(*[F.col(f"`{c}`") for c in columns])

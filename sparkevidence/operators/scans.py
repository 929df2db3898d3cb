"""Ordered scans in two levels, so that one long group never sits in one task.

Positions are cut into blocks of fixed width. Windows run inside a block; one summary row per block
is scanned over the group and joined back. The second scan sees `rows / BLOCK` rows. Both read one
shuffle of the rows on (keys, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 4096


def block_of(order: str, width: int = BLOCK) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lasts: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    include_current: bool = True,
    width: int | None = BLOCK,
) -> DataFrame:
    """Add running columns per group, ordered by the whole number in `order`.

    `lasts`: last non-null value at or before (or strictly before) the row. `sums`: total of all
    rows strictly before. `maxima`: maximum over the whole group. width None: no group is longer than a
    block, so rows lie by their keys alone and further steps on the keys need no shuffle.
    """
    lasts, sums, maxima = lasts or {}, sums or {}, maxima or {}
    if width is None:
        group = Window.partitionBy(*keys)
        upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
        prior = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.repartition(*keys).select(
            "*",
            *[F.last(value, ignorenulls=True).over(upto).alias(n) for n, value in lasts.items()],
            *[F.coalesce(F.sum(value).over(prior), F.lit(0)).cast("long").alias(n) for n, value in sums.items()],
            *[F.max(value).over(group).alias(n) for n, value in maxima.items()],
        )
    marked = df.withColumn("_blk", block_of(order, width))
    for name, value in {**lasts, **sums, **maxima}.items():
        marked = marked.withColumn(f"_m_{name}", value)
    marked = marked.repartition(*keys, "_blk")
    inside = Window.partitionBy(*keys, "_blk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = marked.select(
        "*",
        *[F.last(f"_m_{n}", ignorenulls=True).over(upto).alias(f"_l_{n}") for n in lasts],
        *[F.coalesce(F.sum(f"_m_{n}").over(prior), F.lit(0)).alias(f"_l_{n}") for n in sums],
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*keys, "_blk")
        .agg(
            *[
                F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col(order))).alias(f"_s_{n}")
                for n in lasts
            ],
            *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in sums],
            *[F.max(f"_m_{n}").alias(f"_s_{n}") for n in maxima],
        )
        .select(
            *keys, "_blk",
            *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
            *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_s_{n}").over(group).alias(f"_c_{n}") for n in maxima],
        )
    )
    if not maxima:
        carried = carried.filter("_blk > 0")
    joined = local.join(carried, [*keys, "_blk"], "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in lasts],
        *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).cast("long").alias(n) for n in sums],
        *[F.col(f"_c_{n}").alias(n) for n in maxima],
    )


def blocked_row_number(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str, start: int = 1
) -> DataFrame:
    """Row numbers per group; `bucket` must grow with `order`, ties never straddle two buckets."""
    base = df.withColumn("_bkt", bucket).repartition(*keys, "_bkt")
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    numbered = base.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(offsets, [*keys, "_bkt"]).select(
        *df.columns, (F.col("_rn") + F.col("_off") - 1 + start).cast("long").alias(name)
    )

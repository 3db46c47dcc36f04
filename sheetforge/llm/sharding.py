"""Sharding by longest-processing-time scheduling.

Groups of equal texts must stay in one shard. The classic rule takes groups by falling size and gives
each to the least-loaded shard, which a heap finds. The corpus may hold billions of groups, so the rule
runs on *items*: a group that is large against a shard is an item of its own, all other groups are
hashed into a fixed number of bundles, each an item. The driver only sees the items, whose number is
bounded by ``bundles + shards / large_share`` whatever the corpus size; a shard's load then
differs from the mean by less than one item.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetforge.llm.common import stored, unused


def longest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Item -> shard by the LPT rule; ties go by item name and by the lower shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(
    docs: DataFrame,
    shards: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    bundles: int = 24_576,
    large_share: float = 1 / 512,
    rows_per_part: int | None = None,
) -> DataFrame:
    """``docs`` plus size, shard and slot; all other columns are kept.

    size is the UTF-8 bytes of the text (null: none) plus ``overhead``. slot counts 0, 1, ... without
    a gap in each shard. Rows with equal texts (null counts as empty) share a shard, repeated
    rows too. Columns of ``docs`` called size, shard or slot are replaced, any other names may be used. A null id is
    an id like any other; an empty table gives an empty result; very long texts are items of their own. Slots are dealt by (item, part, id, text, position in the part); which of two identical
    rows gets the lower slot is not fixed.

    An item of more than ``rows_per_part`` rows is numbered in parts of about that size, by a hash of the id
    (rows that repeat an id share a part); default: a quarter of what a task gets of all rows, at most 100,000. The texts are read
    twice, for their keys and to be dealt; keys and sizes are a stored table between.
    """
    spark = docs.sparkSession
    carried = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    group, item, part, parts, large, first, rank = (unused(docs, c) for c in ("group_", "item_", "part_", "parts_", "large_", "first_", "rank_"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own, digest = F.octet_length(text).cast("long") + F.lit(overhead), F.sha2(text, 256)
    spread = F.abs(F.xxhash64(F.col(id_col).cast("string")) % F.lit(1 << 40))
    keys = stored(docs.select(own.alias("size"), digest.alias("key"), spread.alias("spread")), "keys")
    groups = stored(keys.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_part = rows_per_part or max(1, min(100_000, rows // (4 * tasks)))
    threshold = max(1, int(total / shards * large_share))

    def bundle(key: str) -> Column:
        return F.concat(F.lit("b"), F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % bundles)

    items = (
        groups.select(F.when(F.col("bytes") >= threshold, F.col("key")).otherwise(bundle("key")).alias("item"), "bytes", "n")
        .groupBy("item")
        .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        .collect()
    )
    # from here on both lists are bounded by `bundles` and `shards / large_share`, so they may be broadcast
    placed = longest_first([(r["item"], r["bytes"]) for r in items], shards)
    plan = F.broadcast(spark.createDataFrame([(r["item"], placed[r["item"]], max(1, -(-r["n"] // per_part))) for r in items], f"`{item}` string, shard int, `{parts}` long"))
    own_items = F.broadcast(spark.createDataFrame([(r["item"], True) for r in items if len(r["item"]) == 64], f"`{group}` string, `{large}` boolean"))

    def dealt(df: DataFrame, at: Column) -> DataFrame:
        named = df.join(own_items, group, "left").withColumn(item, F.when(F.col(large), F.col(group)).otherwise(bundle(group)))
        return named.join(plan, item).withColumn(part, at % F.col(parts)).drop(large, parts)

    counts = dealt(keys.select(F.col("key").alias(group), "spread"), F.col("spread")).groupBy("shard", item, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(item, part).rowsBetween(Window.unboundedPreceding, -1)
    # one row for each item and part: bounded by the items and four parts for each task
    offsets = stored(counts.select(item, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first)), "offsets")
    within = Window.partitionBy(item, part).orderBy(F.col(id_col), group)
    return (
        dealt(docs.select(*carried, own.alias("size"), digest.alias(group)), spread)
        .withColumn(rank, F.row_number().over(within))
        .join(offsets, [item, part])
        .select(*carried, "size", "shard", (F.col(first) + F.col(rank) - 1).alias("slot"))
    )

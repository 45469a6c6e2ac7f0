"""Frequent itemsets: exactly the sets of items that occur together in at least ``support`` baskets.

Three ways to the same result: level by level with joins, in two passes (candidates that are frequent in some part of
the baskets at a proportional threshold, then one exact count of all of them), and FP-growth of Spark ML.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import col, parts_for, stored


def baskets(df: DataFrame, basket: str | Column, item: str | Column) -> DataFrame:
    """Distinct (basket, item) rows without nulls."""
    b, i = (c if isinstance(c, Column) else col(c) for c in (basket, item))
    return df.select(b.alias("basket"), i.alias("item")).where("basket is not null and item is not null").distinct()


def larger_baskets(rows: DataFrame, more_than: int) -> DataFrame:
    """Only the baskets with more than so many items."""
    keep = rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return rows.join(keep.select("basket"), "basket", "left_semi")


def frequent_itemsets(rows: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """items (sorted array), size, support of every itemset with at least that support, from baskets() rows.

    Level k holds the (basket, itemset) occurrences of the frequent sets of k items; they are extended by the frequent
    items after their last one, and only where the set without its last but one item is frequent too.
    """
    singles = rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    rows = stored(rows.join(singles.select("item"), "item", "left_semi").select("basket", "item"))
    result = stored(singles.select(F.array("item").alias("items"), F.lit(1).alias("size"), "support"))
    whole, level, k = result, rows.select("basket", F.array("item").alias("items")), 1
    while max_size is None or k < max_size:
        k += 1
        longer = level.join(rows, "basket").where(F.col("item") > F.element_at("items", -1))
        if k > 2:
            other = F.concat(F.slice("items", 1, k - 2), F.array("item"))
            longer = longer.withColumn("other", other).join(result.select(F.col("items").alias("other")), "other", "left_semi")
        longer = longer.select("basket", F.concat("items", F.array("item")).alias("items"))
        result = stored(longer.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support).select("items", F.lit(k).alias("size"), "support"))
        if result.isEmpty():
            break
        whole = whole.unionByName(result)
        level = longer.join(result.select("items"), "items", "left_semi")
        if k >= 3:
            level = stored(level)
    return whole


def _local(part: list[list], threshold: int, max_size: int | None) -> Iterator[tuple[int, list]]:
    """Itemsets frequent within one part of the baskets: each level extends those before."""
    where: dict[tuple, set[int]] = {}
    for b, items in enumerate(part):
        for i in items:
            where.setdefault((i,), set()).add(b)
    level = {k: v for k, v in where.items() if len(v) >= threshold}
    while level:
        yield from level
        keys = sorted(level)
        if max_size and len(keys[0]) >= max_size:
            return
        heads: dict[tuple, list] = {}
        for k in keys:
            heads.setdefault(k[:-1], []).append(k[-1])
        longer = {}
        for head, lasts in heads.items():
            for a, b in combinations(lasts, 2):
                both = level[(*head, a)] & level[(*head, b)]
                if len(both) >= threshold:
                    longer[(*head, a, b)] = both
        level = longer


#: Rows that one part of the baskets holds in a Python worker, and the least threshold within a part.
ROWS_PER_PART, LEAST_LOCAL = 500_000, 10


def two_pass_candidates(rows: DataFrame, support: int, parts: int, max_size: int | None = None) -> DataFrame:
    """items of every set that is frequent in some part of the baskets at the part's share of the support.

    A set below that share in each part is below the support in all, so no frequent set is missed. Items below the support are
    left out before, which bounds the size of a basket by the number of frequent items.
    """
    frequent = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    n = rows.select("basket").distinct().count()
    rows = rows.join(frequent.select("item"), "item", "left_semi")
    whole = rows.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = whole.repartition(parts, "basket").select("items")
    kind = whole.schema["items"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = [], None
        for b in batches:
            own = b.schema
            part += b.column(0).to_pylist()
        if part:
            found = [list(k) for k in _local(part, max(1, math.ceil(support * len(part) / max(1, n))), max_size)]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[at : at + 10_000], own.field(0).type)], names=["items"])

    return whole.mapInArrow(run, f"items {kind}").distinct()


def two_pass_itemsets(rows: DataFrame, support: int, parts: int | None = None, max_size: int | None = None) -> DataFrame:
    """The same as frequent_itemsets, by two passes; candidates are counted by joins on their items, not by scanning lists.

    parts: by default so many that a part fits a worker. Where that would leave a part a threshold of a few baskets, at
    which almost every combination is a candidate, the sets are found level by level instead.
    """
    if parts is None:
        spark, n = rows.sparkSession, rows.count()
        parts = parts_for(spark, n, ROWS_PER_PART)
        if support < parts * LEAST_LOCAL:
            parts = parts_for(spark, n, ROWS_PER_PART, least=max(1, support // LEAST_LOCAL))
        if support < parts * LEAST_LOCAL and parts > 1:
            return frequent_itemsets(rows, support, max_size)
    cand = stored(two_pass_candidates(rows, support, parts, max_size).withColumn("candidate", F.xxhash64("items")))
    long = cand.select("candidate", F.size("items").alias("size"), F.explode("items").alias("item"))
    held = rows.join(long, "item").groupBy("basket", "candidate", "size").agg(F.count("*").alias("n")).where("n = size")
    counts = held.groupBy("candidate").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    return cand.join(counts, "candidate").select("items", F.size("items").alias("size"), "support")


def fpgrowth_itemsets(rows: DataFrame, support: int) -> DataFrame:
    """The same as frequent_itemsets, by FP-growth; the threshold is moved half a basket down so that rounding can't lose a set."""
    from pyspark.ml.fpm import FPGrowth

    whole = rows.groupBy("basket").agg(F.collect_list("item").alias("items"))
    n = whole.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (support - 0.5) / max(1, n)))).fit(whole)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.size("items").alias("size"), F.col("freq").alias("support")).where(F.col("support") >= support)


def ordered(itemsets: DataFrame) -> DataFrame:
    """By size, then lexicographically."""
    return itemsets.orderBy("size", "items")

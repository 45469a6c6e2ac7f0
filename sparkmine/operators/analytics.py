"""Counts, distinct counts, means, top-k and partition profiles."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import col


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """Rows for which the predicate is true, pushed to the scan as a filter."""
    return df.where(predicate).agg(F.count("*").alias(name))


def count_different(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    """Distinct non-null values (or combinations without nulls). Deduplicated per key in two phases, not in one task."""
    keys = df.select(*(col(c).alias(f"k{i}") for i, c in enumerate(columns))).dropna().distinct()
    return keys.agg(F.count("*").alias(name))


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*(col(k) for k in keys)).agg(F.count("*").alias(name))


def group_mean(df: DataFrame, key: str, value: str, name: str = "mean", digits: int | None = None) -> DataFrame:
    mean = F.avg(col(value))
    return df.groupBy(col(key)).agg((mean if digits is None else F.round(mean, digits)).alias(name))


def top_k(df: DataFrame, key: str, k: int = 10, name: str = "n") -> DataFrame:
    """The k most frequent keys, most frequent first, ties by key. Each partition keeps k rows (TakeOrderedAndProject)."""
    return group_count(df.where(col(key).isNotNull()), key, name=name).orderBy(F.desc(name), col(key)).limit(k)


def top_groups(df: DataFrame, score: str) -> DataFrame:
    """All rows with the largest score (ties included), by a one-row aggregate instead of a sort."""
    best = df.agg(F.max(col(score)).alias("_best"))
    return df.join(F.broadcast(best), col(score) == F.col("_best")).drop("_best")


def at_least(df: DataFrame, key: str, item: str, more_than: int, name: str = "n_items") -> DataFrame:
    """Keys with more than so many distinct items."""
    pairs = df.select(col(key).alias("k"), col(item).alias("i")).dropna().distinct()
    return pairs.groupBy("k").agg(F.count("*").alias(name)).where(F.col(name) > more_than).withColumnRenamed("k", key)


def partition_profile(df: DataFrame, n: int | None = None, *keys: str) -> DataFrame:
    """Rows in each partition, as it is or after hash partitioning by keys into n: partition_id, n_items."""
    if n:
        df = df.repartition(n, *(col(k) for k in keys)) if keys else df.repartition(n)
    return df.select(F.spark_partition_id().alias("partition_id")).groupBy("partition_id").agg(F.count("*").alias("n_items"))


def placed_profile(df: DataFrame, n: int, partition: Column) -> DataFrame:
    """Rows in each of n partitions when the expression says which one a row goes to (taken modulo n): partition_id, n_items."""
    return partition_profile(df.repartitionById(n, partition.cast("int")))


def timed(df: DataFrame) -> float:
    """Seconds that a frame takes, its whole result computed and thrown away."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def partition_study(df: DataFrame, key: str, n: int, k: int = 10) -> DataFrame:
    """How the same top-k count does over the partitions as they are and after hash partitioning by key into n: kind (default,
    custom), n_partition, n_items (rows of each partition in order), n_total, exe_time (seconds). Runs at once."""
    rows = []
    for kind, d in (("default", df), ("custom", df.repartition(n, col(key)))):
        profile = sorted((r["partition_id"], r["n_items"]) for r in partition_profile(d).collect())  # one row a partition
        items = [m for _, m in profile]
        rows.append((kind, len(items), items, sum(items), timed(top_k(d, key, k))))
    return df.sparkSession.createDataFrame(rows, "kind string, n_partition int, n_items array<long>, n_total long, exe_time double")


def sort_study(means: DataFrame, value: str, name: str, k: int = 10) -> DataFrame:
    """The first k rows by value (largest first, then by name) found two ways: ordered by one limit over all partitions, and
    ordered whole before the limit: kind (limit, whole), top (names), exe_time (seconds). Runs at once."""
    rows = []
    by = [F.desc(value), col(name)]
    for kind, d in (("limit", means.orderBy(*by).limit(k)), ("whole", means.repartitionByRange(*by).sortWithinPartitions(*by).limit(k))):
        began = time.perf_counter()
        top = [r[0] for r in d.select(col(name)).collect()]  # k rows
        rows.append((kind, top, time.perf_counter() - began))
    return means.sparkSession.createDataFrame(rows, "kind string, top array<string>, exe_time double")


def report(df: DataFrame, users: str, items: str, when: Column, k: int = 10) -> DataFrame:
    """One row with the counts of a review table: n_review, n_review_in, n_user, top_user, n_item, top_item.

    top_user and top_item are arrays of (key, n) structs, most frequent first, ties by key.
    """
    totals = df.agg(F.count("*").alias("n_review"), F.count_if(when).alias("n_review_in"))

    def side(key: str, what: str) -> DataFrame:
        counts = group_count(df.where(col(key).isNotNull()), key)
        most = counts.orderBy(F.desc("n"), col(key)).limit(k).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), col(key).alias("key")))).alias("t"))
        best = F.transform("t", lambda x: F.struct(x["key"].alias("key"), (-x["m"]).alias("n")))
        return counts.agg(F.count("*").alias(f"n_{what}")).join(F.broadcast(most.select(best.alias(f"top_{what}"))))

    return totals.join(F.broadcast(side(users, "user"))).join(F.broadcast(side(items, "item")))

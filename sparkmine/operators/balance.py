"""Per-key work when a few keys hold most records: fragment-replicate by estimated load.

A plan is made from the loads of the keys: keys above a fraction of a task's share are split into shards in proportion to
their load, the others stay whole and are grouped into hash buckets, and shards and buckets are bin-packed to tasks,
largest first. Rows go where the plan says, partial results per (key, shard) are combined at the end. A matching side goes
the same way, in the same exchange: its rows are replicated only to the shards of split keys. The plan's size depends on
the number of tasks, not on the data.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import col, stored

#: A key is split above this fraction of a task's mean load.
SPLIT_ABOVE = 0.25
BUCKETS_PER_TASK = 16


@dataclass
class LoadPlan:
    tasks: int
    buckets: int
    #: task of each bucket of whole keys
    bucket_task: list[int]
    #: split keys (field, key) with the task of each shard; at most tasks / SPLIT_ABOVE keys
    split: dict[tuple[str, str], list[int]]
    #: value whose Spark hash falls on each task's partition
    salt: list[int]
    load: list[float]

    def split_frame(self, spark) -> DataFrame:
        rows = [(f, k, [self.salt[t] for t in ts]) for (f, k), ts in self.split.items()]
        return spark.createDataFrame(rows, "field string, key string, salts array<int>")


def pack(loads: Sequence[float], bins: int) -> tuple[list[int], list[float]]:
    """Bin of each load, largest first into the emptiest bin; and the bins' loads."""
    heap = [(0.0, b) for b in range(bins)]
    to, full = [0] * len(loads), [0.0] * bins
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        have, b = heapq.heappop(heap)
        to[i], full[b] = b, have + loads[i]
        heapq.heappush(heap, (full[b], b))
    return to, full


def _salts(spark, tasks: int) -> list[int]:
    """For each partition a value that hash partitioning sends there."""
    found: dict[int, int] = {}
    start, step = 0, tasks * 32
    while len(found) < tasks:
        for v, p in spark.range(start, start + step, 1, 1).select(F.col("id").cast("int").alias("v")).select("v", F.expr(f"pmod(hash(v), {tasks})")).collect():
            found.setdefault(p, v)
        start += step
    return [found[p] for p in range(tasks)]


def plan_loads(rows: DataFrame, tasks: int) -> LoadPlan:
    """The plan for rows(field, key), one row for each record of work; loads are counted exactly, combined on the map side."""
    spark = rows.sparkSession
    buckets = tasks * BUCKETS_PER_TASK
    loads = stored(rows.groupBy("field", "key").agg(F.count("*").alias("n")))
    bucket = F.pmod(F.xxhash64("field", "key"), F.lit(buckets))
    # a key's load is compared with the mean, for which the number of rows is needed first
    total = loads.agg(F.sum("n")).first()[0] or 0
    most = max(1.0, SPLIT_ABOVE * total / tasks)
    marked = loads.select("field", "key", "n", (F.col("n") > most).alias("large"), bucket.alias("bucket"))
    grouped = marked.groupBy("large", F.when(F.col("large"), F.struct("field", "key")).alias("at"), F.when(~F.col("large"), F.col("bucket")).alias("bucket")).agg(F.sum("n").alias("n"))
    whole, large = [0.0] * buckets, {}
    for r in grouped.collect():  # at most buckets + tasks / SPLIT_ABOVE rows
        if r["large"]:
            large[r["at"]["field"], r["at"]["key"]] = r["n"]
        else:
            whole[r["bucket"]] = float(r["n"])
    items, loads_ = [], []
    for key, n in sorted(large.items()):
        shards = math.ceil(n / most)
        items += [(key, i) for i in range(shards)]
        loads_ += [n / shards] * shards
    to, full = pack([*whole, *loads_], tasks)
    split: dict[tuple[str, str], list[int]] = {}
    for (key, _), t in zip(items, to[buckets:]):
        split.setdefault(key, []).append(t)
    return LoadPlan(tasks, buckets, to[:buckets], split, _salts(spark, tasks), full)


def _tasks(df: DataFrame, tasks: int | None) -> int:
    return tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _routed(df: DataFrame, plan: LoadPlan, spread: Column | None) -> DataFrame:
    """df(field, key, ...) with shard and salt: one shard for each row, by the hash of spread, or (without spread) a copy for
    each shard of the row's key."""
    spark = df.sparkSession
    # both tables are bounded by the number of tasks
    of_bucket = spark.createDataFrame([(b, plan.salt[t]) for b, t in enumerate(plan.bucket_task)], "bucket int, light int")
    df = df.withColumn("bucket", F.pmod(F.xxhash64("field", "key"), F.lit(plan.buckets)).cast("int")).join(F.broadcast(of_bucket), "bucket", "left").drop("bucket")
    if not plan.split:
        return df.withColumn("shard", F.lit(0)).withColumnRenamed("light", "salt")
    df = df.join(F.broadcast(plan.split_frame(spark)), ["field", "key"], "left").withColumn("salts", F.coalesce("salts", F.array("light"))).drop("light")
    if spread is None:
        return df.select(*(c for c in df.columns if c != "salts"), F.posexplode("salts").alias("shard", "salt"))
    shard = F.when(F.size("salts") > 1, F.pmod(F.xxhash64(spread), F.size("salts"))).otherwise(0).cast("int")
    return df.withColumn("shard", shard).withColumn("salt", F.element_at("salts", F.col("shard") + 1)).drop("salts")


def placed(df: DataFrame, plan: LoadPlan, spread: Column, side: DataFrame | None = None) -> DataFrame:
    """df(field, key, ...) with its rows on the partitions the plan gives them; the new columns are shard and salt.

    Rows of a split key are spread by the hash of ``spread``: rows that agree in it stay together. side(field, key, ...): a
    matching side, whose rows come to the shards of their key in the same exchange; the columns that only one of the two
    has are null in the other's rows.
    """
    rows = _routed(df, plan, spread)
    if side is not None:
        rows = rows.unionByName(_routed(side, plan, None), allowMissingColumns=True)
    return rows.repartition(plan.tasks, "salt")


def key_statistics(df: DataFrame, fields: Sequence[tuple[str, str]], record: str, value: str, version: str | None = None, tasks: int | None = None, sides: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """Per key of each field, without imbalance: field_name, key_value, n_records, mean_value, n_counterparts, listed_value, n_total, share.

    fields: (column, counterpart column) pairs. A distinct ``record`` counts once, with the values of its largest
    ``version`` (ties: the largest value); rows without a record id are none. n_counterparts: distinct non-null
    counterparts. mean_value leaves null values out (null if all are). n_total: all records, with or without the key.
    sides: for a field, a matching table with its key and value columns, joined to the keys as listed_value (the largest of
    several; null where there is none); its rows are replicated to the shards of split keys. Null keys have no row. Repeated
    rows change nothing. An empty table has no rows; other columns are ignored.
    """
    names = list(dict.fromkeys(c for pair in fields for c in pair))
    base = df.where(col(record).isNotNull())
    newest = F.max(F.struct((col(version) if version else F.lit(0)).alias("version"), col(value).cast("double").alias("value")))
    # one row per record: ids are the same in every delivery of it unless missing
    records = base.groupBy(col(record).alias("record")).agg(newest.alias("last"), *(F.max(col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(names)))
    pick = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"c{names.index(f)}").alias("key"), F.col(f"c{names.index(o)}").alias("other")) for f, o in fields), F.struct(F.lit("").alias("field"), F.lit("").alias("key"), F.lit(None).cast("string").alias("other")))
    rows = records.select(F.explode(pick).alias("x"), F.col("last.value").alias("value")).where("x.key is not null").select("x.*", "value")
    # pre-aggregated per (key, counterpart): a pair that repeats without end is one row; these rows are the load of a key
    pairs = stored(rows.groupBy("field", "key", "other").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.sum("value").alias("total")))
    plan = plan_loads(pairs.select("field", "key"), _tasks(df, tasks))
    side = None
    for f, (frame, key, listed) in (sides or {}).items():
        part = frame.select(F.lit(f).alias("field"), col(key).cast("string").alias("key"), col(listed).cast("double").alias("listed")).where("key is not null")
        side = part if side is None else side.unionByName(part)
    if side is None:
        pairs = pairs.withColumn("listed", F.lit(None).cast("double"))
    else:
        side = side.groupBy("field", "key").agg(F.max("listed").alias("listed"))
    shards = placed(pairs, plan, F.col("other"), side).groupBy("salt", "field", "key", "shard").agg(
        F.sum("n").alias("n"), F.sum("with_value").alias("with_value"), F.sum("total").alias("total"), F.count("other").alias("others"), F.max("listed").alias("listed")
    )
    done = shards.where("n is not null").groupBy("field", "key").agg(
        F.sum("n").alias("n_records"), F.try_divide(F.sum("total"), F.sum("with_value")).alias("mean_value"), F.sum("others").alias("n_counterparts"), F.max("listed").alias("listed_value")
    )
    whole = pairs.where("field = ''").agg(F.sum("n").alias("n_total"))  # one row
    return done.where("field != ''").join(F.broadcast(whole)).select(F.col("field").alias("field_name"), F.col("key").alias("key_value"), "n_records", "mean_value", "n_counterparts", "listed_value", "n_total", (F.col("n_records") / F.col("n_total")).alias("share"))


def fragment_replicate_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner", tasks: int | None = None, plan: LoadPlan | None = None) -> DataFrame:
    """large joined with small on the column ``key`` (in both, as text), every row of large on the task the plan gives it.

    how: "inner" or "left". The rows of small with a split key are replicated to its shards, all others stay single; both
    sides come in one exchange, and within a task the rows of small with one key (which must fit a task) are set beside the
    rows of large that have it. Null keys match nothing. The result has key, then large's other columns, then small's; a
    name in both gets a trailing _ in small's. The rows of a split key are spread by all columns of large; rows that
    agree in all of them stay together.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    mine = [c for c in large.columns if c != key]
    yours = [c for c in small.columns if c != key]
    taken = {c.lower() for c in large.columns}
    a = large.select(F.lit("").alias("field"), col(key).cast("string").alias("key"), F.struct(*(col(c) for c in mine), F.lit(0).alias("\0")).alias("a"), F.xxhash64(*(col(c) for c in large.columns)).alias("h"))
    b = small.select(F.lit("").alias("field"), col(key).cast("string").alias("key"), F.struct(*(col(c) for c in yours), F.lit(0).alias("\0")).alias("b")).where("key is not null")
    known = a.where("key is not null")
    plan = plan or plan_loads(known.select("field", "key"), _tasks(large, tasks))
    both = placed(known, plan, F.col("h"), b)
    matches = F.collect_list("b").over(W.partitionBy("salt", "key", "shard"))
    met = both.select("key", "a", matches.alias("bs")).where("a is not null")
    j = met.select("key", "a", (F.explode if how == "inner" else F.explode_outer)("bs").alias("b"))
    if how == "left":
        j = j.unionByName(a.where("key is null").select("key", "a", F.lit(None).cast(b.schema["b"].dataType).alias("b")))
    return j.select(F.col("key").alias(key), *(F.col("a").getField(c).alias(c) for c in mine), *(F.col("b").getField(c).alias(c + "_" * (c.lower() in taken)) for c in yours))

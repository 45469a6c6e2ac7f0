"""Exact distinct counts over huge identifier sets by hash-range decomposition.

(group, identifier) pairs are deduplicated within disjoint hash buckets, counted exactly per bucket, and the counts of the
buckets are added: a pair is in one bucket only, so the sum is exact and the error bound is 0. The buckets in which
``distinct_counts`` works are the partitions of the shuffle that brings equal pairs together; each partition counts its
own pairs before only these counts are shuffled and added. Coarser groups are made from the deduplicated pairs of a finer
one.

Two forms of partial results can be merged. ``identifier_pairs`` is the state: states of different pieces of data are
merged by ``merge_pairs`` (union and deduplication, bucket by bucket of the identifier). ``bucket_counts`` of different
buckets are merged by adding. Deduplication runs on the whole (group, identifier) key after a partial aggregation on the map
side, so neither a popular group nor a very active identifier, nor one pair repeated without end, gathers in one task, and
nothing is held but the aggregation's spillable hash map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, stored

BUCKETS = 1024


def identifier_pairs(df: DataFrame, identifiers: Sequence[str], groups: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The mergeable state: distinct (kind, bucket, groups..., identifier) rows; kind is the name of the identifier column.

    Rows whose identifier is null don't count for that identifier; a null in a group column is a group of its own, which
    ``bucket_counts`` leaves out where the column is part of the combination.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), col(k).cast("string").alias("id")) for k in identifiers))
    names = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*(col(g).alias(n) for g, n in zip(groups, names)), F.explode(kinds).alias("k")).where("k.id is not null")
    return rows.select("k.kind", F.pmod(F.xxhash64("k.id"), F.lit(buckets)).cast("int").alias("bucket"), *names, "k.id").distinct()


def merge_pairs(*states: DataFrame) -> DataFrame:
    """The state of several pieces of data together; the pieces may overlap."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.distinct()


def _deduplicated(pairs: DataFrame, n_groups: int, combinations: Sequence[Sequence[int]]) -> DataFrame:
    """kind, combination, g0.., bucket: one row for each distinct identifier of each group of each combination.

    A combination is made from the smallest already deduplicated one that contains it.
    """
    made: dict[tuple[int, ...], DataFrame] = {tuple(range(n_groups)): pairs}
    whole, kinds = None, dict(pairs.dtypes)
    for c in sorted((tuple(sorted(c)) for c in combinations), key=lambda c: -len(c)):
        if c not in made:
            finer = min((x for x in made if set(c) <= set(x)), key=len)
            made[c] = made[finer].select("kind", "bucket", *(f"g{i}" for i in c), "id").distinct()
        level = made[c]
        for i in c:
            level = level.where(F.col(f"g{i}").isNotNull())
        groups = (F.col(f"g{i}") if i in c else F.lit(None).cast(kinds[f"g{i}"]).alias(f"g{i}") for i in range(n_groups))
        level = level.select("kind", F.lit(",".join(map(str, c))).alias("combination"), *groups, "bucket")
        whole = level if whole is None else whole.unionByName(level)
    return whole


def bucket_counts(pairs: DataFrame, n_groups: int, combinations: Sequence[Sequence[int]]) -> DataFrame:
    """kind, combination, g0.., bucket, n: exact distinct counts per bucket for combinations of the group columns (by number)."""
    rows = _deduplicated(pairs, n_groups, combinations)
    return rows.groupBy("kind", "combination", *(f"g{i}" for i in range(n_groups)), "bucket").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, identifiers: Sequence[str], groups: Sequence[str], combinations: Sequence[Sequence[str]], buckets: int = BUCKETS) -> DataFrame:
    """Distinct counts of each identifier for each combination of groups: combination (names joined by ``,``; "" is all
    rows), the group columns (null where not in the combination), n_<identifier> for each, and error_bound (0.0).

    Null identifiers and, within a combination, null group values don't count. Groups in which no identifier is left have
    no row; a group in which one of several identifiers is missing has 0 there. Repeated rows change nothing. An empty
    table has no rows.
    """
    index = {g: i for i, g in enumerate(groups)}
    pairs = identifier_pairs(df, identifiers, groups, buckets)
    if len(combinations) > 1:
        pairs = stored(pairs)  # else each combination would scan and deduplicate the input again
    rows = _deduplicated(pairs, len(groups), [[index[g] for g in c] for c in combinations])
    names = [f"g{i}" for i in range(len(groups))]
    added = rows.groupBy("combination", *names).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in identifiers))
    title = F.lit("")
    for c in combinations:
        title = F.when(F.col("combination") == ",".join(map(str, sorted(index[g] for g in c))), ",".join(g for g in groups if g in c)).otherwise(title)
    return added.select(title.alias("combination"), *(F.col(n).alias(g) for n, g in zip(names, groups)), *(f"n_{k}" for k in identifiers), F.lit(0.0).alias("error_bound"))

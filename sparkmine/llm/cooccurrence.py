"""Items that appear together: exact pair counts with lift and pointwise mutual information.

Baskets are deduplicated, every basket emits its ordered pairs inside the JVM, partial aggregation combines the
counts before the shuffle, and the marginals turn counts into lift and PMI. Three things keep this feasible:

* Pruning that loses nothing. A pair occurs in at most as many baskets as its rarer item, so items below
  ``min_count`` go; and n12 * N >= L * n1 * n2 with n12 <= min(n1, n2) needs max(n1, n2) <= N / L, so items
  above that, the very popular ones that cause most pairs, go as well.
* Large baskets are cut into hash blocks. A block pair, not a basket, is the unit of work, so a basket that holds
  a third of all rows spreads over many tasks and no task holds more than about two blocks of it.
* Popular items are handled by the partial aggregation, over pairs that are one number each; the join that numbers the
  items is a broadcast while items are few (counted) and else left to adaptive skew joins.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sketches import dense_index
from ..runtime import col, sent_if_few, stored


def item_pairs(df: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float | None = None, block: int = 512) -> DataFrame:
    """Every pair of items sharing at least min_count baskets, with a lift of at least min_lift if given.

    Returns item_1 < item_2, n_both, n_1, n_2, n_baskets, lift = n_both * n_baskets / (n_1 * n_2), and
    pmi = log2(lift). Counts are exact and cover all rows.

    Rows whose basket or item is null do not count, and a basket is a key with at least one countable row. Repeated
    rows count once. A basket of one item counts in the marginals only. Other columns, whatever their names, are
    ignored. An empty table gives no rows. A lift that equals min_lift is kept (compared exactly, not as doubles).
    block: items in a block of a large basket.
    """
    rows = stored(df.select(col(basket).alias("b"), col(item).alias("i")).where("b is not null and i is not null").distinct())
    n_baskets = rows.agg(F.count_distinct("b")).first()[0]
    bound = Fraction(min_lift).limit_denominator(10**6) if min_lift else None

    items = rows.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    if bound:
        items = items.where(F.col("n") * bound.numerator <= n_baskets * bound.denominator)
    # kept items have numbers 0, 1, 2 ..., so that a pair of them is one long number
    items = stored(dense_index(items, "no"))
    n_items = items.count()
    rows = rows.join(sent_if_few(items.select("i", "no"), n_items), "i").select("b", "no")

    large = rows.groupBy("b").agg(F.count("*").alias("size")).where(F.col("size") > block)
    n_large = large.count()
    if n_large:
        blocks = F.coalesce(F.ceil(F.col("size") / block).cast("int"), F.lit(1))
        rows = rows.join(sent_if_few(large, n_large), "b", "left").select("b", "no", blocks.alias("blocks"))
        rows = rows.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("no"), F.col("blocks"))).otherwise(0).cast("int"))
        rows = rows.select("b", "no", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        units = rows.groupBy("b", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(
            F.sort_array(F.collect_list(F.when(F.col("own") == F.least("own", "other"), F.col("no")))).alias("xs"),
            F.sort_array(F.collect_list(F.when(F.col("own") != F.least("own", "other"), F.col("no")))).alias("ys"),
        )
    else:
        units = rows.groupBy("b").agg(F.sort_array(F.collect_list("no")).alias("xs")).select(F.lit(0).alias("lo"), F.lit(0).alias("hi"), "xs", F.expr("slice(xs, 1, 0)").alias("ys"))
    one = units.where("lo < hi or size(xs) > 1").select("lo", "hi", "xs", "ys", F.posexplode("xs").alias("at", "x"))
    rest = F.when(F.col("lo") == F.col("hi"), F.expr("slice(xs, at + 2, size(xs))")).otherwise(F.col("ys"))
    two = one.select("x", F.explode(rest).alias("y"))
    pair = F.least("x", "y") * F.lit(n_items) + F.greatest("x", "y")
    pairs = two.groupBy(pair.alias("pair")).agg(F.count("*").alias("n_both")).where(F.col("n_both") >= min_count)
    pairs = pairs.select(F.expr(f"pair div {max(1, n_items)}").alias("no_1"), F.expr(f"pair % {max(1, n_items)}").alias("no_2"), "n_both")
    for k in (1, 2):
        pairs = pairs.join(sent_if_few(items.select(F.col("no").alias(f"no_{k}"), F.struct("i", "n").alias(f"x_{k}")), n_items), f"no_{k}")
    low, high = F.least("x_1", "x_2"), F.greatest("x_1", "x_2")
    pairs = pairs.select(low["i"].alias("item_1"), high["i"].alias("item_2"), low["n"].alias("n_1"), high["n"].alias("n_2"), "n_both")

    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("n_both", "n_1", "n_2")}
    if bound:
        pairs = pairs.where(whole["n_both"] * F.lit(n_baskets).cast("decimal(18,0)") * bound.denominator >= whole["n_1"] * whole["n_2"] * bound.numerator)
    lift = F.col("n_both") * F.lit(float(n_baskets)) / F.col("n_1") / F.col("n_2")
    return pairs.select("item_1", "item_2", "n_both", "n_1", "n_2", F.lit(n_baskets).cast("long").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))

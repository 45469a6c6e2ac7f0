"""python -m tests.llm.skew_trial [ROWS]: times every operator on ROWS rows and on four times as many, in which one key holds a third.

Not a test: what is printed should grow about as the rows do, and the longest task should not take the time of a third of all
rows. Each line: operator, seconds for ROWS, seconds for 4 * ROWS, their ratio.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmine.llm.cooccurrence import item_pairs
from sparkmine.llm.distinct import distinct_counts
from sparkmine.llm.frequent import frequent_values
from sparkmine.llm.leakage import leaked_items
from sparkmine.llm.packing import packed
from sparkmine.llm.reservoir import fixed_sample
from sparkmine.llm.seen import seen_before
from sparkmine.llm.setjoin import similar_classes
from sparkmine.operators.balance import fragment_replicate_join, key_statistics
from sparkmine.runtime import scratch


def rows(spark: SparkSession, n: int) -> DataFrame:
    """id, k (a third of all rows have the key hot), x (a value), y (another)."""
    d = spark.range(0, n, 1, 16)
    return d.select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(n // 8)).cast("string"))).alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n // 4)).alias("x"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).alias("y"))


def trials(r: DataFrame, n: int) -> dict:
    """A call for each operator, over rows with a hot basket, set of copies, identifier, group, key, piece or id."""
    spark = r.sparkSession
    hot = F.col("k") == "hot"
    copies = r.select(F.when(hot, F.concat(F.lit("c"), (F.col("id") / 15).cast("long").cast("string"))).otherwise(F.col("k")).alias("s"), F.when(hot, F.col("id") / 3 % 5).otherwise(F.col("x")).cast("long").alias("t"))
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(200)], "i long, p string")
    texts = r.select("id", F.when(hot, F.lit(" ".join(f"w7x{j}" for j in range(14)))).otherwise(F.concat_ws(" ", *([F.col("x")] * 12))).alias("t"))
    return {
        "item_pairs": lambda: item_pairs(r.select(F.when(hot, F.col("id") % (n // 30)).otherwise(F.col("x")).alias("b"), F.when(hot, F.lit(-1)).otherwise(F.col("y")).alias("i")), "b", "i", 2),
        "similar_classes": lambda: similar_classes(copies, "s", "t", 0.5)[0],
        "distinct_counts": lambda: distinct_counts(r, ["k", "x"], ["y"], [["y"], []]),
        "fixed_sample": lambda: fixed_sample(r, 100, piece="y"),
        "seen_before": lambda: seen_before(r, "k", "id"),
        "frequent_values": lambda: frequent_values(r, ["k", "x"], 10),
        "key_statistics": lambda: key_statistics(r.withColumn("r", F.col("id").cast("string")), [("k", "x")], "r", "y"),
        "fragment_replicate_join": lambda: fragment_replicate_join(r, r.select("k").distinct().withColumn("w", F.length("k")), "k"),
        "packed": lambda: packed(r.select(F.when(hot, F.lit(0)).otherwise(F.col("id")).alias("i"), (F.col("y") * 30 + 1).alias("n")), "i", "n"),
        "leaked_items": lambda: leaked_items(texts, "id", "t", items, "i", "p"),
    }


def main(n: int) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, list[float]] = {}
    for size in (n // 10, n, 4 * n):  # the first warms up
        with scratch():
            r = rows(spark, size)
            for name, run in trials(r, size).items():
                began = time.perf_counter()
                run().write.format("noop").mode("overwrite").save()
                took.setdefault(name, []).append(time.perf_counter() - began)
    for name, (_, a, b) in took.items():
        print(f"{name:24} {a:7.1f} s {b:7.1f} s {b / a:5.1f}")


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000)

"""Most frequent values by exact, spillable aggregation.

Values are counted with map-side combining, hash partitions spill to disk, each partition keeps its own top k and one
ordered limit joins them (Spark's TakeOrderedAndProject). A popular value is combined on the map side, so no task sees
more than one row of it from each mapper. Memory is bounded by the aggregation's own limits and by k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import col, stored


def frequent_values(df: DataFrame, fields: Sequence[str], k: int, record: str | None = None) -> DataFrame:
    """The k most frequent values of each field: field_name, key_value, n_records, n_total, share, place.

    Counts are exact. With ``record`` a distinct value of that column is one record, however often it is delivered, and
    rows where it is null are none; without it every row is one. n_total counts all records, those without the value
    as well. Null values are not ranked. Ties are ordered by value. An empty table has no rows.
    """
    whole = F.struct(F.lit("").alias("field_name"), F.lit("").alias("key_value"))
    keys = F.array(whole, *(F.struct(F.lit(f).alias("field_name"), col(f).cast("string").alias("key_value")) for f in fields))
    if record is None:
        rows = df.select(F.explode(keys).alias("k")).where("k.key_value is not null").select("k.*")
    else:
        rows = df.where(col(record).isNotNull()).select(col(record).alias("record"), F.explode(keys).alias("k")).where("k.key_value is not null")
        rows = rows.select("k.*", "record").distinct()
    # kept as a table: the ranking of each field reads it, and would else scan and count everything again
    counts = stored(rows.groupBy("field_name", "key_value").agg(F.count("*").alias("n_records")))
    total = counts.where("field_name = ''").select(F.col("n_records").alias("n_total"))
    top = None
    for f in fields:
        # ordered limit: top k of each partition, then of all
        own = counts.where(F.col("field_name") == f).orderBy(F.desc("n_records"), "key_value").limit(k)
        top = own if top is None else top.unionByName(own)
    ranked = top.withColumn("place", F.row_number().over(W.partitionBy("field_name").orderBy(F.desc("n_records"), "key_value")))
    # the total is one row
    return ranked.join(F.broadcast(total)).select("field_name", "key_value", "n_records", "n_total", (F.col("n_records") / F.col("n_total")).alias("share"), "place")

"""Stream sketches over batches of a stream, in set form: Bloom filter, Flajolet-Martin count, reservoir.

A stream is a frame with a batch number and a sequence number that is unique and grows with the batches. The results are
those of reading the stream record by record, but no order of execution is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import P, coefficients, linear_hashes, text_number
from ..runtime import col, stored

BITS = 69_997
FM_FAMILY = coefficients(100, seed=23)
FM_GROUPS, FM_PER_GROUP = 13, 7


def stream(df: DataFrame, seq: str, value: str, batch_size: int) -> DataFrame:
    """seq, batch, value (text) of the rows with a sequence number and a value."""
    rows = df.select(col(seq).cast("long").alias("seq"), col(value).cast("string").alias("value")).where("seq is not null and value is not null")
    return rows.withColumn("batch", F.floor(F.col("seq") / batch_size).cast("long"))


def dense_index(df: DataFrame, name: str = "row_no") -> DataFrame:
    """df with row numbers 0, 1, 2 ... in the order of its partitions: numbers within each partition, plus the rows of
    those before it. Only one count a partition is gathered."""
    marked = df.select("*", F.monotonically_increasing_id().alias("_id"))
    marked = stored(marked.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(2**33 - 1)).alias("_at")))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    return marked.join(before, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_id", "_part", "_at", "_before")


def simulated_stream(df: DataFrame, value: str, batch_size: int, batches: int, seed: int = 0, index: str | None = None) -> DataFrame:
    """batch, seq, value: batches of records drawn uniformly with replacement from all rows of df; a join, not a re-reading
    of the data for each batch. The draws come from hashes of (seed, seq), so they are the same every time.

    index: a column that numbers the rows 0, 1, 2 ..., if df has one. An empty table gives no rows.
    """
    rows = dense_index(df.select(col(value).cast("string").alias("value")), "row_no") if index is None else df.select(col(value).cast("string").alias("value"), col(index).cast("long").alias("row_no"))
    n = rows.count()
    draws = df.sparkSession.range(batch_size * batches if n else 0).select(F.col("id").alias("seq"), F.floor(F.col("id") / batch_size).cast("long").alias("batch"))
    draws = draws.withColumn("row_no", F.pmod(text_number(F.concat_ws("/", F.lit(str(seed)), F.col("seq").cast("string"))), F.lit(max(1, n))))
    return draws.join(rows, "row_no").select("batch", "seq", "value")


def hash_count(bits: int, expected: int) -> int:
    """The best number of hashes for so many expected values, at least 1."""
    return max(1, round(bits / max(1, expected) * math.log(2)))


def bloom_rates(rows: DataFrame, hashes: int, bits: int = BITS, seed: int = 17) -> DataFrame:
    """batch, false_positives, true_negatives, fpr: how a Bloom filter that takes in every value does, batch by batch.

    A record tests positive if all its bits were set by records before it, that is if each bit's first setter precedes it.
    fpr is over the values not seen before; null where a batch has none.
    """
    coeffs = coefficients(hashes, seed)
    firsts = rows.groupBy("value").agg(F.min("seq").alias("first"))
    # only a value's first record sets bits; the others find them set and are seen
    places = firsts.select("first", F.array_distinct(F.transform(linear_hashes(text_number(F.col("value")), coeffs), lambda h: F.pmod(h, F.lit(bits)))).alias("at"))
    setters = places.select("first", F.explode("at").alias("place"))
    bit = setters.groupBy("place").agg(F.min("first").alias("set_by"))
    tested = setters.join(bit, "place").groupBy("first").agg(F.min((F.col("set_by") < F.col("first")).cast("int")).alias("positive"))
    new = rows.select("seq", "batch").join(tested, F.col("seq") == F.col("first"))
    by = new.groupBy("batch").agg(F.sum(F.col("positive").cast("long")).alias("false_positives"), F.sum((1 - F.col("positive")).cast("long")).alias("true_negatives"))
    every = rows.select("batch").distinct().join(by, "batch", "left")
    fp, tn = (F.coalesce(c, F.lit(0)) for c in ("false_positives", "true_negatives"))
    return every.select("batch", fp.alias("false_positives"), tn.alias("true_negatives"), F.try_divide(fp.cast("double"), (fp + tn).cast("double")).alias("fpr"))


def distinct_estimates(rows: DataFrame, coeffs: list[tuple[int, int]] = FM_FAMILY) -> DataFrame:
    """batch, n_distinct, estimate: the Flajolet-Martin estimate of each batch's distinct values, with the truth.

    For each hash 2**(most trailing zeros); the values in ascending order are cut into 13 groups of 7 (the rest, the
    largest, is left out); the median of the groups' means, rounded. A hash of 0 counts as having no trailing zeros.
    """
    values = rows.select("batch", "value").distinct()
    truth = values.groupBy("batch").agg(F.count("*").alias("n_distinct"))
    # in generated code, one column a hash: the lowest set bit of each hash, 0 for none; the largest per batch
    hashed = values.select("batch", F.pmod(text_number(F.col("value")), F.lit(P)).alias("x"))
    hashed = hashed.select("batch", *(F.pmod(F.lit(a).cast("bigint") * F.col("x") + F.lit(b).cast("bigint"), F.lit(P)).alias(f"h{i}") for i, (a, b) in enumerate(coeffs)))
    low = hashed.groupBy("batch").agg(*(F.max(F.col(f"h{i}").bitwiseAND(-F.col(f"h{i}"))).alias(f"l{i}") for i in range(len(coeffs))))
    most = low.select("batch", *(F.when(F.col(f"l{i}") == 0, F.lit(0)).otherwise(F.bit_count(F.col(f"l{i}") - 1)).alias(f"r{i}") for i in range(len(coeffs))))
    powers = most.select("batch", F.posexplode(F.array_sort(F.array(*(F.pow(F.lit(2.0), f"r{i}") for i in range(len(coeffs)))))).alias("at", "p"))
    means = powers.where(F.col("at") < FM_GROUPS * FM_PER_GROUP).groupBy("batch", F.floor(F.col("at") / FM_PER_GROUP).alias("g")).agg(F.avg("p").alias("m"))
    return means.groupBy("batch").agg(F.round(F.median("m")).cast("long").alias("estimate")).join(truth, "batch").select("batch", "n_distinct", "estimate")


def reservoir_slots(rows: DataFrame, size: int = 100, show: tuple[int, ...] = (0, 20, 40, 60, 80)) -> DataFrame:
    """seen, then slot_<i>: what the shown slots of the reservoir hold after each batch.

    The t-th record fills slot t while there is room; later it is accepted with probability size / t into a random slot. Both
    draws come from hashes of the record's place and not from the state, so a slot holds the last record accepted into it.
    Places are counted per batch first, then offset by the batches before.
    """
    counts = rows.groupBy("batch").agg(F.count("*").alias("n"))
    before = counts.select("batch", "n", (F.sum("n").over(W.orderBy("batch")) - F.col("n")).alias("before"))  # one row a batch
    t = rows.join(before, "batch").withColumn("t", F.col("before") + F.row_number().over(W.partitionBy("batch").orderBy("seq")))
    draw = lambda salt: F.pmod(text_number(F.concat(F.lit(salt), F.col("t").cast("string"))), F.lit(P))
    slot = F.when(F.col("t") <= size, F.col("t") - 1).when(F.pmod(draw("a"), F.col("t")) < size, F.pmod(draw("s"), F.lit(size)))
    put = t.select("batch", "t", slot.alias("slot"), "value").where(F.col("slot").isin(*show))
    last = put.groupBy("batch", "slot").agg(F.max(F.struct("t", "value")).alias("last"))
    wide = before.join(last, "batch", "left").groupBy("batch", (F.col("before") + F.col("n")).alias("seen")).agg(*(F.max(F.when(F.col("slot") == s, F.col("last"))).alias(f"l{s}") for s in show))
    so_far = W.orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    return wide.select("batch", "seen", *(F.max(f"l{s}").over(so_far)["value"].alias(f"slot_{s}") for s in show))

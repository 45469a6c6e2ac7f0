"""Hash values that Spark and other SQL engines compute alike: md5 based, with linear families on top."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime modulus of the linear families; products of two smaller values fit a long.
P = 2**31 - 1


def text_number(c: Column) -> Column:
    """A value of 0 to 2**60 - 1 from the md5 of a text."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def coefficients(n: int, seed: int) -> list[tuple[int, int]]:
    """n pairs (a, b) below P, with a > 0."""
    rng = random.Random(seed)
    return [(rng.randrange(1, P), rng.randrange(P)) for _ in range(n)]


def linear_hashes(c: Column, coeffs: list[tuple[int, int]]) -> Column:
    """An array with (a * (x mod P) + b) mod P for each pair."""
    x = F.pmod(c, F.lit(P))
    return F.transform(F.array(*(F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in coeffs)), lambda h: F.pmod(h["a"] * x + h["b"], F.lit(P)))


def coefficient_frame(spark: SparkSession, coeffs: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(coeffs)], "hash_no int, a long, b long")


def coefficient_sql(coeffs: list[tuple[int, int]]) -> str:
    """The same table as SQL values (hash_no, a, b)."""
    return "(values " + ", ".join(f"({i}, {a}::bigint, {b}::bigint)" for i, (a, b) in enumerate(coeffs)) + ") h(hash_no, a, b)"


TEXT_NUMBER_SQL = "('0x' || substr(md5({0}), 1, 15))::bigint"

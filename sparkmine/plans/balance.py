"""Queries of skewed keys: problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.balance import fragment_replicate_join, key_statistics
from ..sources.tables import table


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews with clean ids; the columns not asked for are pruned from the scan."""
    r = table(spark, sf_dir, "review")
    return r.withColumns({c: clean_id(F.col(c)) for c in ("review_id", "user_id", "business_id")})


FIELDS = [("business_id", "user_id"), ("user_id", "business_id")]


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key, with the stars that the business and user files give it replicated to the shards of its reviews."""
    b = table(spark, sf_dir, "business").select(clean_id(F.col("business_id")).alias("id"), "stars")
    u = table(spark, sf_dir, "yelp_user").select(clean_id(F.col("user_id")).alias("id"), "average_stars")
    sides = {"business_id": (b, "id", "stars"), "user_id": (u, "id", "average_stars")}
    return key_statistics(reviews(spark, sf_dir), FIELDS, "review_id", "stars", version="loaded_at", sides=sides)


def key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _statistics(spark, sf_dir)
    return s.select("field_name", "key_value", F.col("n_records").alias("n_reviews"), F.round("mean_value", 6).alias("mean_stars"), "n_counterparts", F.col("listed_value").alias("listed_stars"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir).where("n_records * 100 >= n_total * 2").select("field_name", "key_value")


def listed_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each business's mean delivered stars next to its listed ones, over the skewed join of reviews with businesses."""
    r = reviews(spark, sf_dir).select("business_id", F.col("stars").alias("given"))
    b = table(spark, sf_dir, "business").select(clean_id(F.col("business_id")).alias("business_id"), "city", "stars")
    j = fragment_replicate_join(r, b, "business_id")
    return j.groupBy("business_id", "city", F.col("stars").alias("listed_stars")).agg(F.count("*").alias("n_deliveries"), F.round(F.avg("given"), 6).alias("mean_stars"))


QUERIES = {"p7_found": found, "p7_key_stats": key_stats, "p7_listed_stars": listed_stars}

_CLEAN = "nullif(trim({0}, ' \t\r\n'), '')"
_REVIEWS = f"""with r as (select {_CLEAN.format('review_id')} rid, {_CLEAN.format('user_id')} u, {_CLEAN.format('business_id')} b, stars, loaded_at from review),
d as (select rid, max(u) u, max(b) b, arg_max(stars, (loaded_at, coalesce(stars, -1))) stars from r where rid is not null group by rid),
k as (select 'business_id' field_name, b key_value, u other, stars from d where b is not null union all select 'user_id', u, b, stars from d where u is not null),
s as (select field_name, key_value, count(*) n_reviews, round(avg(stars), 6) mean_stars, count(distinct other) n_counterparts from k group by 1, 2)
"""
SQL = {
    "p7_found": _REVIEWS + "select field_name, key_value from s where n_reviews * 100 >= 2 * (select count(*) from d)",
    "p7_key_stats": _REVIEWS + f""", l as (select 'business_id' field_name, {_CLEAN.format('business_id')} key_value, max(stars) listed_stars from business group by 1, 2
union all select 'user_id', {_CLEAN.format('user_id')}, max(average_stars) from yelp_user group by 1, 2) select s.*, listed_stars from s left join l using (field_name, key_value)""",
    "p7_listed_stars": f"""select {_CLEAN.format('b.business_id')} business_id, city, b.stars listed_stars, count(*) n_deliveries, round(avg(r.stars), 6) mean_stars from review r join business b
on {_CLEAN.format('r.business_id')} = {_CLEAN.format('b.business_id')} group by 1, 2, 3""",
}

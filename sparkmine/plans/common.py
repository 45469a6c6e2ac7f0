"""Views of the tables that several queries use, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import clean_id, whole_number_id
from ..operators.itemsets import baskets
from ..operators.recommend import ratings
from ..operators.similarity import members
from ..sources.files import without_headers
from ..sources.tables import table

CLEAN_SQL = "nullif(trim({0}, ' \t\r\n'), '')"
WHOLE_SQL = "try_cast(nullif(regexp_extract(trim({0}, ' \t\r\n'), '^([+-]?[0-9]+)(\\.0*)?$', 1), '') as bigint)"
DAY_SQL = "try_cast(replace(regexp_extract(trim({0}, ' \t\r\n'), '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})([^0-9]|$)', 1), '/', '-') as date)"


def user_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item) of small2: users and their businesses, as whole numbers."""
    return baskets(table(spark, sf_dir, "small2"), whole_number_id(F.col("user_id")), whole_number_id(F.col("business_id")))


BASKETS_SQL = f"select distinct u basket, i item from (select {WHOLE_SQL.format('user_id')} u, {WHOLE_SQL.format('business_id')} i from small2) where u is not null and i is not null"


def clean_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating) of yelp_train."""
    t = without_headers(table(spark, sf_dir, "yelp_train"))
    t = t.select(clean_id(F.col("user_id")).alias("user_id"), clean_id(F.col("business_id")).alias("business_id"), "stars")
    return ratings(t, "user_id", "business_id", "stars")


RATINGS_SQL = f"""select {CLEAN_SQL.format('user_id')} u, {CLEAN_SQL.format('business_id')} i, avg(stars) rating from yelp_train
where {CLEAN_SQL.format('user_id')} is not null and {CLEAN_SQL.format('business_id')} is not null and stars is not null
and not (trim(user_id, ' ') = 'user_id' and trim(business_id, ' ') = 'business_id') group by 1, 2"""


def business_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, member) of yelp_train: businesses and their users."""
    t = without_headers(table(spark, sf_dir, "yelp_train"))
    return members(t.select(clean_id(F.col("business_id")).alias("b"), clean_id(F.col("user_id")).alias("u")), "b", "u")


MEMBERS_SQL = f"""select distinct {CLEAN_SQL.format('business_id')} id, {CLEAN_SQL.format('user_id')} member from yelp_train
where {CLEAN_SQL.format('user_id')} is not null and {CLEAN_SQL.format('business_id')} is not null and not (trim(user_id, ' ') = 'user_id' and trim(business_id, ' ') = 'business_id')"""

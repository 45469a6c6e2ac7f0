"""Review-style analytics: counts, distinct counts, averages, top-k, partition profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import TEXT_NUMBER_SQL, text_number
from ..functions.ids import calendar_day, clean_id
from ..operators import analytics as a
from ..sources.tables import table
from .common import CLEAN_SQL, DAY_SQL


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "review")
    return r.select(clean_id(F.col("user_id")).alias("user_id"), clean_id(F.col("business_id")).alias("business_id"), "stars", calendar_day(F.col("date")).alias("day"))


def _in_2018():
    return F.coalesce(F.substring("day", 1, 4) == "2018", F.lit(False))


def review_count(spark, sf_dir):
    return a.count_rows(table(spark, sf_dir, "review"), "n_review")


def reviews_in_2018(spark, sf_dir):
    return a.count_where(_reviews(spark, sf_dir), _in_2018(), "n_review_2018")


def distinct_users(spark, sf_dir):
    return a.count_different(_reviews(spark, sf_dir), "user_id", name="n_user")


def distinct_businesses(spark, sf_dir):
    return a.count_different(_reviews(spark, sf_dir), "business_id", name="n_business")


def top10_users(spark, sf_dir):
    return a.top_k(_reviews(spark, sf_dir), "user_id", 10, "n_review")


def top10_businesses(spark, sf_dir):
    return a.top_k(_reviews(spark, sf_dir), "business_id", 10, "n_review")


def review_report(spark, sf_dir):
    r = a.report(_reviews(spark, sf_dir), "user_id", "business_id", _in_2018())
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["key"], x["n"].cast("string"))), ",")
    return r.select("n_review", F.col("n_review_in").alias("n_review_2018"), "n_user", text("top_user").alias("top10_user"), F.col("n_item").alias("n_business"), text("top_item").alias("top10_business"))


def city_stars(spark, sf_dir):
    b = table(spark, sf_dir, "business").select(clean_id(F.col("business_id")).alias("business_id"), "city")
    j = _reviews(spark, sf_dir).select("business_id", "stars").join(b, "business_id")
    return a.group_mean(j, "city", "stars", "stars", 6).orderBy(F.desc("stars"), "city")


def avg_price_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join, group mean and total order."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return a.group_mean(j, "c_nationkey", "o_totalprice", "avg_price", 4).orderBy(F.desc("avg_price"), "c_nationkey")


def event_count(spark, sf_dir):
    return a.count_rows(table(spark, sf_dir, "events"), "n_events")


def events_by_month(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.year("ts").cast("long").alias("y"), F.month("ts").cast("long").alias("m"))
    return a.group_count(e, "y", "m", name="n_events")


def top10_customers(spark, sf_dir):
    return a.top_k(table(spark, sf_dir, "orders"), "o_custkey", 10, "n_orders")


def top10_parts(spark, sf_dir):
    return a.top_k(table(spark, sf_dir, "lineitem"), "l_partkey", 10, "n_lines")


def top_event_types(spark, sf_dir):
    """The most frequent event types, with ties."""
    return a.top_groups(a.group_count(table(spark, sf_dir, "events"), "event_type", name="n_events"), "n_events")


def order_baskets_over_6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return a.at_least(li, "l_orderkey", "l_partkey", 6, "n_parts")


def customer_day_baskets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyyMMdd")).alias("basket"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return a.at_least(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "basket", "l_partkey", 6, "n_parts")


def partition_profile(spark, sf_dir):
    """Reviews over all partitions of the scan, each counted in one."""
    return a.partition_profile(table(spark, sf_dir, "review")).agg(F.sum("n_items").alias("n_items"), (F.count_distinct("partition_id") == F.count("*")).alias("each_once"))


def hash_partition_profile(spark, sf_dir):
    """Reviews in 16 partitions by a hash of the business that any engine can compute."""
    r = _reviews(spark, sf_dir)
    return a.placed_profile(r, 16, F.coalesce(text_number(F.col("business_id")), F.lit(0)) % 16)


def partition_study(spark, sf_dir):
    s = a.partition_study(table(spark, sf_dir, "review"), "business_id", 16)
    return s.select("kind", "n_total", (F.col("n_partition") == F.size("n_items")).alias("listed"), (F.col("exe_time") > 0).alias("timed"))


def sort_study(spark, sf_dir):
    s = a.sort_study(city_stars(spark, sf_dir).where("city is not null"), "stars", "city")
    return s.select("kind", F.array_join("top", "|").alias("top10"), (F.col("exe_time") > 0).alias("timed"))


QUERIES = {f.__name__: f for f in (avg_price_by_nation, review_count, reviews_in_2018, distinct_users, distinct_businesses, top10_users, top10_businesses, review_report, city_stars, event_count, events_by_month, top10_customers, top10_parts, top_event_types, order_baskets_over_6, customer_day_baskets, partition_profile, hash_partition_profile, partition_study, sort_study)}

_U, _B, _D = CLEAN_SQL.format("user_id"), CLEAN_SQL.format("business_id"), DAY_SQL.format("date")
_TOP = "select {0} {1}, count(*) n_review from review where {0} is not null group by 1 order by 2 desc, 1 limit 10"
_TEXT = "(select string_agg({1} || ':' || n_review, ',' order by n_review desc, {1}) from (" + _TOP + "))"
SQL = {
    "avg_price_by_nation": "select c_nationkey, round(avg(o_totalprice), 4) avg_price from orders join customer on o_custkey = c_custkey group by 1",
    "review_count": "select count(*) n_review from review",
    "reviews_in_2018": f"select count(*) n_review_2018 from review where year({_D}) = 2018",
    "distinct_users": f"select count(distinct {_U}) n_user from review",
    "distinct_businesses": f"select count(distinct {_B}) n_business from review",
    "top10_users": _TOP.format(_U, "user_id"),
    "top10_businesses": _TOP.format(_B, "business_id"),
    "review_report": f"""select (select count(*) from review) n_review, (select count(*) from review where year({_D}) = 2018) n_review_2018,
(select count(distinct {_U}) from review) n_user, {_TEXT.format(_U, 'user_id')} top10_user, (select count(distinct {_B}) from review) n_business, {_TEXT.format(_B, 'business_id')} top10_business""",
    "city_stars": f"select city, round(avg(r.stars), 6) stars from review r join business b on {CLEAN_SQL.format('r.business_id')} = {CLEAN_SQL.format('b.business_id')} group by city",
    "partition_profile": "select count(*) n_items, true each_once from review",
    "hash_partition_profile": f"select (coalesce({TEXT_NUMBER_SQL.format(_B)}, 0) % 16)::int partition_id, count(*) n_items from review group by 1",
    "partition_study": "select kind, (select count(*) from review) n_total, true listed, true timed from (values ('default'), ('custom')) t(kind)",
    "sort_study": f"""with m as (select city, round(avg(r.stars), 6) stars from review r join business b on {CLEAN_SQL.format('r.business_id')} = {CLEAN_SQL.format('b.business_id')} where city is not null group by city)
select kind, (select string_agg(city, '|' order by stars desc, city) from (select * from m order by stars desc, city limit 10)) top10, true timed from (values ('limit'), ('whole')) t(kind)""",
    "event_count": "select count(*) n_events from events",
    "events_by_month": "select year(ts) y, month(ts) m, count(*) n_events from events group by 1, 2",
    "top10_customers": "select o_custkey, count(*) n_orders from orders group by 1 order by 2 desc, 1 limit 10",
    "top10_parts": "select l_partkey, count(*) n_lines from lineitem group by 1 order by 2 desc, 1 limit 10",
    "top_event_types": "with c as (select event_type, count(*) n_events from events group by 1) select * from c where n_events = (select max(n_events) from c)",
    "order_baskets_over_6": "select l_orderkey, count(distinct l_partkey) n_parts from lineitem group by 1 having count(distinct l_partkey) > 6",
    "customer_day_baskets": "select o_custkey || '-' || strftime(o_orderdate, '%Y%m%d') basket, count(distinct l_partkey) n_parts from lineitem join orders on l_orderkey = o_orderkey group by 1 having count(distinct l_partkey) > 6",
}

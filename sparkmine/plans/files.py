"""Tables written to files of each format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import itemsets as its
from ..runtime import new_path, stored
from ..sources import files
from ..sources.tables import table
from . import graphs, mining
from .common import user_baskets


def in_memory_rows(spark, sf_dir):
    """Rows fetched into the driver (25 nations) and handed back as a frame."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()
    return spark.createDataFrame([tuple(r) for r in rows], "n_nationkey int, n_name string, n_regionkey int").where("n_regionkey != 0")


def json_lines(spark, sf_dir):
    """Businesses as JSON lines."""
    path = new_path(spark)
    files.write_json(table(spark, sf_dir, "business").select("business_id", "name", "city", "stars", "review_count"), path)
    return files.read_json_lines(spark, path, files.BUSINESS)


def json_documents(spark, sf_dir):
    """Event properties, a JSON text in each row, taken apart and counted."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("total"))


def text_lines(spark, sf_dir):
    """Businesses as one JSON text a line, read as text."""
    path = new_path(spark)
    files.write_report(files.document(table(spark, sf_dir, "business").select("business_id", "review_count")), path)
    lines = files.read_text(spark, path)
    return lines.select(F.get_json_object("value", "$.business_id").alias("business_id"), F.get_json_object("value", "$.review_count").cast("int").alias("review_count"))


def csv_with_header(spark, sf_dir):
    """Ratings as they are, with their white space, null ids and stray header lines, in quoted CSV."""
    path = new_path(spark)
    files.write_csv(table(spark, sf_dir, "yelp_train").select("user_id", "business_id", "stars"), path)
    return files.read_csv(spark, path, files.RATING)


def csv_by_position(spark, sf_dir):
    """Plain CSV without header and quotes; the names are those of the schema given."""
    path = new_path(spark)
    files.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path, header=False)
    return files.read_csv(spark, path, "part_no long, brand string, part_size int", header=False, quoted=False)


def csv_transactions(spark, sf_dir):
    """Quoted lines of six fields, read as transactions."""
    path = new_path(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    files.write_csv(j.select("day", "o_custkey", F.concat("l_returnflag", F.lit(", "), "l_linestatus").alias("c2"), F.lit("").alias("c3"), "l_returnflag", F.format_string("%07d", "l_partkey").alias("c5")), path)
    return files.read_transactions(spark, path).groupBy("basket", "item").agg(F.count("*").alias("n"))


def csv_points(spark, sf_dir):
    """Embeddings as lines of index, label and coordinates."""
    path = new_path(spark)
    e = table(spark, sf_dir, "embeddings")
    files.write_csv(e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64))), path, header=False)
    p = files.read_points(spark, path, 64)
    return p.select("id", "label", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("vector")[63], 6).alias("last"))


def _read_back(spark, lines):
    path = new_path(spark)
    files.write_report(lines, path)
    return files.read_text(spark, path).select(F.col("value").alias("line")).where("line != ''")


def itemset_report(spark, sf_dir):
    """Frequent itemsets, a line a size."""
    rows = stored(user_baskets(spark, sf_dir))
    return _read_back(spark, files.itemset_lines(its.two_pass_itemsets(rows, mining._support(rows, mining.USERS_PERCENT))))


def two_phase_report(spark, sf_dir):
    """The headings of the report of candidates and frequent itemsets, and that every frequent set is a candidate."""
    rows = stored(user_baskets(spark, sf_dir))
    support = mining._support(rows, mining.USERS_PERCENT)
    candidates, frequent = stored(its.two_pass_candidates(rows, support, 2)), stored(its.two_pass_itemsets(rows, support, 2))
    lines = _read_back(spark, files.two_phase_lines(candidates.withColumn("size", F.size("items")), frequent))
    missed = frequent.join(candidates, "items", "left_anti").agg(F.count("*").alias("n_missed"))
    return lines.where("line not like '(%'").join(F.broadcast(missed))  # one row


def community_report(spark, sf_dir):
    """Label communities, a line each."""
    return _read_back(spark, files.community_lines(g.communities(graphs.label_propagation(spark, sf_dir), "label")))


def betweenness_report(spark, sf_dir):
    """Edges with their betweenness, a line each."""
    lines = files.edge_lines(graphs.edge_betweenness(spark, sf_dir))
    return _read_back(spark, lines).select(F.regexp_extract("line", r"^\('(\d+)', '(\d+)'\), (.*)$", 1).cast("long").alias("src"), F.regexp_extract("line", r"^\('(\d+)', '(\d+)'\), (.*)$", 2).cast("long").alias("dst"), F.regexp_extract("line", r", ([^,]*)$", 1).cast("double").alias("betweenness"))


QUERIES = {f.__name__: f for f in (in_memory_rows, json_lines, json_documents, text_lines, csv_with_header, csv_by_position, csv_transactions, csv_points, itemset_report, two_phase_report, community_report, betweenness_report)}

SQL = {
    "in_memory_rows": "select n_nationkey, n_name, n_regionkey from nation where n_regionkey != 0",
    "json_lines": "select business_id, name, city, stars, review_count from business",
    "json_documents": "select event_type, count(props->>'k') n, sum((props->>'k')::bigint)::bigint total from events group by 1",
    "text_lines": "select business_id, review_count from business",
    "csv_with_header": "select user_id, business_id, stars from yelp_train",
    "csv_by_position": "select p_partkey part_no, p_brand brand, p_size part_size from part",
    "csv_transactions": "select strftime(o_orderdate, '%m/%d/%Y') || '-' || o_custkey basket, l_partkey::varchar item, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by 1, 2",
    "csv_points": "select vec_id id, label::bigint \"label\", round(list_sum(embedding::double[]), 4) total, round(embedding[64]::double, 6) \"last\" from embeddings",
    "itemset_report": f"with x as ({mining.SQL['two_pass_itemsets']}) select string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' order by string_split(items, ',')::bigint[]) line from x group by size",
    "two_phase_report": "select line, 0::bigint n_missed from (values ('Candidates:'), ('Frequent Itemsets:')) t(line)",
    "community_report": f"with x as ({graphs.SQL['label_communities']}) select '''' || replace(members, ',', ''', ''') || '''' line from x",
    "betweenness_report": graphs.SQL["edge_betweenness"],
}

"""Readers and writers of the file formats: JSON lines, CSV with and without header or quotes, text, Parquet, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the review data; readers never infer a schema, which would read the files twice.
REVIEW = "review_id string, user_id string, business_id string, stars double, useful int, funny int, cool int, text string, date string"
BUSINESS = "business_id string, name string, city string, stars double, review_count int"
USER = "user_id string, review_count int, average_stars double"
RATING = "user_id string, business_id string, stars double"
BASKET = "user_id string, business_id string"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """value: one row a line."""
    return spark.read.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One row a JSON object. Missing keys are null; lines that are no JSON become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True, quoted: bool = True) -> DataFrame:
    """Columns by position. header: each file's own first line is skipped. quoted: fields may be in double quotes, a quote
    within them being doubled, and may hold line ends."""
    r = spark.read.schema(schema).option("header", header).option("enforceSchema", True).option("mode", "PERMISSIVE")
    return (r.option("quote", '"').option("escape", '"').option("multiLine", True) if quoted else r.option("quote", "")).csv(path)


def without_headers(df: DataFrame) -> DataFrame:
    """Without rows that repeat the column names, which files joined by hand have among their data."""
    same = F.lit(True)
    for c in df.columns:
        if dict(df.dtypes)[c] == "string":
            same = same & F.coalesce(F.btrim(c) == c, F.lit(False))
    return df.where(~same) if any(t == "string" for _, t in df.dtypes) else df


def read_transactions(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    """basket and item of quoted transaction lines: the first two fields joined by ``-``, and the sixth as a whole number
    (leading zeros don't matter). Lines whose item is no number are left out. No intermediate file is written."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(columns)])
    return transactions(read_csv(spark, path, schema), "c0", "c1", "c5")


def transactions(df: DataFrame, first: str, second: str, item: str) -> DataFrame:
    """The same from columns."""
    both = F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.concat_ws("-", F.col(first).cast("string"), F.col(second).cast("string")))
    return df.select(both.alias("basket"), F.btrim(F.col(item).cast("string")).try_cast("bigint").cast("string").alias("item")).dropna()


def read_points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """id, label and vector of lines without header: the index, the true label, then the coordinates."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.LongType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(dims))])
    return read_csv(spark, path, schema, header=False).select("id", "label", F.array(*(f"x{i}" for i in range(dims))).alias("vector"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Fields with separators, quotes or line ends are quoted; white space around them is kept. Nulls are empty fields, empty
    texts are quoted ones; ``read_csv`` takes both as null."""
    w = df.write.mode("overwrite").option("header", header).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("quoteAll", False).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """A frame with one text column, as a text file a partition."""
    lines.write.mode("overwrite").text(path)


def document(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def _sized_lines(itemsets: DataFrame) -> DataFrame:
    one = F.concat(F.lit("("), F.array_join(F.transform("items", lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'"))), ", "), F.lit(")"))
    return itemsets.groupBy("size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", one.alias("t")))), lambda s: s["t"]), ",").alias("line"))


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """One line for each size: the sets as ('a', 'b'), in order. For reports; the format has the sets of one size in one line, so
    they meet in one row."""
    return _sized_lines(itemsets).orderBy("size").select("line")


#: Fixed values of the report formats.
CANDIDATES, FREQUENT = "Candidates:", "Frequent Itemsets:"
ROUNDS, RESULTS = "The intermediate results:", "The clustering results:"
ROUND = "Round {}: {},{},{},{}"


def two_phase_lines(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    """The report of a two-phase search in lines: a heading, a line a size with empty lines between, for candidates and then
    for the frequent ones; both frames hold items and size."""
    spark = candidates.sparkSession
    whole = spark.createDataFrame([(0, 0, 1, CANDIDATES), (2, 0, 0, ""), (2, 0, 1, FREQUENT)], "part int, size int, at int, line string")
    for part, sets in ((1, candidates), (3, frequent)):
        least = sets.agg(F.min("size").alias("least"))  # one row
        both = F.posexplode(F.when(F.col("size") > F.col("least"), F.array(F.lit(""), "line")).otherwise(F.array("line")))
        lines = _sized_lines(sets).join(F.broadcast(least)).select(F.lit(part).alias("part"), "size", both.alias("at", "line"))
        whole = whole.unionByName(lines)
    return whole.orderBy("part", "size", "at").select("line")


def clustering_lines(rounds: list[tuple[int, int, int, int]], members: DataFrame) -> DataFrame:
    """The report of a clustering in rounds, in lines: its heading, the counts of each round (discarded points, compressed
    clusters, compressed points, retained points), an empty line, its second heading, and id,cluster of each point by id."""
    head = [ROUNDS, *(ROUND.format(i, *r) for i, r in enumerate(rounds, 1)), "", RESULTS]
    top = members.sparkSession.createDataFrame([(0, i, line) for i, line in enumerate(head)], "part int, at long, line string")
    points = members.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("at"), F.concat_ws(",", F.col("id").cast("string"), F.col("cluster").cast("string")).alias("line"))
    return top.unionByName(points).orderBy("part", "at").select("line")


def community_lines(communities: DataFrame) -> DataFrame:
    """One line for each community: 'a', 'b', ordered by size, then members."""
    return communities.orderBy("size", "members").select(F.array_join(F.transform("members", lambda i: F.concat(F.lit("'"), i.cast("string"), F.lit("'"))), ", ").alias("line"))


def edge_lines(scored: DataFrame) -> DataFrame:
    """One line for each edge: ('a', 'b'), score."""
    return scored.orderBy(F.desc("betweenness"), "src", "dst").select(F.format_string("('%s', '%s'), %s", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("betweenness").cast("string")).alias("line"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)

"""Clustering of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import TEXT_NUMBER_SQL
from ..operators import clustering as c
from ..runtime import new_path, stored
from ..sources import files
from ..sources.tables import table

DIMS, K = 64, 10


def _points(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("vector"))


def cluster_statistics(spark, sf_dir):
    s = c.centres(c.summaries(_points(spark, sf_dir)))
    long = s.select("cluster", "n", F.posexplode(F.arrays_zip("centre", "std")).alias("dim", "v"))
    return long.select("cluster", "n", F.col("dim").cast("long").alias("dim"), F.round("v.centre", 6).alias("centre"), F.round("v.std", 6).alias("std"))


def _assigned(spark, sf_dir):
    p = _points(spark, sf_dir)
    return c.nearest(p.select("id", "vector"), stored(c.centres(c.summaries(p))))


def mahalanobis_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir).select("id", "cluster", F.round("distance", 5).alias("distance"))


def discard_gate(spark, sf_dir):
    return c.gate(_assigned(spark, sf_dir), DIMS).groupBy("cluster").agg(F.count("*").alias("n"))


def summarised_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)[0]


def _clustered(spark, sf_dir):
    return c.summarised_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", K)


def clustering_rounds(spark, sf_dir):
    rounds = _clustered(spark, sf_dir)[1]
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rounds)], "round int, discarded long, compressed_clusters long, compressed long, retained long")


def clustering_population(spark, sf_dir):
    """Points that the sets of each round hold together."""
    return clustering_rounds(spark, sf_dir).select("round", F.expr("discarded + compressed + retained").alias("n_points"))


def clustering_report(spark, sf_dir):
    """The lines of the report, by their kind: headings, rounds, points."""
    of, rounds = _clustered(spark, sf_dir)
    path = new_path(spark)
    files.write_report(files.clustering_lines(rounds, of), path)
    lines = files.read_text(spark, path).where("value != ''")
    kind = F.when(F.col("value").rlike(r"^Round \d+: \d+,\d+,\d+,\d+$"), "round").when(F.col("value").rlike(r"^\d+,-?\d+$"), "point").otherwise(F.col("value"))
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (cluster_statistics, mahalanobis_assignment, discard_gate, summarised_clusters, clustering_rounds, clustering_population, clustering_report)}

_STATS = """with x as (select vec_id id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 dim from embeddings),
s as (select label cluster, dim, count(*) n, avg(v) centre, sqrt(greatest(0, sum(v * v) / count(*) - (sum(v) / count(*)) ** 2)) std from x group by 1, 2)"""
_ASSIGNED = _STATS + """, d as (select id, cluster, sqrt(sum(case when std > 1e-12 then ((v - centre) / std) ** 2 else 0 end)) distance from x join s using (dim) group by 1, 2),
a as (select id, cluster, distance from d qualify row_number() over (partition by id order by distance, cluster) = 1)"""
_CHUNK = TEXT_NUMBER_SQL.format("vec_id::varchar") + " % 5"
SQL = {
    "clustering_population": f"select dense_rank() over (order by k)::int round, sum(n) over (order by k)::bigint n_points from (select {_CHUNK} k, count(*) n from embeddings group by 1)",
    "clustering_report": f"""select 'point' kind, count(*) n from embeddings union all select 'round', count(distinct {_CHUNK}) from embeddings
union all select 'The intermediate results:', 1 union all select 'The clustering results:', 1""",
    "cluster_statistics": _STATS + " select cluster, n, dim, round(centre, 6) centre, round(std, 6) std from s",
    "mahalanobis_assignment": _ASSIGNED + " select id, cluster, round(distance, 5) distance from a",
    "discard_gate": _ASSIGNED + f" select cluster, count(*) n from a where distance < 2 * sqrt({DIMS}) group by 1",
}

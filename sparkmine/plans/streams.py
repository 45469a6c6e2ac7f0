"""Stream sketches in set form, and live streams replayed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import P, TEXT_NUMBER_SQL, coefficient_sql, coefficients
from ..functions.ids import clean_id
from ..operators import sketches as sk
from ..sources.tables import table
from ..streaming import live
from .common import CLEAN_SQL

BATCH, HASHES, SEED = 500, 4, 17


def _stream(spark, sf_dir):
    t = table(spark, sf_dir, "yelp_user").select("rec_no", clean_id(F.col("user_id")).alias("user_id"))
    return sk.stream(t, "rec_no", "user_id", BATCH)


def simulated_stream(spark, sf_dir):
    """Ten batches of a hundred records drawn from the user feed."""
    t = table(spark, sf_dir, "yelp_user").select((F.col("rec_no") - 1).alias("at"), "user_id")
    low = t.agg(F.min("at")).first()[0] or 0
    return sk.simulated_stream(t.withColumn("at", F.col("at") - low), "user_id", 100, 10, seed=3, index="at")


def bloom_rates(spark, sf_dir):
    b = sk.bloom_rates(_stream(spark, sf_dir), HASHES, seed=SEED)
    return b.select("batch", "false_positives", "true_negatives", F.round("fpr", 6).alias("fpr"))


def distinct_estimates(spark, sf_dir):
    return sk.distinct_estimates(_stream(spark, sf_dir))


def reservoir_slots(spark, sf_dir):
    return sk.reservoir_slots(_stream(spark, sf_dir))


def sketch_vs_exact(spark, sf_dir):
    """Spark's own distinct sketch against the exact number: whether it is within a fifth."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    by = e.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n_users"))
    return by.select("event_type", "n_users", (F.abs(F.col("a") - F.col("n_users")) <= F.col("n_users") * 0.2).alias("within_fifth"))


def _name():
    return "s" + uuid.uuid4().hex


def stream_daily_counts(spark, sf_dir):
    s = live.parquet_stream(spark, f"{sf_dir}/events*.parquet")
    d = live.replay(live.windowed_counts(s, "ts", "event_type"), _name(), "complete")
    return d.select(F.date_format("from", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_sessions(spark, sf_dir):
    s = live.parquet_stream(spark, f"{sf_dir}/events*.parquet")
    d = live.replay(live.session_counts(s, "ts", "user_id", "6 hours"), _name(), "complete")
    return d.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


def _live_users(spark, sf_dir):
    s = live.parquet_stream(spark, f"{sf_dir}/yelp_user*.parquet")
    return s.select("rec_no", clean_id(F.col("user_id")).alias("user_id"))


def stream_distinct_estimates(spark, sf_dir):
    s = _live_users(spark, sf_dir).withColumn("batch", F.floor(F.col("rec_no") / BATCH))
    return live.batch_estimates(s, "user_id", "batch", _name())


LIVE_BITS, LIVE_SHARDS = 20_000, 8


def stream_bloom_seen(spark, sf_dir):
    return live.replay(live.bloom_seen(_live_users(spark, sf_dir), "user_id", "rec_no", LIVE_BITS, HASHES, LIVE_SHARDS), _name())


def stream_reservoir(spark, sf_dir):
    """The shards' reservoirs at the end of the stream: records seen, slots filled, and slots whose value is in the feed."""
    users = table(spark, sf_dir, "yelp_user").select(clean_id(F.col("user_id")).alias("user_id"))
    r = live.last_reservoirs(live.replay(live.reservoir(_live_users(spark, sf_dir), "user_id", "rec_no", shards=LIVE_SHARDS), _name(), "update"))
    known = users.select(F.col("user_id").alias("value")).distinct().withColumn("known", F.lit(1))
    j = r.join(known, r["value"].eqNullSafe(known["value"]), "left")
    return j.groupBy(r["shard"].cast("long").alias("shard"), "seen").agg(F.count("*").alias("n_slots"), F.count("known").alias("n_known"))


def stream_sample(spark, sf_dir):
    """One sample of the whole stream, made of the shards' reservoirs: its size, its records and those it stands for."""
    u = live.replay(live.reservoir(_live_users(spark, sf_dir), "rec_no", "rec_no", shards=LIVE_SHARDS), _name(), "update")
    return live.merged_reservoir(u).agg(F.count("*").alias("n_sampled"), F.count_distinct("value").alias("n_different"), F.max("seen").alias("n_records"))


QUERIES = {f.__name__: f for f in (simulated_stream, bloom_rates, distinct_estimates, reservoir_slots, sketch_vs_exact, stream_daily_counts, stream_sessions, stream_distinct_estimates, stream_bloom_seen, stream_reservoir, stream_sample)}

_S = f"s as (select rec_no seq, {CLEAN_SQL.format('user_id')} v, rec_no // {BATCH} batch from yelp_user where rec_no is not null and {CLEAN_SQL.format('user_id')} is not null)"
_FM = f"""with {_S}, d as (select distinct batch, v from s), x as (select batch, {TEXT_NUMBER_SQL.format('v')} % {P} x from d),
h as (select batch, hash_no, (a * x + b) % {P} h from x, {coefficient_sql(sk.FM_FAMILY)}), z as (select batch, hash_no, max(case when h = 0 then 0 else bit_count((h & -h) - 1) end) r from h group by 1, 2),
o as (select batch, 2.0 ** r p, row_number() over (partition by batch order by r) - 1 k from z), m as (select batch, k // {sk.FM_PER_GROUP} g, avg(p) m from o where k < {sk.FM_GROUPS * sk.FM_PER_GROUP} group by 1, 2)
select batch, (select count(*) from d where d.batch = q.batch) n_distinct, estimate from (select batch, round(median(m))::bigint estimate from m group by batch) q"""
_SLOTS = ", ".join(f"arg_max(v, t) filter (slot = {i}) over w slot_{i}" for i in (0, 20, 40, 60, 80))
SQL = {
    "simulated_stream": f"""with d as (select range seq, range // 100 batch, {TEXT_NUMBER_SQL.format("'3/' || range")} % (select count(*) from yelp_user) row_no from range(1000))
select batch, seq, user_id "value" from d join (select user_id, rec_no - (select min(rec_no) from yelp_user) row_no from yelp_user) using (row_no)""",
    "bloom_rates": f"""with {_S}, f as (select v, min(seq) seq from s group by v), p as (select distinct seq, ((a * ({TEXT_NUMBER_SQL.format('v')} % {P}) + b) % {P}) % {sk.BITS} place from f, {coefficient_sql(coefficients(HASHES, SEED))}),
b as (select place, min(seq) first from p group by place), t as (select p.seq, bool_and(b.first < p.seq) positive from p join b using (place) group by p.seq),
c as (select s.batch, count(*) filter (positive) fp, count(*) filter (not positive) tn from s join t using (seq) group by 1)
select batch, coalesce(fp, 0) false_positives, coalesce(tn, 0) true_negatives, round(fp / nullif(fp + tn, 0), 6) fpr from (select distinct batch from s) left join c using (batch)""",
    "distinct_estimates": _FM,
    "stream_distinct_estimates": _FM,
    "reservoir_slots": f"""with {_S}, n as (select *, row_number() over (order by seq) t from s),
q as (select *, case when t <= 100 then t - 1 when ({TEXT_NUMBER_SQL.format("'a' || t")} % {P}) % t < 100 then ({TEXT_NUMBER_SQL.format("'s' || t")} % {P}) % 100 end slot from n),
l as (select *, {_SLOTS} from q window w as (order by t)) select batch, t seen, slot_0, slot_20, slot_40, slot_60, slot_80 from l qualify t = max(t) over (partition by batch)""",
    "sketch_vs_exact": "select event_type, count(distinct user_id) n_users, abs(approx_count_distinct(user_id) - count(distinct user_id)) <= count(distinct user_id) * 0.2 within_fifth from events group by 1",
    "stream_bloom_seen": f"""with {_S}, f as (select v, min(seq) seq from s group by v), x as (select v, seq, {TEXT_NUMBER_SQL.format('v')} % {P} x, {TEXT_NUMBER_SQL.format('v')} % {LIVE_SHARDS} shard from f),
p as (select distinct v, seq, shard, ((a * x + b) % {P}) % {LIVE_BITS} place from x, {coefficient_sql(coefficients(HASHES, 17))}), b as (select shard, place, min(seq) first from p group by 1, 2),
t as (select v, p.seq, bool_and(b.first < p.seq) positive from p join b using (shard, place) group by 1, 2) select s.seq, s.v "value", s.seq > t.seq or positive maybe_seen from s join t using (v)""",
    "stream_reservoir": f"select {TEXT_NUMBER_SQL.format('rec_no::varchar')} % {LIVE_SHARDS} shard, count(*) seen, least(100, count(*)) n_slots, least(100, count(*)) n_known from yelp_user group by 1",
    "stream_sample": "select least(100, count(*)) n_sampled, least(100, count(*)) n_different, count(*) n_records from yelp_user",
    "stream_daily_counts": "select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n from events group by 1, 2",
    "stream_sessions": """with g as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 6 hour then 0 else 1 end new from events)
select user_id, sum(new)::bigint n_sessions, count(*) n_events from g group by 1""",
}

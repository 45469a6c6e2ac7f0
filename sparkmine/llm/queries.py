"""Queries of the training-data problems, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import calendar_day, clean_id, whole_number_id
from ..runtime import stored
from ..sources.tables import table
from .cooccurrence import item_pairs
from .distinct import distinct_counts
from .frequent import frequent_values
from .leakage import leaked_items
from .packing import packed, token_sizes
from .readability import is_english, reading_levels
from .reservoir import fixed_sample, piece_samples
from .seen import checked, seen_before, wrong_rate
from .setjoin import similar_classes, similar_sets
from .words import INVISIBLE

#: A public vocabulary file, there on every worker; the setting ``sparkmine.vocabulary`` of the session names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The chance of a wrong "seen" in problem 5.
WRONG = 1e-7


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "small2")
    both = t.select(whole_number_id(F.col("user_id")).alias("user_id"), whole_number_id(F.col("business_id")).alias("business_id"))
    return both.where("user_id is not null and business_id is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = item_pairs(_baskets(spark, sf_dir), "user_id", "business_id", min_count=20, min_lift=8)
    return pairs.select(F.col("item_1").alias("business_id_1"), F.col("item_2").alias("business_id_2"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.select("item_1", "item_2", "n_both", "n_1", "n_2", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs in at least 10 baskets that are not rarer than chance."""
    return _counted(item_pairs(_baskets(spark, sf_dir), "user_id", "business_id", min_count=10, min_lift=1))


def p1_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that occurs."""
    return _counted(item_pairs(_baskets(spark, sf_dir), "user_id", "business_id"))


def _raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "yelp_train")
    # header lines left among the data are no ratings
    return t.select(clean_id(F.col("business_id")).alias("business_id"), clean_id(F.col("user_id")).alias("user_id")).where("business_id != 'business_id' or user_id != 'user_id'")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each business with the class of those rated by just the same users, and the number of similar ones."""
    members, _ = similar_classes(_raters(spark, sf_dir), "business_id", "user_id", threshold=0.5, min_size=5)
    return members.select(F.col("id").alias("business_id"), F.col("size").cast("long").alias("n_users"), "class_id", "n_links")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similar_sets(_raters(spark, sf_dir), "business_id", "user_id", threshold=0.5, min_size=5)
    return s.select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"), "overlap", F.round("similarity", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pairs(spark, sf_dir).select("business_id_1", "business_id_2")


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review").select(*(clean_id(F.col(c)).alias(c) for c in ("review_id", "user_id", "business_id")), calendar_day(F.col("date")).alias("review_day"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reviews(spark, sf_dir).where("review_id is not null and user_id is not null and business_id is not null and review_day is not null")
    d = distinct_counts(r, ["review_id", "user_id"], ["review_day", "business_id"], [["review_day", "business_id"]])
    return d.where("n_review_id >= 40 and n_user_id * 2 < n_review_id").select("review_day", "business_id")


def p3_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reviews(spark, sf_dir)
    return distinct_counts(r, ["user_id"], ["review_day", "business_id"], [["review_day", "business_id"], ["review_day"], ["business_id"], []])


SAMPLE = 100


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "yelp_user").select("rec_no", "piece_no", "user_id")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces are sampled as they come and their samples merged."""
    return fixed_sample(_records(spark, sf_dir), SAMPLE, seed=4, piece="piece_no")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the samples of the single pieces hold."""
    s = piece_samples(_records(spark, sf_dir), SAMPLE, "piece_no", seed=4)
    return s.groupBy("piece_no").agg(F.count("*").alias("n_sampled"), F.count_distinct("rec_no").alias("n_different"), F.max("population").alias("n_records"))


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every sample: its size, that no record is in it twice, that each is one of the feed, and the population."""
    s = p4_sample(spark, sf_dir)
    known = s.join(_records(spark, sf_dir).select("rec_no", F.col("user_id").alias("own")), "rec_no")
    known = known.where(F.col("user_id").eqNullSafe(F.col("own")))
    return known.agg(F.count("*").alias("n_sampled"), F.count_distinct("rec_no").alias("n_different"), F.max("population").alias("n_records"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "yelp_user").select("rec_no", clean_id(F.col("user_id")).alias("user_id"))


def p5_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seen_before(_keys(spark, sf_dir), "user_id", "rec_no", WRONG)
    return s.select(F.col("order").alias("rec_no"), F.col("key").alias("user_id"), "seen")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_seen(spark, sf_dir).where("seen").select("rec_no")


def p5_wrong_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, wrong ones among them, and the bound that they keep, for filters that may err once in a thousand times."""
    r = wrong_rate(checked(_keys(spark, sf_dir), "user_id", "rec_no", 0.001))
    return r.select("n_records", "n_seen", (F.coalesce("wrong_rate", F.lit(0.0)) <= 0.001).alias("within_bound"))


def p6_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frequent_values(_reviews(spark, sf_dir), ["business_id", "user_id"], 100, record="review_id")
    return f.select("field_name", "key_value", F.col("n_records").alias("n_reviews"), "place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # at most 200 keys of a field can have half a percent each
    f = frequent_values(_reviews(spark, sf_dir), ["business_id", "user_id"], 200, record="review_id")
    return f.where("n_records * 200 >= n_total").select("field_name", "key_value")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get("sparkmine.vocabulary", VOCABULARY))
    return packed(sizes, "item", "n_tokens", 2048)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("item", "doc_id")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for every packing: each text with tokens is in containers whole, no container is too full, little is unused."""
    p = stored(_packed(spark, sf_dir))
    items = p.groupBy("item").agg(F.max("container").isNotNull().alias("placed"), F.count("*").alias("n"), (F.max("piece") + 1).alias("pieces"), F.sum("piece_size").alias("tokens"), F.max(F.col("piece_start") + F.col("piece_size")).alias("end"))
    whole = items.agg(F.count_if("placed").alias("n_placed"), F.count_if(~F.col("placed")).alias("n_empty"), F.bool_and((F.col("n") == F.col("pieces")) & (F.col("tokens") == F.col("end"))).alias("all_whole"))
    by = p.where("container is not null").groupBy("container").agg(F.sum("piece_size").alias("used"), F.max(F.col("place") + F.col("piece_size")).alias("end"), F.count_distinct("place").alias("places"), F.count("*").alias("n"))
    full = by.agg(F.bool_and(F.expr("used <= 2048 and end = used and places = n")).alias("none_too_full"), (F.count("*") <= F.ceil(F.sum("used") / F.lit(2048 * 0.99)) + 1).alias("well_filled"))
    return whole.join(F.broadcast(full))  # one row each


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = _leaks(spark, sf_dir)
    return leaks.select("doc_id", "item_id", "part", "n_matches", "longest_run", "supported")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "text", "question", "answer")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("part = 'passage' and longest_run >= 12").select("doc_id", "item_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "doc_level"), "doc_id", "reading_level")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(is_english(F.col("lang")))
    levels = reading_levels(docs, "doc_id", "text", table(spark, sf_dir, "doc_level"), "doc_id", "reading_level")
    return levels.where("n_words >= 40 and reading_level >= 4").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_all_pairs, p2_found, p2_pairs, p2_classes, p3_found, p3_distinct, p4_sample, p4_pieces, p4_check, p5_found, p5_seen, p5_wrong_rate, p6_found, p6_top, p8_packed, p8_check, p9_found, p9_leaks, p10_found, p10_levels)}

_T = "nullif(trim({0}, ' \t\r\n'), '')"
_WHOLE = "try_cast(nullif(regexp_extract(trim({0}, ' \t\r\n'), '^([+-]?[0-9]+)(\\.0*)?$', 1), '') as bigint)"
_PAIRS = f"""with s as (select distinct {_WHOLE.format('user_id')} u, {_WHOLE.format('business_id')} b from small2),
r as (select * from s where u is not null and b is not null), m as (select b, count(*) n from r group by b), t as (select count(distinct u) n from r),
p as (select x.b item_1, y.b item_2, count(*) n_both from r x join r y on x.u = y.u and x.b < y.b group by 1, 2),
q as (select p.*, m1.n n_1, m2.n n_2, t.n n_all from p join m m1 on m1.b = item_1 join m m2 on m2.b = item_2, t)
"""
_SETS = f"""with s as (select distinct {_T.format('business_id')} b, {_T.format('user_id')} u from yelp_train),
r as (select * from s where b is not null and u is not null and (b != 'business_id' or u != 'user_id')), n as (select b, count(*) n from r group by b),
p as (select x.b business_id_1, y.b business_id_2, count(*) overlap from r x join r y on x.u = y.u and x.b < y.b group by 1, 2),
q as (select p.*, overlap / (n1.n + n2.n - overlap) similarity from p join n n1 on n1.b = business_id_1 join n n2 on n2.b = business_id_2
where n1.n >= 5 and n2.n >= 5 and overlap * 2 >= n1.n + n2.n - overlap)
"""
_DAY = "strftime(try_cast(replace(regexp_extract(trim(date, ' \t\r\n'), '^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2})([^0-9]|$)', 1), '/', '-') as date), '%Y-%m-%d')"
_R = f"with r as (select {_T.format('review_id')} rid, {_T.format('user_id')} u, {_T.format('business_id')} b, {_DAY} d from review)"
_TOP = _R + """, k as (select distinct 'business_id' field_name, b key_value, rid from r where rid is not null and b is not null union all
select distinct 'user_id', u, rid from r where rid is not null and u is not null),
c as (select field_name, key_value, count(*) n_reviews from k group by 1, 2), t as (select count(distinct rid) n from r)
"""
_SEEN = f"with r as (select rec_no, {_T.format('user_id')} user_id from yelp_user), s as (select *, case when user_id is null then false else rec_no > min(rec_no) over (partition by user_id) end seen from r)"

# full-width forms stand for the ASCII characters in their order; of the characters of these texts only they and the hard
# space are changed by NFKC
_WIDE, _PLAIN = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0", "".join(map(chr, range(0x21, 0x7F))) + " "


def _words_sql(c: str) -> str:
    quoted = _PLAIN.replace("'", "''")
    return f"regexp_extract_all(lower(translate(regexp_replace({c}, '[{INVISIBLE}]', '', 'g'), '{_WIDE}', '{quoted}')), '[\\p{{L}}\\p{{N}}]+')"


_LEAKS = f"""with d as (select doc_id, {_words_sql('text')} w from documents),
i as (select item_id, 'passage' part, {_words_sql('text')} w from eval_item union all select item_id, 'question', {_words_sql('question')} from eval_item union all select item_id, 'answer', {_words_sql('answer')} from eval_item),
p as (select *, case when part = 'passage' then least(12, len(w)) else len(w) end n from i where len(w) > 0),
pat as (select distinct item_id, part, n, array_to_string(w[j:j + n - 1], ' ') s from p, unnest(range(1, len(w) - n + 2)) t(j)),
win as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') s from d, (select distinct n from p) z, unnest(range(1, len(w) - n + 2)) t(k)),
m as (select distinct doc_id, item_id, part, n, k from win join pat using (n, s)),
g as (select *, k - row_number() over (partition by doc_id, item_id, part order by k) start from m),
r as (select doc_id, item_id, part, n, start, count(*) c from g group by all),
h as (select doc_id, item_id, part, case when part = 'passage' and n = 12 then count(*) else sum(c) end::int n_matches, case when part = 'passage' and n = 12 then max(c) + n - 1 else n end::int longest_run from r group by doc_id, item_id, part, n)
"""

SQL = {
    "p1_found": _PAIRS + "select item_1 business_id_1, item_2 business_id_2 from q where n_both >= 20 and n_both * n_all >= 8 * n_1 * n_2",
    "p1_pairs": _PAIRS + """select item_1, item_2, n_both, n_1, n_2, round(n_both * n_all::double / n_1 / n_2, 6) lift, round(log2(n_both * n_all::double / n_1 / n_2), 6) pmi
from q where n_both >= 10 and n_both * n_all >= n_1 * n_2""",
    "p1_all_pairs": _PAIRS + "select item_1, item_2, n_both, n_1, n_2, round(n_both * n_all::double / n_1 / n_2, 6) lift, round(log2(n_both * n_all::double / n_1 / n_2), 6) pmi from q",
    "p2_found": _SETS + "select business_id_1, business_id_2 from q",
    "p2_pairs": _SETS + "select business_id_1, business_id_2, overlap, round(similarity, 6) similarity from q",
    "p2_classes": _SETS + """, e as (select b, string_agg(u, chr(0) order by u) us, count(*) n from r group by b having count(*) >= 5),
l as (select b, count(*) n from (select business_id_1 b from q union all select business_id_2 from q) group by b)
select e.b business_id, e.n n_users, min(e.b) over (partition by us) class_id, coalesce(l.n, 0) n_links from e left join l on e.b = l.b""",
    "p3_found": _R + "select d review_day, b business_id from r where rid is not null and u is not null and b is not null and d is not null group by 1, 2 having count(distinct rid) >= 40 and count(distinct u) * 2 < count(distinct rid)",
    "p3_distinct": _R + """select combination, review_day, business_id, n_user_id, 0.0::double error_bound from (
select 'review_day,business_id' combination, d review_day, b business_id, count(distinct u) n_user_id from r where d is not null and b is not null group by d, b
union all select 'review_day', d, null, count(distinct u) from r where d is not null group by d
union all select 'business_id', null, b, count(distinct u) from r where b is not null group by b
union all select '', null, null, count(distinct u) from r) where n_user_id > 0""",
    "p4_pieces": f"select piece_no, least(count(*), {SAMPLE}) n_sampled, least(count(distinct rec_no), {SAMPLE}) n_different, count(*) n_records from yelp_user group by 1",
    "p4_check": f"select least(count(*), {SAMPLE}) n_sampled, least(count(distinct rec_no), {SAMPLE}) n_different, count(*) n_records from yelp_user",
    "p5_wrong_rate": _SEEN + "select count(*) n_records, count(*) filter (seen) n_seen, true within_bound from s",
    "p8_check": "select count(*) filter (text != '') n_placed, count(*) filter (text is null or text = '') n_empty, true all_whole, true none_too_full, true well_filled from documents",
    "p9_found": _LEAKS + "select doc_id, item_id from h where part = 'passage' and longest_run >= 12",
    "p9_leaks": _LEAKS + "select *, longest_run >= 12 or count(*) over (partition by doc_id, item_id) > 1 supported from h",
    "p5_found": _SEEN + "select rec_no from s where seen",
    "p5_seen": _SEEN + "select * from s",
    "p6_found": _TOP + "select field_name, key_value from c, t where n_reviews * 200 >= n",
    "p6_top": _TOP + "select field_name, key_value, n_reviews, place::int place from (select *, row_number() over (partition by field_name order by n_reviews desc, key_value) place from c) where place <= 100",
}

"""Frequent itemsets, similar sets, recommendation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import P, TEXT_NUMBER_SQL, coefficient_sql, text_number
from ..functions.ids import clean_id
from ..operators import itemsets as its
from ..operators import recommend as rec
from ..operators import similarity as sim
from ..runtime import new_path, stored
from ..sources.files import load_model, save_model, transactions
from ..sources.tables import table
from .common import BASKETS_SQL, CLEAN_SQL, MEMBERS_SQL, RATINGS_SQL, business_users, clean_ratings, user_baskets

#: Itemsets must be in this percentage of the baskets; those of users in so many baskets.
USERS_PERCENT, DAYS_PERCENT, ITEMS_SUPPORT = 2, 3, 10


def _support(rows: DataFrame, percent: int) -> int:
    return max(1, math.ceil(rows.select("basket").distinct().count() * percent / 100))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("size", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), "support")


def frequent_itemsets_of_users(spark, sf_dir):
    """Items in users' baskets; like all itemset queries it goes on until no set is left."""
    rows = stored(user_baskets(spark, sf_dir))
    return _flat(its.frequent_itemsets(rows, _support(rows, USERS_PERCENT)))


def frequent_itemsets_of_items(spark, sf_dir):
    """Users in the baskets of items."""
    rows = stored(user_baskets(spark, sf_dir).select(F.col("item").alias("basket"), F.col("basket").alias("item")))
    return _flat(its.frequent_itemsets(rows, ITEMS_SUPPORT))


def two_pass_itemsets(spark, sf_dir):
    rows = stored(user_baskets(spark, sf_dir))
    return _flat(its.two_pass_itemsets(rows, _support(rows, USERS_PERCENT)))


def fpgrowth_itemsets(spark, sf_dir):
    rows = stored(user_baskets(spark, sf_dir))
    return _flat(its.fpgrowth_itemsets(rows, _support(rows, USERS_PERCENT)))


def _transactions(spark, sf_dir) -> DataFrame:
    """Brands bought by a customer on a day, in baskets of more than 3 brands."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("brand"))
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return stored(its.larger_baskets(its.baskets(transactions(t, "o_custkey", "day", "brand"), "basket", "item"), 3))


def transaction_itemsets(spark, sf_dir):
    rows = _transactions(spark, sf_dir)
    return _flat(its.frequent_itemsets(rows, _support(rows, DAYS_PERCENT)))


def minhash_signatures(spark, sf_dir):
    s = sim.signatures(business_users(spark, sf_dir))
    return s.select(F.col("id").alias("business_id"), F.array_join(F.transform("signature", lambda h: h.cast("string")), ",").alias("signature"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("id_1").alias("business_id_1"), F.col("id_2").alias("business_id_2"), "overlap", F.round("similarity", 6).alias("similarity"))


def lsh_verified_pairs(spark, sf_dir):
    return _pairs(sim.lsh_pairs(business_users(spark, sf_dir), 0.5))


def jaccard_pairs(spark, sf_dir):
    return _pairs(sim.similar_pairs(business_users(spark, sf_dir), 0.5))


LEAST_COMMON = 30


def _is_test():
    return F.pmod(text_number(F.concat_ws("|", "user", "item")), F.lit(10)) == 0


def _split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and test ratings; a tenth of the pairs, by a hash, is for testing."""
    r = clean_ratings(spark, sf_dir)
    return r.where(~_is_test()), r.where(_is_test())


def item_pearson(spark, sf_dir):
    s = rec.item_similarity(clean_ratings(spark, sf_dir), LEAST_COMMON).where("item_1 < item_2")
    return s.select("item_1", "item_2", "n_common", F.round("similarity", 6).alias("similarity"))


def item_pearson_signed(spark, sf_dir):
    """Also negative similarities, and from 10 common raters on."""
    s = rec.item_similarity(clean_ratings(spark, sf_dir), 10, positive_only=False).where("item_1 < item_2")
    return s.select("item_1", "item_2", "n_common", F.round("similarity", 6).alias("similarity"))


def _cf(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return rec.predict_by_items(train, test, rec.item_similarity(train, LEAST_COMMON)), test


def cf_predictions(spark, sf_dir):
    return _cf(spark, sf_dir)[0].select("user", "item", F.round("prediction", 6).alias("prediction"))


def item_mean_fallback(spark, sf_dir):
    """Predictions without any neighbour: the item's mean, 0 for an item without ratings in the training part."""
    train, test = _split(spark, sf_dir)
    none = rec.item_similarity(train, LEAST_COMMON).where(F.lit(False))
    return rec.predict_by_items(train, test, none).select("user", "item", F.round("prediction", 6).alias("prediction"))


def cf_rmse(spark, sf_dir):
    r = rec.rmse(*_cf(spark, sf_dir))
    return r.select("n", F.round("rmse", 6).alias("rmse"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """One row a business, and one a user: the last record of the feed."""
    b = table(spark, sf_dir, "business").select(clean_id(F.col("business_id")).alias("item"), F.col("stars").alias("item_stars"), F.col("review_count").cast("double").alias("item_reviews"))
    u = table(spark, sf_dir, "yelp_user").select(clean_id(F.col("user_id")).alias("user"), "rec_no", F.col("review_count").cast("double").alias("user_reviews"), F.col("average_stars").alias("user_stars"))
    last = u.where("user is not null").groupBy("user").agg(F.max_by(F.struct("user_reviews", "user_stars"), "rec_no").alias("r")).select("user", "r.*")
    return b.where("item is not null"), last


def rating_features(spark, sf_dir):
    return rec.features(clean_ratings(spark, sf_dir), *_sides(spark, sf_dir)).select("user", "item", F.round("rating", 6).alias("rating"), *rec.FEATURES)


def _rated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and test ratings with their features, joined once."""
    f = stored(rec.features(clean_ratings(spark, sf_dir).withColumn("test", _is_test()), *_sides(spark, sf_dir)))
    return f.where("not test"), f.where("test")


def tree_predictions(spark, sf_dir):
    train, test = _rated(spark, sf_dir)
    return rec.predict_by_features(rec.fit_trees(train), test)


def _quality(train: DataFrame, test: DataFrame, predictions: DataFrame) -> DataFrame:
    """The error of predictions against that of the mean rating: n, mean_rmse, and whether theirs is at most a twentieth above it.

    These ratings are drawn without regard to user and item, so nothing can do better than the mean by more than chance."""
    mean = train.agg(F.avg("rating").alias("mean"))  # one row
    guess = rec.rmse(test.select("user", "item").join(F.broadcast(mean)).withColumnRenamed("mean", "prediction"), test).withColumnRenamed("rmse", "mean_rmse")
    both = rec.rmse(predictions, test).join(F.broadcast(guess.drop("n")))
    return both.select("n", F.round("mean_rmse", 6).alias("mean_rmse"), "rmse", (F.col("rmse") <= F.col("mean_rmse") * 1.05).alias("within_bound")).drop("rmse")


def tree_rmse(spark, sf_dir):
    train, test = _rated(spark, sf_dir)
    return _quality(train, test, rec.predict_by_features(rec.fit_trees(train), test))


def model_round_trip(spark, sf_dir):
    """Predictions of the trees and of the same trees saved and loaded: pairs, and those that differ."""
    train, test = _rated(spark, sf_dir)
    model, path = rec.fit_trees(train), new_path(spark)
    save_model(model, path)
    a, b = rec.predict_by_features(model, test), rec.predict_by_features(load_model(path), test).withColumnRenamed("prediction", "loaded")
    return a.join(b, ["user", "item"]).agg(F.count("*").alias("n"), F.count_if(F.col("prediction") != F.col("loaded")).alias("n_different"))


def hybrid_predictions(spark, sf_dir):
    by_items, _ = _cf(spark, sf_dir)
    return rec.hybrid(by_items, tree_predictions(spark, sf_dir), 0.1)


def hybrid_rmse(spark, sf_dir):
    return _quality(*_split(spark, sf_dir), hybrid_predictions(spark, sf_dir))


QUERIES = {f.__name__: f for f in (frequent_itemsets_of_users, frequent_itemsets_of_items, two_pass_itemsets, fpgrowth_itemsets, transaction_itemsets, minhash_signatures, lsh_verified_pairs, jaccard_pairs, item_pearson, item_pearson_signed, cf_predictions, item_mean_fallback, cf_rmse, rating_features, tree_predictions, tree_rmse, model_round_trip, hybrid_predictions, hybrid_rmse)}


def _itemsets_sql(rows: str, support: str, levels: int = 8) -> str:
    """All levels one after the other; enough of them for these tables."""
    sql = f"""with r as ({rows}), s as (select {support} s from r), c1 as (select [item] items, count(*) support from r group by item having count(*) >= (select s from s)),
f as (select basket, item from r join c1 on c1.items[1] = r.item), o1 as (select basket, [item] items, item last from f)"""
    for k in range(2, levels + 1):
        sql += f""", x{k} as (select o.basket, list_append(o.items, f.item) items, f.item last from o{k - 1} o join f on o.basket = f.basket and f.item > o.last),
c{k} as (select items, count(*) support from x{k} group by items having count(*) >= (select s from s)), o{k} as (select x{k}.* from x{k} semi join c{k} using (items))"""
    return sql + f" select len(items)::int size, array_to_string(items, ',') items, support from ({' union all '.join(f'select * from c{k}' for k in range(1, levels + 1))})"


_PERCENT = "greatest(1, ceil(count(distinct basket) * {0} / 100.0))"
_USERS = _itemsets_sql(BASKETS_SQL, _PERCENT.format(USERS_PERCENT))
_SIGNED = f"""with r as ({RATINGS_SQL}), m as (select x.i item_1, y.i item_2, count(*) n_common, sum(x.rating) sx, sum(y.rating) sy, sum(x.rating * x.rating) sxx, sum(y.rating * y.rating) syy, sum(x.rating * y.rating) sxy
from r x join r y on x.u = y.u and x.i < y.i group by 1, 2 having count(*) >= {{0}}), d as (select *, (n_common * sxx - sx * sx) * (n_common * syy - sy * sy) den from m),
s as (select item_1, item_2, n_common, (n_common * sxy - sx * sy) / sqrt(den) similarity from d where den > 1e-9)"""
_CF = f"""with a as (select *, {TEXT_NUMBER_SQL.format("u || '|' || i")} % 10 = 0 test from ({RATINGS_SQL})), r as (select * from a where not test), t as (select * from a where test),
m as (select x.i item_1, y.i item_2, count(*) n, sum(x.rating) sx, sum(y.rating) sy, sum(x.rating * x.rating) sxx, sum(y.rating * y.rating) syy, sum(x.rating * y.rating) sxy
from r x join r y on x.u = y.u and x.i != y.i group by 1, 2 having count(*) >= {LEAST_COMMON}), d as (select *, (n * sxx - sx * sx) * (n * syy - sy * sy) den from m),
s as (select item_1, item_2, (n * sxy - sx * sy) / sqrt(den) similarity from d where den > 1e-9 and (n * sxy - sx * sy) / sqrt(den) > 1e-12),
w as (select t.u, t.i, sum(similarity * r.rating) / sum(abs(similarity)) p from t join r on t.u = r.u join s on s.item_1 = t.i and s.item_2 = r.i group by 1, 2),
e as (select i, avg(rating) e from r group by i),
p as (select t.u, t.i, t.rating, coalesce(w.p, e.e, 0.0) prediction from t left join w on t.u = w.u and t.i = w.i left join e on e.i = t.i)
"""
_RATED = f"""with a as (select *, {TEXT_NUMBER_SQL.format("u || '|' || i")} % 10 = 0 test from ({RATINGS_SQL})), x as (select a.* from a join (select distinct {CLEAN_SQL.format('business_id')} i from business) b on a.i = b.i
join (select distinct {CLEAN_SQL.format('user_id')} u from yelp_user) c on a.u = c.u) """
_SIGS = f"""with r as ({MEMBERS_SQL}), x as (select id, {TEXT_NUMBER_SQL.format('member')} % {P} x from r),
g as (select id, hash_no, min((a * x + b) % {P}) m from x, {coefficient_sql(sim.FAMILY)} group by 1, 2)"""
SQL = {
    "frequent_itemsets_of_users": _USERS,
    "two_pass_itemsets": _USERS,
    "fpgrowth_itemsets": _USERS,
    "frequent_itemsets_of_items": _itemsets_sql(f"select item basket, basket item from ({BASKETS_SQL})", f"max({ITEMS_SUPPORT})"),
    "transaction_itemsets": _itemsets_sql("""select basket, item from (select distinct o_custkey || '-' || strftime(o_orderdate, '%Y%m%d') basket, regexp_extract(p_brand, '([0-9]+)', 1)::bigint::varchar item
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey) qualify count(*) over (partition by basket) > 3""", _PERCENT.format(DAYS_PERCENT)),
    "minhash_signatures": _SIGS + " select id business_id, string_agg(m::varchar, ',' order by hash_no) signature from g group by id",
    "lsh_verified_pairs": _SIGS + f""", b as (select id, hash_no // {sim.ROWS} band, string_agg(m::varchar, ',' order by hash_no) bucket from g group by 1, 2),
c as (select distinct x.id a, y.id b from b x join b y on x.band = y.band and x.bucket = y.bucket and x.id < y.id), n as (select id, count(*) n from r group by id),
o as (select c.a, c.b, count(*) overlap from c join r x on x.id = c.a join r y on y.id = c.b and x.member = y.member group by 1, 2)
select a business_id_1, b business_id_2, overlap, round(overlap / (n1.n + n2.n - overlap), 6) similarity from o join n n1 on n1.id = a join n n2 on n2.id = b where overlap * 2 >= n1.n + n2.n - overlap""",
    "jaccard_pairs": f"""with r as ({MEMBERS_SQL}), n as (select id, count(*) n from r group by id), o as (select x.id a, y.id b, count(*) overlap from r x join r y on x.member = y.member and x.id < y.id group by 1, 2)
select a business_id_1, b business_id_2, overlap, round(overlap / (n1.n + n2.n - overlap), 6) similarity from o join n n1 on n1.id = a join n n2 on n2.id = b where overlap * 2 >= n1.n + n2.n - overlap""",
    "item_pearson": _SIGNED.format(LEAST_COMMON) + " select item_1, item_2, n_common, round(similarity, 6) similarity from s where similarity > 1e-12",
    "item_pearson_signed": _SIGNED.format(10) + " select item_1, item_2, n_common, round(similarity, 6) similarity from s",
    "cf_predictions": _CF + 'select u "user", i item, round(prediction, 6) prediction from p',
    "item_mean_fallback": _CF + 'select t.u "user", t.i item, round(coalesce(e.e, 0.0), 6) prediction from t left join e on e.i = t.i',
    "cf_rmse": _CF + "select count(*) n, round(sqrt(avg((rating - prediction) ** 2)), 6) rmse from p",
    "tree_rmse": _RATED + "select count(*) n, round(sqrt(avg((rating - (select avg(rating) from x where not test)) ** 2)), 6) mean_rmse, true within_bound from x where test",
    "model_round_trip": _RATED + "select count(*) n, 0::bigint n_different from x where test",
    "hybrid_rmse": _RATED + "select count(*) n, round(sqrt(avg((rating - (select avg(rating) from a where not test)) ** 2)), 6) mean_rmse, true within_bound from a where test",
    "rating_features": f"""with r as ({RATINGS_SQL}), b as (select {CLEAN_SQL.format('business_id')} i, stars, review_count from business),
u as (select {CLEAN_SQL.format('user_id')} u, arg_max(struct_pack(c := review_count, s := average_stars), rec_no) r from yelp_user group by 1)
select r.u "user", r.i item, round(rating, 6) rating, b.stars item_stars, b.review_count::double item_reviews, u.r.c::double user_reviews, u.r.s user_stars from r join b on r.i = b.i join u on r.u = u.u""",
}

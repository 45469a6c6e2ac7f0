"""Itemsets, MinHash, recommendation, against plain Python."""

import math
import random
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmine.operators import itemsets as its
from sparkmine.operators import recommend as rec
from sparkmine.operators import similarity as sim
from sparkmine.plans import mining


def brute_itemsets(rows, support):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    out, k = set(), 1
    items = sorted({i for s in baskets.values() for i in s})
    while True:
        level = {(c, n) for c in combinations(items, k) if (n := sum(set(c) <= s for s in baskets.values())) >= support}
        if not level:
            return out
        out |= level
        k += 1


def basket_rows(seed):
    rng = random.Random(seed)
    rows = [(b, rng.choice("aabbbccdefgh")) for b in range(30) for _ in range(rng.randrange(1, 9))]
    return rows + rows[:10] + [(None, "a"), (3, None)]


def as_set(df):
    return {(tuple(r["items"]), r["support"]) for r in df.collect()}


@pytest.mark.parametrize("support", [1, 3, 7, 31])
def test_itemsets_three_ways(spark, support):
    rows = basket_rows(1)
    b = its.baskets(spark.createDataFrame(rows, "b int, i string"), "b", "i").cache()
    want = brute_itemsets(rows, support)
    if support > 1:
        assert as_set(its.frequent_itemsets(b, support)) == want
        assert as_set(its.two_pass_itemsets(b, support, parts=3)) == want
    assert as_set(its.fpgrowth_itemsets(b, support)) == want
    assert as_set(its.frequent_itemsets(b, support, 2)) == {x for x in want if len(x[0]) <= 2}
    assert as_set(its.two_pass_itemsets(b, support, parts=1, max_size=2)) == {x for x in want if len(x[0]) <= 2}


def test_support_equal_to_a_count_in_one_part(spark):
    b = its.baskets(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "b int, i string"), "b", "i")
    assert as_set(its.two_pass_itemsets(b, 2, parts=1)) == {(("x",), 2)}


def test_registered_itemsets_of_every_size(spark, small):
    rows = lambda name: sorted(map(tuple, mining.QUERIES[name](spark, small).collect()))
    want = rows("frequent_itemsets_of_users")
    assert max(r[0] for r in want) > 3
    assert rows("two_pass_itemsets") == want and rows("fpgrowth_itemsets") == want


def test_no_baskets(spark):
    b = its.baskets(spark.createDataFrame([], "b int, i string"), "b", "i")
    assert its.frequent_itemsets(b, 1).count() == 0 and its.two_pass_itemsets(b, 1).count() == 0


def test_ordered_and_larger(spark):
    b = its.baskets(spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "b int, i string"), "b", "i")
    assert {r["basket"] for r in its.larger_baskets(b, 1).collect()} == {1}
    assert [r["items"] for r in its.ordered(its.frequent_itemsets(b, 1)).collect()] == [["x"], ["y"], ["x", "y"]]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.sampled_from("abcd")), min_size=1, max_size=25), st.integers(2, 4))
def test_itemsets_of_any_baskets(spark, rows, support):
    b = its.baskets(spark.createDataFrame(rows, "b int, i string"), "b", "i")
    assert as_set(its.frequent_itemsets(b, support)) == brute_itemsets(rows, support)


def set_rows(seed=2):
    rng = random.Random(seed)
    base = [[f"m{rng.randrange(60)}" for _ in range(12)] for _ in range(8)]
    return [(f"s{i}", m) for i in range(40) for m in rng.sample(base[i % 8], rng.randrange(6, 13))] + [("s1", None), (None, "m1")]


def brute_jaccard(rows, t):
    sets = {}
    for s, m in rows:
        if s is not None and m is not None:
            sets.setdefault(s, set()).add(m)
    return {(x, y) for x, y in combinations(sorted(sets), 2) if len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y])}


def test_lsh_equals_exact(spark):
    rows = set_rows()
    m = sim.members(spark.createDataFrame(rows, "s string, m string"), "s", "m").cache()
    want = brute_jaccard(rows, 0.5)
    exact = sim.verified(sim.overlap_pairs(m).select("id_1", "id_2"), m, 0.5)
    found = sim.lsh_pairs(m, 0.5)
    assert {(r["id_1"], r["id_2"]) for r in sim.similar_pairs(m, 0.5).collect()} == want
    assert {(r["id_1"], r["id_2"]) for r in sim.similar_pairs(m, 0.8).collect()} == brute_jaccard(rows, 0.8)
    assert {(r["id_1"], r["id_2"]) for r in exact.collect()} == want == {(r["id_1"], r["id_2"]) for r in found.collect()}
    assert all(0.5 <= r["similarity"] <= 1 for r in found.collect())


def test_signature_is_the_least_hash(spark):
    from sparkmine.functions.hashing import P, text_number

    m = sim.members(spark.createDataFrame([("s", "a"), ("s", "b")], "s string, m string"), "s", "m")
    xs = [r[0] for r in m.select(text_number(F.col("member"))).collect()]
    assert sim.signatures(m).first()["signature"] == [min((a * (x % P) + b) % P for x in xs) for a, b in sim.FAMILY]


def test_copies_of_a_set_meet(spark):
    m = sim.members(spark.createDataFrame([(f"s{i}", x) for i in range(5) for x in "ab"], "s string, m string"), "s", "m")
    assert sim.lsh_pairs(m, 0.9).count() == 10
    assert sim.lsh_pairs(m.limit(0), 0.9).count() == 0


@pytest.mark.parametrize("least, ranked", [(1, 9), (3, 100), (5, 100), (5, 8)])
def test_overlaps_equal_brute_force(spark, monkeypatch, least, ranked):
    monkeypatch.setattr(sim, "RANKED", ranked)
    rows = set_rows()
    sets = {}
    for s, m in rows:
        if s is not None and m is not None:
            sets.setdefault(s, set()).add(m)
    want = {(x, y, n) for x, y in combinations(sorted(sets), 2) if (n := len(sets[x] & sets[y])) >= least}
    m = sim.members(spark.createDataFrame(rows, "s string, m string"), "s", "m")
    assert {tuple(r) for r in sim.overlap_pairs(m, least).collect()} == want


def test_overlap_pairs_at_least(spark):
    m = sim.members(spark.createDataFrame([(s, x) for s, xs in {"a": "123", "b": "234", "c": "9", "d": "34"}.items() for x in xs], "s string, m string"), "s", "m")
    assert {tuple(r) for r in sim.overlap_pairs(m, 2).collect()} == {("a", "b", 2), ("b", "d", 2)}


def rating_rows(seed=5):
    rng = random.Random(seed)
    rows = [(f"u{u}", f"i{i}", float(rng.randrange(1, 6))) for u in range(25) for i in range(8) if rng.random() < 0.6]
    return rows + rows[:5] + [("u1", None, 3.0), (None, "i1", 3.0), ("u1", "i7", None)] + [(f"u{u}", "flat", 3.0) for u in range(20)]


def brute_pearson(r, least):
    by = {}
    for (u, i), x in r.items():
        by.setdefault(i, {})[u] = x
    out = {}
    for i in by:
        for j in by:
            common = by[i].keys() & by[j].keys()
            if i != j and len(common) >= least:
                mi, mj = (sum(by[k][u] for u in common) / len(common) for k in (i, j))
                num = sum((by[i][u] - mi) * (by[j][u] - mj) for u in common)
                den = math.sqrt(sum((by[i][u] - mi) ** 2 for u in common) * sum((by[j][u] - mj) ** 2 for u in common))
                if den > 1e-6:
                    out[i, j] = num / den
    return out


def test_item_based_prediction(spark):
    df = rec.ratings(spark.createDataFrame(rating_rows(), "u string, i string, s double"), "u", "i", "s").cache()
    r = {(x["user"], x["item"]): x["rating"] for x in df.collect()}
    sims = {k: v for k, v in brute_pearson(r, 5).items() if v > 1e-12}
    got = {(x["item_1"], x["item_2"]): x["similarity"] for x in rec.item_similarity(df, 5).collect()}
    assert got.keys() == sims.keys() and all(abs(got[k] - sims[k]) < 1e-9 for k in got)
    targets = [("u1", "i1"), ("u2", "i3"), ("new", "i2"), ("u3", "unknown"), ("u4", "flat"), ("u1", "i1")]
    p = {(x["user"], x["item"]): x["prediction"] for x in rec.predict_by_items(df, spark.createDataFrame(targets, "user string, item string"), rec.item_similarity(df, 5)).collect()}
    assert len(p) == 5
    for u, i in set(targets):
        near = [(sims[i, j], x) for (v, j), x in r.items() if v == u and j != i and (i, j) in sims]
        means = [x for (_, j), x in r.items() if j == i]
        want = sum(s * x for s, x in near) / sum(abs(s) for s, _ in near) if near else sum(means) / len(means) if means else 0.0
        assert abs(p[u, i] - want) < 1e-9


def test_signed_similarity(spark):
    df = rec.ratings(spark.createDataFrame([(f"u{k}", i, float(k if i == "a" else 5 - k)) for k in range(1, 5) for i in "ab"], "u string, i string, s double"), "u", "i", "s")
    assert rec.item_similarity(df, 2).count() == 0
    assert abs(rec.item_similarity(df, 2, positive_only=False).first()["similarity"] + 1) < 1e-9


def test_trees_hybrid_and_error(spark, tmp_path):
    from sparkmine.sources.files import load_model, save_model

    rng = random.Random(1)
    items = spark.createDataFrame([(f"i{k}", 1 + k % 5.0, float(k)) for k in range(20)], "item string, item_stars double, item_reviews double")
    users = spark.createDataFrame([(f"u{k}", float(k), 3.0) for k in range(30)], "user string, user_reviews double, user_stars double")
    rows = [(f"u{rng.randrange(30)}", f"i{k}", 1 + k % 5.0) for k in range(20) for _ in range(20)] + [("nobody", "i1", 2.0)]
    r = rec.ratings(spark.createDataFrame(rows, "u string, i string, s double"), "u", "i", "s")
    train = rec.features(r, items, users)
    model = rec.fit_trees(train, maxIter=5)
    save_model(model, str(tmp_path / "model"))
    p = rec.predict_by_features(load_model(str(tmp_path / "model")), train)
    assert rec.rmse(p, r).first()["rmse"] < 0.3
    flat = r.select("user", "item", F.lit(0.0).alias("prediction"))
    h = {(x["user"], x["item"]): x["prediction"] for x in rec.hybrid(flat, p, 0.1).collect()}
    q = {(x["user"], x["item"]): x["prediction"] for x in p.collect()}
    assert h[("nobody", "i1")] == 0.0 and all(abs(h[k] - 0.9 * v) < 1e-9 for k, v in q.items())
    assert rec.rmse(flat.limit(0), r).first()["n"] == 0


@pytest.mark.parametrize("paired", [100, 9])
def test_overlaps_of_several_meet_by_two_rare_members(spark, monkeypatch, paired):
    monkeypatch.setattr(sim, "PAIRED", paired)
    rng = random.Random(9)
    sets = {i: {min(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(4, 22))} for i in range(60)}
    m = sim.members(spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id int, member int"), "id", "member")
    want = {(*sorted((str(a), str(b))), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 5}
    assert {tuple(r) for r in sim.overlap_pairs(m, 5).collect()} == want and len(want) > 20
    kept = m.join(m.groupBy("member").agg(F.count("*").alias("common")), "member").join(m.groupBy("id").agg(F.count("*").alias("n")).where("n >= 5"), "id").withColumn("need", F.lit(5))
    twice, once = ({tuple(r) for r in f(kept).collect()} for f in (sim._met_twice, sim._met))
    assert {w[:2] for w in want} <= twice <= once and len(twice) < len(once)

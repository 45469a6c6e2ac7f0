"""Distinct counts, samples, seen keys and frequent values."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmine.llm.distinct import bucket_counts, distinct_counts, identifier_pairs, merge_pairs
from sparkmine.llm.frequent import frequent_values
from sparkmine.llm import reservoir
from sparkmine.llm.reservoir import _taken, fixed_sample, merge_states, piece_samples, reservoir_states, together
from sparkmine.llm.seen import BloomChain, bloom_answers, bloom_seen, checked, seen_before, wrong_rate
from sparkmine.llm.seen import merge_states as merge_chains

IDS = [("u1", "d1", "b1"), ("u1", "d1", "b1"), ("u1", "d2", "b1"), ("u2", "d1", "b1"), ("u2", "d1", None), (None, "d1", "b2"), ("u3", None, "b2"), ("u1", "d1", "b2")]
COMBOS = [["d", "b"], ["d"], ["b"], []]


def brute_distinct(rows):
    out = {}
    for c in COMBOS:
        for u, d, b in rows:
            key = (d if "d" in c else None, b if "b" in c else None)
            if u is None or ("d" in c and d is None) or ("b" in c and b is None):
                continue
            out.setdefault((",".join(c), *key), set()).add(u)
    return {(*k, len(v)) for k, v in out.items()}


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_distinct_counts_are_exact(spark, buckets):
    rng = random.Random(2)
    rows = IDS + [(f"u{rng.randrange(30)}", f"d{rng.randrange(4)}", "hot" if rng.random() < 0.5 else f"b{rng.randrange(9)}") for _ in range(400)]
    got = distinct_counts(spark.createDataFrame(rows, "u string, d string, b string"), ["u"], ["d", "b"], COMBOS, buckets)
    assert {(r["combination"], r["d"], r["b"], r["n_u"]) for r in got.collect()} == brute_distinct(rows)
    assert {r["error_bound"] for r in got.collect()} == {0.0}


def test_partial_results_merge(spark):
    df = spark.createDataFrame(IDS, "u string, d string, b string")
    state = lambda d: identifier_pairs(d, ["u"], ["d", "b"], 8)
    merged = merge_pairs(state(df.limit(5)), state(df))
    one = bucket_counts(state(df), 2, [[0, 1], [0]]).groupBy("combination", "g0", "g1").agg(F.sum("n")).collect()
    two = bucket_counts(merged, 2, [[0, 1], [0]]).groupBy("combination", "g0", "g1").agg(F.sum("n")).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_two_identifiers_nothing_and_clashing_names(spark):
    df = spark.createDataFrame([("r1", "u1", "x", 1), ("r2", "u1", "x", 1), ("r3", None, "x", 1)], "r string, id string, `g.0` string, n int")
    got = distinct_counts(df, ["r", "id"], ["g.0"], [["g.0"]]).collect()
    assert [(r["g.0"], r["n_r"], r["n_id"]) for r in got] == [("x", 3, 1)]
    assert distinct_counts(df.limit(0), ["r"], ["g.0"], [["g.0"], []]).count() == 0


def test_sample_is_whole_small_empty_and_keeps_columns(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x", i) for i in range(7)], "a int, population string, part int")
    got = fixed_sample(df, 10)
    assert got.columns == ["a", "population", "part", "population_"]
    assert sorted(r["a"] for r in got.collect()) == list(range(7)) and {r["population_"] for r in got.collect()} == {7}
    assert fixed_sample(df.limit(0), 10).count() == 0
    assert fixed_sample(df, 3, seed=1).count() == 3


def test_sample_is_uniform(spark):
    # 12 partitions of very different sizes; a pair of levels of merging
    sizes = [1, 2, 40, 3, 9, 25, 1, 0, 60, 12, 30, 17]
    n, k, runs = sum(sizes), 20, 60
    ids = iter(range(n))
    parts = [[(next(ids),) for _ in range(s)] for s in sizes]
    rdd = spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda x: x)
    df = spark.createDataFrame(rdd, "id int").cache()
    got = Counter()
    for seed in range(runs):
        s = merge_states(reservoir_states(df, k, seed), k, seed, fan_in=4, parts=12)
        rows = [r["row"]["id"] for r in s.collect()]
        assert len(set(rows)) == k
        got.update(rows)
    counts = np.array([got[i] for i in range(n)])
    expected = runs * k / n
    assert abs(counts.sum() - runs * k) == 0
    chi = ((counts - expected) ** 2 / (expected * (1 - k / n))).sum()
    assert chi < n + 4 * (2 * n) ** 0.5  # four standard deviations
    # small partitions aren't favoured
    start = np.cumsum([0, *sizes])
    for a, b in zip(start, start[1:]):
        if b - a >= 25:
            assert abs(counts[a:b].mean() - expected) < 5 * (expected / (b - a)) ** 0.5


def test_pieces_that_arrive_separately(spark):
    pieces = [spark.range(0, 5, 1, 1), spark.range(5, 305, 1, 3), spark.range(305, 400, 1, 2)]
    got = Counter()
    for seed in range(40):
        done = [merge_states(reservoir_states(p, 20, seed, arrival=f"piece {i}"), 20, seed) for i, p in enumerate(pieces)]
        rows = merge_states(together(*done), 20, seed).collect()
        assert len({r["row"]["id"] for r in rows}) == 20 and {r["seen"] for r in rows} == {400}
        got.update("a" if r["row"]["id"] < 5 else "b" if r["row"]["id"] < 305 else "c" for r in rows)
    assert abs(got["b"] - 600) < 60 and abs(got["c"] - 190) < 55 and got["a"] < 30


def test_arrivals_of_one_seed_are_independent(spark):
    places = [{r["row"]["id"] % 1000 for r in reservoir_states(spark.range(i * 1000, i * 1000 + 1000, 1, 1), 30, 7, arrival=str(i)).collect()} for i in range(2)]
    assert len(places[0] & places[1]) < 10


@pytest.mark.parametrize("held", [100_000, 60])
def test_samples_of_pieces(spark, monkeypatch, held):
    monkeypatch.setattr(reservoir, "OPEN_RECORDS", held)
    rows = [(i, None if i % 5 == 0 else f"p{i % 7}" if i < 300 else "big", "x") for i in range(700)]
    df = spark.createDataFrame(rows, "population int, `pie ce` string, no string").repartition(6)
    sizes = Counter(p for _, p, _ in rows)
    got = Counter()
    for seed in range(12):
        s = piece_samples(df, 20, "pie ce", seed).collect()
        assert Counter(r["pie ce"] for r in s) == {p: min(20, n) for p, n in sizes.items()}
        assert len({r["population"] for r in s}) == len(s) and all(r["population_"] == sizes[r["pie ce"]] for r in s)
        whole = fixed_sample(df, 50, seed, "pie ce").collect()
        assert len({r["population"] for r in whole}) == 50 and {r["population_"] for r in whole} == {700}
        got.update(r["pie ce"] for r in whole)
    for p, n in sizes.items():
        assert abs(got[p] - 600 * n / 700) < 5 * (600 * n / 700) ** 0.5 + 5
    assert piece_samples(df.limit(0), 3, "pie ce").count() == 0 == fixed_sample(df.limit(0), 3, piece="pie ce").count()


def test_hypergeometric_draws():
    rng = random.Random(3)
    got = Counter(_taken([5, 7, 3], 6, rng)[0] for _ in range(20_000))
    from math import comb

    for x in range(6):
        want = 20_000 * comb(5, x) * comb(10, 6 - x) / comb(15, 6)
        assert abs(got[x] - want) < 5 * want**0.5 + 5


def test_sample_keeps_any_type(spark):
    df = spark.sql("select id, timestamp_ntz'2020-01-01 00:00:00' t, timestamp'2020-01-01 00:00:00' z, array(id) a, map('k', id) m, cast(null as string) s, cast(1.5 as decimal(9,2)) d, date'2020-01-01' y, named_struct('x', id) n from range(50)")
    got = fixed_sample(df, 10)
    assert got.drop("population").dtypes == df.dtypes and got.count() == 10
    assert set(map(str, got.drop("population").collect())) <= set(map(str, df.collect()))


def test_draws_follow_population_sizes():
    rng = random.Random(0)
    total = np.sum([_taken([10, 10**12, 3 * 10**12], 100, rng) for _ in range(200)], axis=0)
    assert total.sum() == 20_000 and total[0] == 0 and abs(total[1] - 5000) < 300
    assert _taken([2, 3], 10, rng) == [2, 3]


def test_bloom_chain_bound_holds():
    chain = BloomChain(error=0.01, first=100)
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 20_000)
    for part in np.array_split(keys, 40):
        chain.add(part[~chain.holds(part)])
    assert chain.holds(keys).all()
    others = rng.integers(-(2**62), 2**62, 50_000)
    wrong = np.isin(others, keys, invert=True) & chain.holds(others)
    assert len(chain.layers) >= 7 and wrong.mean() <= 0.01 and chain.bound() <= 0.01
    assert 5 not in BloomChain()


def brute_seen(rows):
    first = {}
    for k, o in rows:
        if k is not None and o is not None:
            first[k] = min(first.get(k, o), o)
    return sorted(((k, o, None if o is None else False if k is None else o > first[k]) for k, o in rows), key=str)


def test_seen_before_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(300)}", i) for i in range(1500)]
    rows += [(None, 5), ("k1", None), (None, None), ("k2", 10), ("k2", 10), ("tie", 2000), ("tie", 2000), ("tie", 2001)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, o, 1, "z") for k, o in rows], "`the key` string, `o.1` long, hash int, asked string").repartition(5)
    told = lambda d: sorted(((r["key"], r["order"], r["seen"]) for r in d.collect()), key=str)
    assert told(seen_before(df, "the key", "o.1", shards=3)) == brute_seen(rows)
    got = checked(df, "the key", "o.1", error=0.2, shards=3)
    assert told(got) == brute_seen(rows)
    rate = wrong_rate(got).first()
    assert rate["n_records"] == len(rows) and rate["bound"] <= 0.2
    assert seen_before(df.limit(0), "the key", "o.1").count() == 0 == checked(df.limit(0), "the key", "o.1").count()


def test_records_of_one_order_do_not_precede_each_other(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # ties go over the ends of batches
    try:
        rows = [("a", 1)] * 10 + [("b", 2), ("a", 2), ("c", 2), ("c", 2)] + [("b", 3)] * 5
        df = spark.createDataFrame(rows, "k string, o long").repartition(3)
        got = checked(df, "k", "o", 0.001, shards=2)
        assert sorted(((r["key"], r["order"], r["seen"]) for r in got.collect()), key=str) == brute_seen(rows)
        assert wrong_rate(got).first()["n_wrong"] == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_history_that_grows_over_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"k{rng.randrange(4000)}", i) for i in range(6000)]
    first, state, wrong, new = {}, None, 0, 0
    for run in range(3):
        now = rows[run * 2000 : run * 2000 + 2000]
        df = spark.createDataFrame(now, "k string, o long").repartition(4)
        answers, state = bloom_answers(df, "k", "o", 0.01, shards=3, history=state)
        path = f"{tmp_path}/state{run}"
        state.write.parquet(path)  # the next run starts from the table, not from the records
        state = spark.read.parquet(path)
        for r in sorted(answers.collect(), key=lambda r: r["order"]):
            if r["key"] in first:
                assert r["maybe_seen"]
            else:
                wrong, new = wrong + r["maybe_seen"], new + 1
                first[r["key"]] = r["order"]
            assert r["bound"] <= 0.01
    assert wrong <= 0.01 * new + 3 * (0.01 * new) ** 0.5
    kept = state.collect()
    assert {r["shard"] for r in kept} == {0, 1, 2} and {r["shards"] for r in kept} == {3}
    again, same = bloom_answers(spark.createDataFrame([], "k string, o long"), "k", "o", 0.01, history=state)
    assert again.count() == 0 and sorted(map(tuple, same.collect())) == sorted(map(tuple, kept))


def test_histories_built_apart_merge(spark):
    part = lambda a, b: spark.createDataFrame([(f"k{i}", i) for i in range(a, b)], "k string, o long")
    (_, one), (_, two) = (bloom_answers(part(*p), "k", "o", 0.01, shards=2) for p in ((0, 3000), (3000, 9000)))
    answers, state = bloom_answers(part(0, 12_000), "k", "o", 0.01, history=merge_chains(one, two))
    got = {r["order"]: r for r in answers.collect()}
    assert all(got[i]["maybe_seen"] for i in range(9000)) and sum(got[i]["maybe_seen"] for i in range(9000, 12_000)) < 90
    assert max(r["bound"] for r in got.values()) <= 0.03 and state.count() > one.count() + two.count()


def test_bloom_answers_never_miss(spark):
    rows = [(f"k{i % 50}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, o long").repartition(4)
    got = {r["order"]: r["maybe_seen"] for r in bloom_seen(df, "k", "o", 0.01, 4).collect()}
    assert all(got[i] for i in range(50, 1000)) and sum(got[i] for i in range(50)) <= 3


def test_frequent_values(spark):
    rows = [("r1", "a", "x"), ("r1", "a", "x"), ("r2", "a", None), ("r3", "b", "y"), ("r4", "b", "x"), ("r5", None, "x"), (None, "c", "x"), ("r6", "c", "y")]
    df = spark.createDataFrame(rows, "r string, `field_name` string, n string")
    got = frequent_values(df, ["field_name", "n"], 2, record="r").collect()
    assert {(r["field_name"], r["key_value"], r["n_records"], r["n_total"], r["place"]) for r in got} == {("field_name", "a", 2, 6, 1), ("field_name", "b", 2, 6, 2), ("n", "x", 3, 6, 1), ("n", "y", 2, 6, 2)}
    plain = frequent_values(df, ["n"], 1).collect()
    assert [(r["key_value"], r["n_records"], r["n_total"], r["share"]) for r in plain] == [("x", 5, 8, 5 / 8)]
    assert frequent_values(df.limit(0), ["n"], 3, record="r").count() == 0

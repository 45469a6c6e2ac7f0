"""Co-occurring items and similar sets against brute force."""

import random
from itertools import combinations

import pytest

from sparkmine.llm import queries, setjoin
from sparkmine.llm.cooccurrence import item_pairs
from sparkmine.llm.setjoin import similar_classes, similar_sets


def brute_pairs(rows, min_count, min_lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, ones, twos = len(baskets), {}, {}
    for s in baskets.values():
        for i in s:
            ones[i] = ones.get(i, 0) + 1
        for p in combinations(sorted(s), 2):
            twos[p] = twos.get(p, 0) + 1
    return {(*p, c, ones[p[0]], ones[p[1]], n) for p, c in twos.items() if c >= min_count and (min_lift is None or c * n >= min_lift * ones[p[0]] * ones[p[1]])}


def basket_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        for _ in range(rng.choice([1, 2, 5, 12])):
            rows.append((b, min(rng.randrange(1, 20), rng.randrange(1, 20))))
    rows += [(7, i) for i in range(1, 40)]  # one large basket
    return rows + [(None, 3), (3, None), (None, None)] + rows[:20]


@pytest.mark.parametrize("min_count, min_lift, block", [(1, None, 512), (3, 1.5, 512), (2, 1, 4), (1, 2, 3), (5, None, 1)])
def test_pairs_equal_brute_force(spark, min_count, min_lift, block):
    df = spark.createDataFrame(basket_rows(), "b int, i long")
    got = item_pairs(df, "b", "i", min_count, min_lift, block)
    assert got.columns == ["item_1", "item_2", "n_both", "n_1", "n_2", "n_baskets", "lift", "pmi"]
    assert {tuple(r)[:6] for r in got.collect()} == brute_pairs(basket_rows(), min_count, min_lift)


def test_pair_numbers_and_boundary(spark):
    # lift is exactly 2: two of four baskets hold both
    rows = [(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "z"), (4, "z")]
    df = spark.createDataFrame(rows, "b int, i string")
    r = item_pairs(df, "b", "i", 2, 2).collect()
    assert [(x["item_1"], x["item_2"], x["lift"], x["pmi"]) for x in r] == [("x", "y", 2.0, 1.0)]
    assert item_pairs(df, "b", "i", 2, 2.01).count() == 0


def test_pairs_of_nothing_and_clashing_names(spark):
    assert item_pairs(spark.createDataFrame([], "b int, i int"), "b", "i", 1, 2).count() == 0
    df = spark.createDataFrame([(1, 1, 9, 9, 9), (1, 2, 9, 9, 9)], "`b.x` int, `i i` int, own int, size int, item_1 int")
    assert item_pairs(df, "b.x", "i i").count() == 1


def test_all_pairs_include_rare_ones_and_those_below_chance(spark, tmp_path):
    rows = [(b, i) for b, i in basket_rows() if b is not None and i is not None]
    spark.createDataFrame([(str(b), str(i)) for b, i in rows], "user_id string, business_id string").write.parquet(f"{tmp_path}/small2.parquet")
    got = queries.p1_all_pairs(spark, str(tmp_path)).collect()
    assert {tuple(r)[:5] for r in got} == {x[:5] for x in brute_pairs(rows, 1, None)}
    assert min(r["n_both"] for r in got) == 1 and min(r["pmi"] for r in got) < 0


def brute_sets(rows, t, least, other=None):
    def sets(rows):
        out = {}
        for s, x in rows:
            if s is not None and x is not None:
                out.setdefault(s, set()).add(x)
        return {k: v for k, v in out.items() if len(v) >= least}

    a = sets(rows)
    pairs = combinations(sorted(a, key=lambda s: s.encode()), 2) if other is None else ((x, y) for x in a for y in sets(other))
    b = a if other is None else sets(other)
    out = set()
    for x, y in pairs:
        common = len(a[x] & b[y])
        if common and common >= t * (len(a[x]) + len(b[y]) - common) - 1e-9:
            out.add((x, y, len(a[x]), len(b[y]), common))
    return out


def set_rows(seed, n=60, universe=80):
    rng = random.Random(seed)
    rows, base = [], []
    for s in range(n):
        kind = rng.random()
        if base and kind < 0.5:  # a changed copy
            items = list(rng.choice(base))
            rng.shuffle(items)
            items = items[: max(1, int(len(items) * rng.choice([0.5, 0.8, 1])))] + [f"u{rng.randrange(universe)}" for _ in range(rng.randrange(3))]
        else:
            items = [f"u{min(rng.randrange(universe), rng.randrange(universe))}" for _ in range(rng.choice([1, 3, 6, 20, 45]))]
        base.append(items)
        rows += [(f"s{s}" if s % 7 else f"S{s}", i) for i in items]
    return rows + [(None, "u1"), ("s1", None)] + rows[:30]


@pytest.mark.parametrize("t, least", [(0.5, 1), (0.5, 5), (0.8, 1), (1.0, 2), (0.3, 3)])
def test_similar_sets_equal_brute_force(spark, t, least):
    rows = set_rows(3)
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", t, least)
    assert {tuple(r)[:5] for r in got.collect()} == brute_sets(rows, t, least)


@pytest.mark.parametrize("forced, block", [(1, 2048), (2, 2048), (3, 2048), (1, 2), (2, 2)])
def test_every_prefix_length_finds_all(spark, monkeypatch, forced, block):
    choose = setjoin._choose
    monkeypatch.setattr(setjoin, "_choose", lambda *a: (dict.fromkeys(choose(*a)[0], forced), 10**6))
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rows = [r for r in set_rows(5) if r[0] is not None]
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", 0.6, 5)
    assert {tuple(r)[:5] for r in got.collect()} == brute_sets(rows, 0.6, 5) and got.count() == got.distinct().count()


def test_several_tokens_are_shared_by_large_sets_too(spark, monkeypatch):
    # sets of 200 of 4000 tokens: every token is in some 30 sets, so one in common says little
    rng, chosen = random.Random(6), []
    sets = [rng.sample(range(4000), 200) for _ in range(600)]
    sets += [[*s[:197], *rng.sample(range(4000, 4010), 2)] for s in sets[:20]]
    choose = setjoin._choose
    monkeypatch.setattr(setjoin, "_choose", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    rows = [(f"s{i}", f"t{x}") for i, s in enumerate(sets) for x in s]
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", 0.95)
    assert {tuple(r)[:5] for r in got.collect()} == brute_sets(rows, 0.95, 1)
    assert max(chosen[0][0].values()) > 1 and max(c for c, k in chosen[0][0].items() if k > 1) >= 3


@pytest.mark.parametrize("t, least", [(0.5, 1), (0.8, 2)])
def test_classes_and_links_equal_the_pairs(spark, t, least):
    rows = set_rows(3) + [(f"copy{i}", f"z{j}") for i in range(5) for j in range(4)]
    members, links = similar_classes(spark.createDataFrame(rows, "s string, x string"), "s", "x", t, least)
    of = {r["id"]: r for r in members.collect()}
    pairs = brute_sets(rows, t, least)
    assert {i: r["n_links"] for i, r in of.items()} == {i: sum(i in p[:2] for p in pairs) for i in of}
    sets = {}
    for s, x in rows:
        if s is not None and x is not None:
            sets.setdefault(s, set()).add(x)
    assert {i: r["class_id"] for i, r in of.items()} == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets if len(sets[i]) >= least}
    assert {(r["class_1"], r["class_2"], r["overlap"]) for r in links.collect()} == {(a, b, n) for a, b, _, _, n in pairs if of[a]["class_id"] == a and of[b]["class_id"] == b and sets[a] != sets[b]}


def test_a_mass_of_copies_costs_one_row_each(spark):
    n = 20_000
    df = spark.range(n * 3).selectExpr("concat('c', id div 3) s", "concat('t', id % 3) x").unionByName(spark.sql("select 'other' s, concat('t', id) x from range(4)"))
    members, links = similar_classes(df, "s", "x", 0.5)
    assert members.count() == n + 1 and [tuple(r)[:3] for r in links.collect()] == [("c0", "other", 3)]
    assert {(r["class_id"], r["class_size"], r["n_links"]) for r in members.collect()} == {("c0", n, n), ("other", 1, n)}


@pytest.mark.parametrize("block", [3, 2048])
def test_copies_in_blocks_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rows = [(f"c{i}", x) for i in range(20) for x in "pqr"]
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", 0.5)
    assert got.count() == 190 == got.distinct().count()


def test_sets_of_large_size_take_the_other_ways(spark):
    rows = set_rows(9)
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", 0.5, 2, direct=15, in_arrays=10)
    assert {tuple(r)[:5] for r in got.collect()} == brute_sets(rows, 0.5, 2)


@pytest.mark.parametrize("common", [700, 900])
def test_pairs_across_the_limit_of_ranked_sets(spark, common):
    # all common tokens are in two sets, so only the order of their fingerprints decides which are in the prefixes
    rows = [(f"{side}{p}", f"{p}:{x}") for p in range(12) for side, own in (("a", range(990 - common)), ("b", range(-1010 + common, 0))) for x in (*own, *range(1000, 1000 + common))]
    got = similar_sets(spark.createDataFrame(rows, "s string, x string"), "s", "x", 0.5, direct=1000)
    assert {tuple(r)[:5] for r in got.collect()} == {(f"a{p}", f"b{p}", 990, 1010, common) for p in range(12)}


def test_sets_between_two_tables(spark):
    a, b = set_rows(3, 40), set_rows(4, 30) + [r for r in set_rows(3, 40) if r[0] in ("s5", "s9", "s12")]
    got = similar_sets(spark.createDataFrame(a, "s string, x string"), "s", "x", 0.5, 1, other=spark.createDataFrame(b, "s string, x string"))
    assert {tuple(r)[:5] for r in got.collect()} == brute_sets(a, 0.5, 1, b)


def test_copies_empty_and_clashing(spark):
    rows = [(f"c{i}", x, 0, 0) for i in range(6) for x in "pqr"]
    df = spark.createDataFrame(rows, "`s.1` string, size string, sides int, t int")
    got = similar_sets(df, "s.1", "size", 0.5)
    assert got.count() == 15 and {r["similarity"] for r in got.collect()} == {1.0}
    assert similar_sets(spark.createDataFrame([], "s string, x string"), "s", "x").count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "s.1", "size", 0)

"""Graphs, sketches, streams and clusters against plain Python."""

import random
import uuid
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmine.functions.hashing import P, coefficients
from sparkmine.operators import clustering as cl
from sparkmine.operators import graph as g
from sparkmine.operators import sketches as sk
from sparkmine.streaming import live


def edge_list(seed, n=24, m=34):
    rng = random.Random(seed)
    e = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return sorted(e | {(100 + i, 101 + i) for i in range(12)})  # and a path


def neighbours(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def brute_components(edges):
    near, of = neighbours(edges), {}
    for v in sorted(near):
        if v not in of:
            todo = [v]
            of[v] = v
            while todo:
                for w in near[todo.pop()]:
                    if w not in of:
                        of[w] = v
                        todo.append(w)
    return of


def brute_betweenness(edges):
    """Shortest paths of all pairs, counted one by one."""
    near = neighbours(edges)
    out = dict.fromkeys(edges, 0.0)
    for s in near:
        dist, todo = {s: 0}, [s]
        for v in todo:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        for t in todo[1:]:
            paths = [[t]]
            while paths[0][-1] != s:
                paths = [[*p, w] for p in paths for w in near[p[-1]] if dist.get(w, -1) == dist[p[-1]] - 1]
            for p in paths:
                for a, b in zip(p, p[1:]):
                    out[tuple(sorted((a, b)))] += 0.5 / len(paths)
    return {e: round(x, 5) for e, x in out.items()}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    e = edge_list(seed)
    assert {r["id"]: r["component"] for r in g.components(frame(spark, e)).collect()} == brute_components(e)


def test_components_of_a_long_path_and_a_hub(spark):
    ids = list(range(400))
    random.Random(2).shuffle(ids)
    e = [*zip(ids, ids[1:]), *((1000, 1000 + i) for i in range(1, 500))]
    got = {r["id"]: r["component"] for r in g.components(frame(spark, e)).collect()}
    assert got == {i: 0 for i in ids} | {1000 + i: 1000 for i in range(500)}
    with pytest.raises(RuntimeError):
        g.components(frame(spark, e), max_rounds=1)


def test_components_of_odd_edges(spark):
    assert g.components(frame(spark, [])).count() == 0
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (None, 4), (2, 2)], "src long, dst long")
    assert {tuple(r) for r in g.components(e).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("held, rows", [(10**6, None), (0, None), (0, 500)])
def test_betweenness(spark, held, rows):
    e = edge_list(3, 14, 18)
    got = {(r["src"], r["dst"]): r["betweenness"] for r in g.edge_betweenness(frame(spark, e), held_edges=held, rows_at_once=rows).collect()}
    want = brute_betweenness(e)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_degrees_labels_communities(spark):
    e = [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert {tuple(r) for r in g.degrees(frame(spark, e)).collect()} == {(1, 2), (2, 2), (3, 2), (4, 1), (5, 1)}
    labels = dict.fromkeys([1, 2, 3, 4, 5])
    labels = {v: v for v in labels}
    near = neighbours(e)
    for _ in range(5):
        labels = {v: min((-sum(labels[w] == x for w in near[v]), x) for x in {labels[w] for w in near[v]})[1] for v in near}
    assert {r["id"]: r["label"] for r in g.label_propagation(frame(spark, e), 5).collect()} == labels
    c = g.communities(g.components(frame(spark, e)), "component").collect()
    assert [(r["size"], r["members"]) for r in c] == [(2, [4, 5]), (3, [1, 2, 3])]


def brute_modularity(edges, of):
    near, m2 = neighbours(edges), 2 * len(edges)
    return sum(((j in near[i]) - len(near[i]) * len(near[j]) / m2) / m2 for i in near for j in near if of[i] == of[j])


def test_modularity(spark):
    e = edge_list(4)
    of = {v: v % 3 for v in neighbours(e)}
    labels = spark.createDataFrame(list(of.items()), "id long, component long")
    assert abs(g.modularity(frame(spark, e), labels).first()[0] - brute_modularity(e, of)) < 1e-9


@pytest.mark.parametrize("alone", [10**6, 0])
def test_girvan_newman(spark, alone):
    # two triangles and a bridge
    e = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)]
    of, q, history = g.girvan_newman(frame(spark, e), alone_edges=alone)
    assert {r["id"]: r["component"] for r in of.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert abs(q - brute_modularity(e, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4})) < 1e-9 and len(history) == 3 and abs(history[0]) < 1e-9


def test_girvan_newman_of_nothing(spark):
    assert g.girvan_newman(frame(spark, []))[0].count() == 0


def test_betweenness_of_a_graph_that_tasks_can_hold(spark, monkeypatch):
    # 100,001 edges, most of them in trees that hang on the graph
    monkeypatch.setattr(g, "_by_levels", None)
    e = spark.range(1, 100_000).selectExpr("0L src", "id dst").unionByName(frame(spark, [(1, 2), (2, 3)]))
    got = dict((r[0], r[1]) for r in g.edge_betweenness(e).groupBy("betweenness").count().collect())
    assert got == {99_999.0: 99_996, 99_997.5: 2, 99_997.0: 1, 1.5: 2}


@pytest.mark.parametrize("seed, dense", [(1, 1000), (2, 0), (3, 1000), (4, 0)])
def test_scores_of_a_connected_graph(monkeypatch, seed, dense):
    monkeypatch.setattr(g, "DENSE", dense)
    monkeypatch.setattr(g, "STATE_ROWS", 60)
    monkeypatch.setattr(g, "ARCS_AT_ONCE", 7)
    e = sorted({*edge_list(seed, 16, 40), *((0, i) for i in range(1, 16)), (3, 100)})
    ids = sorted({x for p in e for x in p})
    u, v = (np.array([ids.index(p[k]) for p in e]) for k in (0, 1))
    want = brute_betweenness(e)
    assert np.allclose(g._scores(len(ids), u, v), [want[p] for p in e], atol=2e-5)


def test_levels_take_no_jobs_of_their_own(spark):
    e = [(i, i + 1) for i in range(40)]
    sc = spark.sparkContext
    sc.setJobGroup("levels of a path", "")
    got = {r["src"]: r["betweenness"] for r in g.edge_betweenness(frame(spark, e), held_edges=0).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("levels of a path"))
    sc.setJobGroup("other", "")
    assert got == {i: (i + 1.0) * (40 - i) for i in range(40)} and jobs < 40


def brute_girvan_newman(edges):
    left, of = set(edges), {v: c for v, c in brute_components(edges).items()}
    best, history = of, [brute_modularity(edges, of)]
    while left:
        scores = brute_betweenness(sorted(left))
        top = max(scores.values())
        left -= {e for e, s in scores.items() if abs(s - top) < 2e-5}
        of = {v: v for v in of} | brute_components(sorted(left))
        history.append(brute_modularity(edges, of))
        if history[-1] > max(history[:-1]) + 1e-12:
            best = of
    return best, history


def many_parts():
    return sorted({(1000 * k + a, 1000 * k + b) for k in range(3) for a, b in edge_list(k % 2 + 5, 12, 18) if b < 104})


def test_division_of_many_components_in_few_jobs(spark):
    e = many_parts()
    sc = spark.sparkContext
    sc.setJobGroup("division", "")
    of, q, history = g.girvan_newman(frame(spark, e), alone_edges=0)
    got = {r["id"]: r["component"] for r in of.collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("division"))
    sc.setJobGroup("other", "")
    want, course = brute_girvan_newman(e)
    assert got == want and len(history) == len(course) and np.allclose(history, course) and abs(q - max(course)) < 1e-9
    assert jobs < 6 * len(history)


def test_division_of_all_linked_users(spark, small):
    from sparkmine.plans import graphs

    assert {r["id"] for r in graphs.girvan_newman(spark, small).collect()} == {r["id"] for r in graphs.user_degrees(spark, small).collect()} != set()


def test_division_equals_brute_force_and_names_its_vertices(spark):
    e = [(a + 7, b + 7) for a, b in many_parts()]
    of, q, history = g.girvan_newman(frame(spark, e))
    want, course = brute_girvan_newman(e)
    assert {r["id"]: r["component"] for r in of.collect()} == want and np.allclose(history, course)


def test_graph_of_shared_items(spark):
    rows = [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", None)]
    from sparkmine.operators.similarity import members

    assert {tuple(r) for r in g.shared_item_graph(members(spark.createDataFrame(rows, "u string, i int"), "u", "i"), 2).collect()} == {("a", "b")}


def stream_rows(n=400, values=60, seed=1):
    rng = random.Random(seed)
    return [(i, f"v{min(rng.randrange(values), rng.randrange(values))}") for i in range(n)]


def md5_number(v):
    import hashlib

    return int(hashlib.md5(v.encode()).hexdigest()[:15], 16)


def test_bloom_rates_equal_a_filter(spark):
    rows, bits, k = stream_rows(), 97, 3
    coeffs, filled, seen, want = coefficients(k, 17), set(), set(), {}
    for i, v in rows:
        at = {((a * (md5_number(v) % P) + b) % P) % bits for a, b in coeffs}
        c = want.setdefault(i // 50, [0, 0])
        if v not in seen:
            c[0 if at <= filled else 1] += 1
        filled |= at
        seen.add(v)
    df = spark.createDataFrame([*rows, (None, "x"), (7, None)], "s long, v string")
    got = {r["batch"]: r for r in sk.bloom_rates(sk.stream(df, "s", "v", 50), k, bits).collect()}
    assert {b: [r["false_positives"], r["true_negatives"]] for b, r in got.items()} == want
    assert all((r["fpr"] is None) == (sum(want[b]) == 0) for b, r in got.items())


def test_distinct_estimates(spark):
    rows = stream_rows(300)
    got = {r["batch"]: r for r in sk.distinct_estimates(sk.stream(spark.createDataFrame(rows, "s long, v string"), "s", "v", 100)).collect()}
    for b in range(3):
        values = {v for i, v in rows if i // 100 == b}
        zeros = lambda h: 0 if h == 0 else (h & -h).bit_length() - 1
        p = sorted(2.0 ** max(zeros((a * (md5_number(v) % P) + c) % P) for v in values) for a, c in sk.FM_FAMILY)
        groups = [p[j * 7 : j * 7 + 7] for j in range(13)]
        assert got[b]["n_distinct"] == len(values) and abs(got[b]["estimate"] - median(sum(x) / 7 for x in groups)) <= 0.5


def test_reservoir_slots_equal_a_reservoir(spark):
    rows, size = stream_rows(300), 10
    got = sk.reservoir_slots(sk.stream(spark.createDataFrame(rows, "s long, v string"), "s", "v", 60), size, (0, 5)).orderBy("batch").collect()
    slots, at = {}, []
    for t, (i, v) in enumerate(rows, 1):
        if t <= size:
            slots[t - 1] = v
        elif (md5_number(f"a{t}") % P) % t < size:
            slots[(md5_number(f"s{t}") % P) % size] = v
        if i % 60 == 59:
            at.append((t, slots.get(0), slots.get(5)))
    assert [(r["seen"], r["slot_0"], r["slot_5"]) for r in got] == at
    few = sk.reservoir_slots(sk.stream(spark.createDataFrame(rows[:3], "s long, v string"), "s", "v", 60), size, (0, 5)).first()
    assert (few["slot_0"], few["slot_5"]) == (rows[0][1], None)


def test_simulated_stream(spark):
    df = spark.range(0, 37, 1, 5).withColumn("v", F.concat(F.lit("v"), "id"))
    assert sorted(r["row_no"] for r in sk.dense_index(df).collect()) == list(range(37))
    got = sk.simulated_stream(df, "v", 50, 8, seed=1).collect()
    assert len(got) == 400 and {r["batch"] for r in got} == set(range(8)) and len({r["seq"] for r in got}) == 400
    counts = [sum(r["value"] == f"v{i}" for r in got) for i in range(37)]
    assert min(counts) > 0 and max(counts) < 30
    assert sorted(map(str, got)) == sorted(map(str, sk.simulated_stream(df, "v", 50, 8, seed=1).collect()))
    assert sk.simulated_stream(df.limit(0), "v", 50, 8).count() == 0


def test_hash_count():
    assert sk.hash_count(100, 10) == 7 and sk.hash_count(10, 1000) == 1


@pytest.fixture
def event_files(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 40} 00:{i % 40:02d}:00", f"k{i % 3}") for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, at string, k string").withColumn("ts", F.to_timestamp_ntz("at"))
    for i in range(3):
        df.where((F.col("seq") >= i * 40) & (F.col("seq") < i * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    return str(tmp_path / "e"), rows


def name():
    return "t" + uuid.uuid4().hex


def test_windows_and_sessions(spark, event_files):
    path, rows = event_files
    counts = live.replay(live.windowed_counts(live.parquet_stream(spark, path), "ts", "k"), name(), "complete").collect()
    assert sum(r["n"] for r in counts) == 120 and len(counts) == 9
    sliding = live.replay(live.windowed_counts(live.parquet_stream(spark, path), "ts", "k", "2 days", slide="1 day"), name(), "complete").collect()
    assert sum(r["n"] for r in sliding) == 240
    sessions = live.replay(live.session_counts(live.parquet_stream(spark, path), "ts", "k", "1 hour"), name(), "complete").collect()
    assert len(sessions) == 9 and sum(r["n"] for r in sessions) == 120


def test_live_sketches(spark, event_files):
    path, rows = event_files
    s = live.parquet_stream(spark, path)
    seen = {r["seq"]: r["maybe_seen"] for r in live.replay(live.bloom_seen(s, "k", "seq", bits=10_000), name()).collect()}
    assert seen == {i: i >= 3 for i in range(120)}
    updates = live.replay(live.reservoir(s, "seq", "seq", size=4, shards=2), name(), "update")
    last = {}
    for r in updates.collect():
        last[r["shard"]] = max(last.get(r["shard"], 0), r["seen"])
    assert sum(last.values()) == 120 and all(r["slot"] < 4 for r in updates.collect())
    one = live.merged_reservoir(updates, 4).collect()
    held = {r["value"] for r in live.last_reservoirs(updates).collect()}
    assert len(held) == 8 and len({r["value"] for r in one}) == 4 and {r["value"] for r in one} <= held and {r["seen"] for r in one} == {120}
    split = live.batch_estimates(s.withColumn("b", F.floor(F.col("seq") / 60)), "seq", "b", name()).collect()  # batches over the ends of files
    assert sorted((r["batch"], r["n_distinct"]) for r in split) == [(0, 60), (1, 60)]
    est = live.batch_estimates(s.withColumn("b", F.floor(F.col("seq") / 40)), "k", "b", name()).collect()
    assert sorted(r["batch"] for r in est) == [0, 1, 2] and {r["n_distinct"] for r in est} == {3}


def test_bloom_state_equals_a_filter_asked_one_by_one():
    rng, bits = random.Random(3), 200
    state, filled = live.BloomState(bits, 3), set()
    for _ in range(5):
        numbers = [rng.randrange(2**60) if rng.random() < 0.5 else rng.randrange(20) for _ in range(40)]
        want = []
        for n in numbers:
            at = {(a * (n % P) + b) % P % bits for a, b in coefficients(3, 17)}
            want.append(at <= filled)
            filled |= at
        assert state.ask(np.array(numbers)).tolist() == want


def test_reservoir_state_is_uniform():
    got = np.zeros(60)
    for seed in range(3000):
        r = live.ReservoirState(6, seed)
        for a, b in ((0, 4), (4, 25), (25, 60)):
            r.take(np.arange(a, b))
        assert r.seen == 60 and len(set(r.slots)) == 6
        got[r.slots] += 1
    assert ((got - 300) ** 2 / 270).sum() < 60 + 4 * 120**0.5


def test_live_sketches_of_nothing(spark, event_files, tmp_path):
    spark.read.parquet(event_files[0]).limit(0).coalesce(1).write.parquet(str(tmp_path / "none"))
    s = live.parquet_stream(spark, str(tmp_path / "none"))
    assert live.replay(live.bloom_seen(s, "k", "seq", bits=100), name()).count() == 0
    assert live.replay(live.reservoir(s, "k", "seq"), name(), "update").count() == 0


def points(seed=0, k=3, n=200, d=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 30, (k, d))
    x = np.concatenate([c + rng.normal(0, 1, (n, d)) for c in centres] + [rng.normal(300, 200, (4, d))])
    return [(i, [float(v) for v in p]) for i, p in enumerate(x)], np.repeat(np.arange(k), n)


def test_summaries_merge(spark):
    rows, labels = points()
    df = spark.createDataFrame([(i, int(labels[i]), v) for i, v in rows[:600]], "id long, cluster int, vector array<double>")
    whole = {r["cluster"]: r for r in cl.summaries(df).collect()}
    parts = {r["cluster"]: r for r in cl.merge_summaries(cl.summaries(df.where("id % 2 = 0")), cl.summaries(df.where("id % 2 = 1"))).collect()}
    for c, r in whole.items():
        x = np.array([v for i, v in rows[:600] if labels[i] == c])
        assert r["n"] == len(x) == parts[c]["n"] and np.allclose(r["sum"], x.sum(0)) and np.allclose(parts[c]["sumsq"], (x**2).sum(0))
    m = {r["cluster"]: r for r in cl.centres(cl.summaries(df)).collect()}
    assert np.allclose(m[0]["std"], np.array([v for i, v in rows[:600] if labels[i] == 0]).std(0))


def test_nearest_and_gate(spark):
    of = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 0.0]), (1, [10.0, 0.0], [2.0, 1.0])], "cluster int, centre array<double>, std array<double>")
    p = spark.createDataFrame([(1, [1.0, 99.0]), (2, [9.0, 1.0]), (3, [100.0, 0.0])], "id long, vector array<double>")
    near = cl.nearest(p, of)
    got = {r["id"]: (r["cluster"], round(r["distance"], 4)) for r in near.collect()}
    assert got == {1: (0, 1.0), 2: (1, round((0.25 + 1) ** 0.5, 4)), 3: (1, 45.0)}
    assert {r["id"] for r in cl.gate(near, 2).collect()} == {1, 2}


def test_clusters_by_summaries(spark):
    rows, labels = points()
    df = spark.createDataFrame([*rows, (9999, None)], "p long, v array<double>")
    of, rounds = cl.summarised_clusters(df, "p", "v", 3)
    got = {r["id"]: r["cluster"] for r in of.collect()}
    assert set(got) == {i for i, _ in rows} and len(rounds) == 5
    assert all(sum((d, c, r)) <= len(rows) for d, _, c, r in rounds) and sum(rounds[-1][i] for i in (0, 2, 3)) == len(rows)
    for c in range(3):
        own = [got[i] for i in range(600) if labels[i] == c]
        assert max(own.count(x) for x in set(own)) > 0.95 * len(own)
    assert len({max(set(o), key=o.count) for o in ([got[i] for i in range(600) if labels[i] == c] for c in range(3))}) == 3


def test_clusters_of_nothing(spark):
    of, rounds = cl.summarised_clusters(spark.createDataFrame([], "p long, v array<double>"), "p", "v", 3)
    assert of.count() == 0 and rounds == []

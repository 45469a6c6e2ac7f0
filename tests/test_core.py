"""Ids, analytics, sources, balance."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkmine.functions.hashing import P, coefficients, linear_hashes, text_number
from sparkmine.functions.ids import calendar_day, clean_id, whole_number_id
from sparkmine.operators import analytics as a
from sparkmine.operators import balance
from sparkmine.operators.balance import fragment_replicate_join, key_statistics, pack, placed, plan_loads
from sparkmine.runtime import col, in_one_process, qualified, scratch, shared_dir, stored
from sparkmine.sources import files


def values(spark, rows, f):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(f(F.col("x"))).collect()]


def test_ids(spark):
    assert values(spark, [" a\t", "A", "\r\n", "", None, "a b "], clean_id) == ["a", "A", None, None, None, "a b"]
    given = ["07", "7.0", " 7\r", "7.", "-3", "+4", "7.5", "", None, "x", "1e3", "9" * 30, "0"]
    assert values(spark, given, whole_number_id) == [7, 7, 7, 7, -3, 4, None, None, None, None, None, None, 0]


def test_days(spark):
    given = ["2016-01-05 10:00:00", "2016/1/5", " 2016-01-05T07:17:27Z", "2016-01-05\r", "2016-02-30", "0000-00-00", "20160105", None, "", "2016-01-055"]
    assert values(spark, given, calendar_day) == ["2016-01-05"] * 4 + [None] * 6


def test_linear_hashes(spark):
    cs = coefficients(5, 1)
    x, h = spark.createDataFrame([("abc",)], "x string").select(text_number(F.col("x")), linear_hashes(text_number(F.col("x")), cs)).first()
    assert h == [(c * (x % P) + d) % P for c, d in cs]


def test_counts_and_top(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", None), (None, 3), ("a", 4)], "`k.1` string, v int")
    assert a.count_rows(df).first()[0] == 6 and a.count_where(df, F.col("v") > 1).first()[0] == 4
    assert a.count_different(df, "k.1").first()[0] == 3 and a.count_different(df, "k.1", "v").first()[0] == 3
    assert [tuple(r) for r in a.top_k(df, "k.1", 2).collect()] == [("a", 2), ("b", 2)]
    assert sorted(r["k.1"] for r in a.top_groups(a.group_count(df.where("v is not null and `k.1` is not null"), "k.1"), "n").collect()) == ["a", "b"]
    assert {r["k.1"]: r["mean"] for r in a.group_mean(df, "k.1", "v").collect()} == {"a": 2.5, "b": 2.0, "c": None, None: 3.0}
    assert [tuple(r) for r in a.at_least(df, "k.1", "v", 1).collect()] == [("a", 2)]
    assert a.top_k(df.limit(0), "k.1").count() == 0


def test_partition_profile(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    own = a.partition_profile(df, 4, "k").collect()
    assert sum(r["n_items"] for r in own) == 100 and len(own) <= 4
    assert sum(r["n_items"] for r in a.partition_profile(df.repartition(3)).collect()) == 100


def test_report(spark):
    df = spark.createDataFrame([("u1", "b1", "2018-01-01"), ("u1", "b2", "2017-01-01"), (None, "b2", None)], "u string, b string, d string")
    r = a.report(df, "u", "b", F.coalesce(F.substring("d", 1, 4) == "2018", F.lit(False)), 1).first()
    assert (r["n_review"], r["n_review_in"], r["n_user"], r["n_item"]) == (3, 1, 1, 2)
    assert [tuple(x) for x in r["top_user"]] == [("u1", 2)] and [tuple(x) for x in r["top_item"]] == [("b2", 2)]


def test_stored_reads_back(spark):
    df = stored(spark.createDataFrame([(1, None, [1.5])], "a int, b string, c array<double>"))
    assert df.collect() == [(1, None, [1.5])]


def test_scratch_tables_go(spark):
    with scratch():
        df = stored(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "r1", "stars": 4.0, "date": "2018-01-01"}\nnot json\n{"user_id": "u"}\n')
    r = files.read_json_lines(spark, str(tmp_path / "r.json"), files.REVIEW).collect()
    assert [x["review_id"] for x in r] == ["r1", None, None] and r[2]["user_id"] == "u"
    (tmp_path / "t.csv").write_text('"a","b","c","d","e","f"\n"5/1","9","x, y","","","0042"\n"5/1","9","z","","","n"\n')
    assert files.read_transactions(spark, str(tmp_path / "t.csv")).collect() == [("5/1-9", "42")]
    (tmp_path / "x.csv").write_text("user_id,business_id\nu1,b1\nuser_id,business_id\n")
    got = files.without_headers(files.read_csv(spark, str(tmp_path / "x.csv"), files.BASKET))
    assert got.collect() == [("u1", "b1")]
    (tmp_path / "p.csv").write_text("0,3,1.5,2\n1,4,0,-1\n")
    assert files.read_points(spark, str(tmp_path / "p.csv"), 2).collect() == [(0, 3, [1.5, 2.0]), (1, 4, [0.0, -1.0])]
    files.write_csv(got, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), files.BASKET).collect() == [("u1", "b1")]
    files.write_json(got, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).select("user_id", "business_id").collect() == [("u1", "b1")]
    assert json.loads(files.document(got).first()[0]) == {"user_id": "u1", "business_id": "b1"}
    files.write_report(files.document(got), str(tmp_path / "text"))
    assert files.read_text(spark, str(tmp_path / "text")).count() == 1


def test_report_lines(spark):
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "items array<string>, size int")
    assert [r[0] for r in files.itemset_lines(sets).collect()] == ["('a'),('b')", "('a', 'b')"]
    c = spark.createDataFrame([(2, ["a", "b"]), (1, ["c"])], "size int, members array<string>")
    assert [r[0] for r in files.community_lines(c).collect()] == ["'c'", "'a', 'b'"]
    e = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, betweenness double")
    assert [r[0] for r in files.edge_lines(e).collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]


def test_csv_keeps_odd_fields(spark, tmp_path):
    rows = [(" a ", 'say "x", y'), ("x", None), ("line\nend", "tab\t"), ("\\", "'"), (None, "b")]
    df = spark.createDataFrame(rows, files.BASKET)
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(str, files.read_csv(spark, str(tmp_path / "c"), files.BASKET).collect())) == sorted(map(str, df.collect()))
    files.write_csv(df.limit(0), str(tmp_path / "e"))
    assert files.read_csv(spark, str(tmp_path / "e"), files.BASKET).count() == 0


def test_two_phase_and_clustering_reports(spark):
    c = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2), (["a", "c"], 2)], "items array<string>, size int")
    f = c.where("size = 1")
    assert [r[0] for r in files.two_phase_lines(c, f).collect()] == ["Candidates:", "('a'),('b')", "", "('a', 'b'),('a', 'c')", "", "Frequent Itemsets:", "('a'),('b')"]
    m = spark.createDataFrame([(10, -1), (2, 3)], "id long, cluster int")
    assert [r[0] for r in files.clustering_lines([(1, 2, 3, 4)], m).collect()] == ["The intermediate results:", "Round 1: 1,2,3,4", "", "The clustering results:", "2,3", "10,-1"]


def test_partition_and_sort_studies(spark):
    df = spark.range(0, 100, 1, 5).selectExpr("id % 7 k", "id v")
    got = {r["kind"]: r for r in a.partition_study(df, "k", 3).collect()}
    assert got["default"]["n_items"] == [20] * 5 and got["custom"]["n_partition"] <= 3 and all(r["n_total"] == 100 and r["exe_time"] > 0 for r in got.values())
    top = a.sort_study(df.selectExpr("v div 2 s", "concat('n', v) n"), "s", "n", 3).collect()
    assert [r["top"] for r in top] == [["n98", "n99", "n96"]] * 2
    assert {tuple(r) for r in a.placed_profile(df, 4, F.col("v") % 4).collect()} == {(i, 25) for i in range(4)}


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    assert in_one_process("local") and in_one_process("local[8]") and not in_one_process("local-cluster[2,1,512]") and not in_one_process("yarn")

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError):
        shared_dir(Session)
    Session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert shared_dir(Session) == "hdfs://x/y"
    assert qualified(spark, "/tmp/x") == "file:///tmp/x"


def test_bin_packing():
    to, full = pack([9, 1, 5, 4, 3, 2], 2)
    assert sorted(full) == [12, 12] and len(to) == 6


def review_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        b = "hot" if rng.random() < 0.4 else f"b{rng.randrange(40)}"
        u = "big" if rng.random() < 0.3 else f"u{rng.randrange(50)}"
        rows.append((f"r{i}", rng.choice([u, u, u, None]), rng.choice([b, b, b, None]), float(rng.randrange(1, 6)) if rng.random() < 0.9 else None, 1))
    rows += [(r, u, b, 5.0, 2) for r, u, b, _, _ in rows[:40]] + rows[:30] + [(None, "u1", "hot", 1.0, 1), ("only", None, None, 2.0, 1)]
    return rows


def test_key_statistics(spark):
    rows = review_rows()
    df = spark.createDataFrame(rows, "rid string, u string, b string, stars double, key int").withColumn("field", F.lit(1)).repartition(3)
    got = {(r["field_name"], r["key_value"]): r for r in key_statistics(df, [("b", "u"), ("u", "b")], "rid", "stars", "key", tasks=4).collect()}
    last = {}
    for r, u, b, s, v in rows:
        if r is not None and (r not in last or (v, s if s is not None else -1) > last[r][2:]):
            last[r] = (u, b, v, s if s is not None else -1)
    want = {}
    for u, b, _, s in last.values():
        for f, k, o in (("b", b, u), ("u", u, b)):
            if k is not None:
                want.setdefault((f, k), []).append((s, o))
    assert set(got) == set(want)
    for k, v in want.items():
        stars = [s for s, _ in v if s >= 0]
        assert got[k]["n_records"] == len(v) and got[k]["n_total"] == len(last)
        assert got[k]["n_counterparts"] == len({o for _, o in v if o is not None})
        assert (got[k]["mean_value"] is None and not stars) or abs(got[k]["mean_value"] - sum(stars) / len(stars)) < 1e-9
    assert key_statistics(df.limit(0), [("b", "u")], "rid", "stars", tasks=4).count() == 0


def test_load_is_balanced(spark):
    # one key holds half of the rows, another a fifth
    rows = [("f", "hot", str(i)) for i in range(5000)] + [("f", "warm", str(i)) for i in range(2000)] + [("f", f"k{i % 300}", str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "field string, key string, other string")
    plan = plan_loads(df.select("field", "key"), 8)
    assert {k for _, k in plan.split} == {"hot", "warm"} and sum(plan.load) == 10_000
    sizes = [r[1] for r in placed(df, plan, F.col("other")).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 8 and max(sizes) < 1.35 * 10_000 / 8


def test_join_is_balanced_and_replicates_only_to_split_keys(spark):
    big = spark.range(20_000).selectExpr("case when id % 2 = 0 then 'hot' else concat('k', id % 700) end k", "id v")
    side = spark.range(700).selectExpr("concat('k', id) k", "id w").unionByName(spark.sql("select 'hot' k, -1L w"))
    j = fragment_replicate_join(big, side, "k", tasks=8)
    sizes = [r[1] for r in j.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 8 and max(sizes) < 1.35 * 20_000 / 8
    plan = plan_loads(big.selectExpr("'' field", "k key"), 8)
    copies = placed(big.limit(0).selectExpr("'' field", "k key", "v"), plan, F.col("v"), side.selectExpr("'' field", "k key", "w")).groupBy("key").count().where("count > 1").collect()
    assert [(r["key"], r["count"]) for r in copies] == [("hot", len(plan.split["", "hot"]))]
    assert "SortMergeJoin" not in j._jdf.queryExecution().executedPlan().toString()


def test_load_is_what_is_placed(spark):
    # one key with very many records but one counterpart is one row to place, and isn't split
    df = spark.range(5000).selectExpr("concat('r', id) r", "'once' u", "case when id < 4000 then 'hot' else concat('b', id) end b", "1.0 s")
    plans = []
    original = balance.plan_loads
    balance.plan_loads = lambda *a: plans.append(original(*a)) or plans[-1]
    try:
        got = {r["key_value"]: r for r in key_statistics(df, [("b", "u")], "r", "s", tasks=4).collect()}
    finally:
        balance.plan_loads = original
    assert not plans[0].split and got["hot"]["n_records"] == 4000 and got["hot"]["n_counterparts"] == 1


def test_sides_reach_every_key(spark):
    df = spark.range(3000).selectExpr("concat('r', id) r", "concat('u', id) u", "case when id % 2 = 0 then 'hot' else concat('b', id % 9) end b", "1.0 s")
    side = spark.createDataFrame([("hot", 3.0), ("hot", 4.0), ("b1", None), ("b3", 2.0), ("none", 1.0), (None, 5.0)], "`i.d` string, listed double")
    got = {r["key_value"]: r for r in key_statistics(df, [("b", "u")], "r", "s", tasks=4, sides={"b": (side, "i.d", "listed")}).collect()}
    assert got["hot"]["listed_value"] == 4 and got["b3"]["listed_value"] == 2 and got["b1"]["listed_value"] is None and "none" not in got
    assert sum(r["n_records"] for r in got.values()) == 3000 and got["hot"]["n_counterparts"] == 1500


@pytest.mark.parametrize("how", ["inner", "left"])
def test_fragment_replicate_join(spark, how):
    big = [("hot" if i % 2 else f"k{i % 17}", i, "x") for i in range(400)] + [(None, -1, "x")]
    small = [("hot", 1, "p"), ("hot", 2, "q"), ("k3", 3, "r"), ("zz", 4, "s"), (None, 5, "t"), ("k4", 6, None)]
    b = spark.createDataFrame(big, "`the.key` string, v int, shard string")
    s = spark.createDataFrame(small, "`the.key` string, V int, a string")
    got = fragment_replicate_join(b, s, "the.key", how, tasks=4)
    want = b.join(s, b["`the.key`"] == s["`the.key`"], how).select(b["`the.key`"], b["v"], b["shard"], s["V"], s["a"])
    assert got.columns == ["the.key", "v", "shard", "V_", "a"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert fragment_replicate_join(b.limit(0), s, "the.key", how, tasks=4).count() == 0
    with pytest.raises(ValueError):
        fragment_replicate_join(b, s, "the.key", "full")


def test_names_with_dots(spark):
    assert spark.createDataFrame([(1,)], "`a.b``c` int").select(col("a.b`c")).first()[0] == 1

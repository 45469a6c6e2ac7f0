"""Packing, leaks and reading levels."""

import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmine.llm import leakage, queries
from sparkmine.llm.leakage import leaked_items
from sparkmine.llm.packing import fill, pack_sizes, packed, token_counter, token_sizes
from sparkmine.llm.readability import N_FEATURES, _graded, features, fit, is_english, isotonic, measured, reading_levels, word_class
from sparkmine.llm.words import word_spans, words
from sparkmine.sources.tables import table

TOKENIZERS = "/opt/tokenizers/"


def check_packing(rows, sizes, capacity):
    """Whole items once, pieces only above the capacity, nothing overlaps or overflows."""
    by_item, by_container = {}, {}
    for r in rows:
        by_item.setdefault(r["item"], []).append(r)
        if r["container"] is not None:
            by_container.setdefault(r["container"], []).append((r["place"], r["piece_size"]))
    assert set(by_item) == set(sizes)
    for i, n in sizes.items():
        ps = sorted(by_item[i], key=lambda r: r["piece"])
        assert sum(p["piece_size"] for p in ps) == (n or 0)
        assert len(ps) == max(1, -(-(n or 0) // capacity))
        assert [p["piece_start"] for p in ps] == [k * capacity for k in range(len(ps))]
        assert all((p["container"] is None) == (not n) for p in ps)
    for c in by_container.values():
        at = 0
        for place, n in sorted(c):
            assert place == at
            at += n
        assert at <= capacity


@pytest.mark.parametrize("group_items", [10, 8192])
def test_packing(spark, group_items):
    rng = random.Random(1)
    sizes = {i: rng.choice([1, 5, 40, 99, 100, 101, 250, 300, rng.randrange(1, 90)]) for i in range(300)} | {900: 0, 901: None}
    df = spark.createDataFrame(list(sizes.items()), "id long, n long").withColumn("group", F.lit("x")).withColumn("item", F.lit(1))
    got = packed(df, "id", "n", 100, group_items=group_items)
    check_packing(got.collect(), sizes, 100)
    assert fill(got, 100).first()["share_used"] > (0.75 if group_items == 10 else 0.95)
    assert packed(df.limit(0), "id", "n").count() == 0


def test_repeated_ids_are_packed_in_parallel(spark):
    df = spark.range(60_000).selectExpr("cast(null as long) i", "1 + id % 90 n")
    began = time.time()
    got = packed(df, "i", "n", 100).where("container is not null")
    assert got.count() == 60_000 and time.time() - began < 30
    assert got.select(F.expr("container div 2 div 4294967296").alias("g")).distinct().count() == 8
    assert got.groupBy("container").agg(F.sum("piece_size").alias("s")).agg(F.max("s")).first()[0] <= 100


def test_containers_are_balanced_in_cost():
    sizes = np.array([50] * 10 + [10] * 50)
    to, at = pack_sizes(sizes, 100, 1.0, 0.01)
    cost = np.bincount(to, weights=sizes + 0.01 * sizes**2)
    assert len(cost) == 10 and cost.max() - cost.min() < 1e-9
    assert pack_sizes(np.array([100, 1]), 100, 1.0, 0.0)[0].tolist() == [0, 1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_sizes(spark, name):
    texts = [(1, "Hello world, hello!"), (2, ""), (3, None), (4, "word " * 60_000), (5, "é😋 <|endoftext|>"), (1, "again")]
    got = token_sizes(spark.createDataFrame(texts, "id long, text string"), "id", "text", TOKENIZERS + name).collect()
    count = token_counter(TOKENIZERS + name)
    assert sorted((r["item"], r["n_tokens"]) for r in got) == sorted((i, count(t) if t else 0) for i, t in texts)
    assert count("word " * 60_000) >= 60_000


def test_two_tokenizers_of_one_vocabulary_agree():
    a, b = token_counter(TOKENIZERS + "byte_bpe_50k.tiktoken"), token_counter(TOKENIZERS + "byte_bpe_50k.json")
    for t in ("Hello world", "I can't, won't  and   shan't\n\nok", "naïve café 😋 12345", "x" * 3000):
        assert a(t) == b(t)


@pytest.mark.parametrize("text", [" " * 25_000, "a" + "\n" * 30_000 + "b", "x  " + " \t" * 20_000 + "word " + " " * 21_000 + "9", "é" + "\u3000" * 20_001 + "!"])
def test_long_blanks_count_as_in_one_piece(text):
    a, b = token_counter(TOKENIZERS + "byte_bpe_50k.tiktoken"), token_counter(TOKENIZERS + "byte_bpe_50k.json")
    assert a(text) == b(text)


def test_megabytes_of_blanks():
    assert token_counter(TOKENIZERS + "byte_bpe_50k.tiktoken")(" " * 3_000_000 + "x" + "\n" * 2_000_000) > 0


def test_documents_are_packed_well(spark, small):
    sizes = {r["item"]: r["n_tokens"] for r in token_sizes(table(spark, small, "documents"), "doc_id", "text", queries.VOCABULARY).collect()}
    got = queries.p8_packed(spark, small).withColumnRenamed("doc_id", "item")
    check_packing(got.collect(), sizes, 2048)
    assert fill(got).first()["share_used"] > 0.9


def test_words():
    assert words("Ｆｕｌｌ width co­op zero​width don't_stop ½ ﬁne") == ["full", "width", "coop", "zerowidth", "don", "t", "stop", "1", "2", "fine"]
    text = "A­b  ﬁne Ça, É1"
    assert [text[a:b] for a, b in word_spans(text)] == ["A­b", "ﬁne", "Ça", "É1"]


def brute_leaks(docs, items, run):
    out = set()
    for d, t in docs:
        w = words(t or "")
        have = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, p in items:
            q = words(p or "")
            if any(tuple(q[j : j + run]) in have for j in range(len(q) - run + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block_chars, held_chars", [(10**7, 0), (200, 10**7), (200, 1)])
def test_leaks_equal_brute_force(spark, block_chars, held_chars):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 30)))) for i in range(25)] + [(25, None), (26, ""), (27, "one two")]
    items.append((28, items[3][1]))
    docs = []
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120]))]
        if d % 3 == 0:
            p = rng.choice(items[:25])[1].split()
            at = rng.randrange(len(w))
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in p[rng.randrange(max(1, len(p) - 5)) :]]
        docs.append((d, rng.choice([" ", ", ", "\n- "]).join(w)))
    docs += [(60, None), (61, ""), (62, "x " * 50_000 + items[0][1]), (0, docs[0][1])]
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*i, "q", None) for i in items], "item_id long, text string, question string, answer string")
    got = leaked_items(a, "doc_id", "text", b, "item_id", "text", "question", "answer", run=5, block_chars=block_chars, held_chars=held_chars)
    long = [r for r in got.collect() if r["part"] == "passage" and r["longest_run"] >= 5]
    assert {(r["doc_id"], r["item_id"]) for r in long} == brute_leaks(docs, items, 5)
    assert got._jdf.queryExecution().toString().count("MapInArrow") == 4  # one scan of the texts in each of its four plans
    short = [i for i in items if 0 < len(words(i[1] or "")) < 5]
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["part"] == "passage" and r["longest_run"] < 5} == {(d, i) for i, p in short for d, _ in brute_leaks(docs, [(i, p)], len(words(p)))}
    assert leaked_items(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leaked_items(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0


def test_leaks_of_parts_and_offsets(spark):
    text = "Intro. <b>One two three FOUR five</b> six! And: is the red door open now? Yes ­ maybe it is so."
    docs = spark.createDataFrame([(1, text)], "d long, t string")
    items = spark.createDataFrame([(7, "zero one two three four five b six", "Is the red door open now?", "maybe it is"), (8, None, None, "Yes maybe it is so")], "i long, p string, q string, a string")
    got = {(r["item_id"], r["part"]): r for r in leaked_items(docs, "d", "t", items, "i", "p", "q", "a", run=4).collect()}
    assert set(got) == {(7, "passage"), (7, "question"), (7, "answer"), (8, "answer")}
    assert got[7, "answer"]["longest_run"] == 3 and all(r["supported"] for r in got.values())
    cut = lambda r: text[r["start"] : r["end"]]
    assert cut(got[7, "passage"]) == "One two three FOUR five</b> six" and got[7, "passage"]["longest_run"] == 7
    assert cut(got[7, "question"]) == "is the red door open now" and cut(got[8, "answer"]) == "Yes ­ maybe it is so"


def test_a_short_passage_leaks_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "They said: The Quick brown fox, jumps over lazy dogs!"), (2, "the quick brown fox jumps over"), (3, "yes")], "d long, t string")
    items = spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs", "what jumps over?", "yes")], "i long, p string, q string, a string")
    got = {(r["d"] if "d" in r else r["doc_id"], r["part"]): (r["longest_run"], r["supported"]) for r in leaked_items(docs, "d", "t", items, "i", "p", "q", "a").collect()}
    assert got == {(1, "passage"): (8, False), (3, "answer"): (1, False)}


def test_a_short_passage_repeated_is_no_long_run():
    machine = leakage.Automaton([("one two three four five six", None, None)], 12)
    ws = words("one two three four five six " * 2)
    assert machine.hits(ws, leakage.numbered(ws)) == {(0, 0): [(0, 5), (6, 11)]}


def test_words_of_one_number_do_not_match(spark, monkeypatch):
    monkeypatch.setattr(leakage, "numbered", lambda ws: tuple(len(w) for w in ws))
    docs = spark.createDataFrame([(1, "aa bb cc dd"), (2, "xx bb cc dd")], "d long, t string")
    machine = leakage.Automaton([("aa bb cc", None, None)], 3)
    assert [set(machine.hits(words(t), leakage.numbered(words(t)))) for _, t in docs.collect()] == [{(0, 0)}, set()]


def test_found_leaks_equal_brute_force_on_the_tables(spark, small):
    docs = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, small, "eval_item").select("item_id", "text").collect()]
    assert {tuple(r) for r in queries.p9_found(spark, small).collect()} == brute_leaks(docs, items, 12)


def test_short_questions_and_answers_leak(spark, tmp_path):
    texts = {"short": "It cost $27.95, and the BARBER was\nnoisy.", "none": "The barber was not noisy: 27 and 95.", "one": "no", "empty": "", "null": None}
    docs = [(i, t) for i, t in enumerate(texts.values())]
    items = [(10, "p", "No?", "$27.95"), (11, None, "?!", "The barber was noisy."), (12, "p", None, "$27.95"), (13, "p", "", None), (14, "p", "cost 27 95 and the barber", "barber was noisy")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, question string, answer string").write.parquet(f"{tmp_path}/eval_item.parquet")
    holds = lambda t, p: bool(words(p or "")) and f" {' '.join(words(p))} " in f" {' '.join(words(t or ''))} "
    want = {(d, i, part, len(words(p))) for d, t in docs for i, _, q, a in items for part, p in (("question", q), ("answer", a)) if holds(t, p)}
    assert {(0, 10, "answer", 2), (0, 11, "answer", 4), (2, 10, "question", 1)} <= want
    got = queries.p9_leaks(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["part"], r["longest_run"]) for r in got} == want and len(got) == len(want)


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 5]))
    assert x.tolist() == [1, 2.5, 4] and y.tolist() == [1, 2.5, 5]


def test_features_of_odd_texts():
    assert features(None) == (0, None) and features("") == (0, None) and features("... !!") == (0, None)
    n, f = features("One.")
    assert n == 1 and np.isfinite(f).all()
    n, f = features("word " * 200_000)
    assert n == 200_000 and np.isfinite(f).all()
    assert np.isfinite(features("<p></p>")[1] if features("<p></p>")[1] is not None else [0]).all()


@pytest.mark.parametrize("filling", ["\n", ".", " ", "<", "-", "\n ", "!?", "&", "\t-", "é", "<p", "\u00ad"])
def test_odd_long_texts_take_little_time(filling):
    began = time.process_time()
    text = "a b " + filling * 200_000 + " c d"
    n, f = features(text)
    assert n >= 3 and np.isfinite(f).all() and len(words(text)) == n
    word_spans(text)
    assert time.process_time() - began < 5


def test_levels_by_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    x, y = _graded(measured(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "doc_level"), "doc_id", "reading_level", 20_000)
    fold = np.random.default_rng(0).permutation(len(y)) % 4
    close, right = [], []
    for k in range(4):
        m = fit(x[fold != k], y[fold != k])
        v = m.level(m.score(x[fold == k]))
        close += list(np.abs(v - y[fold == k]) < 1)
        right += list((np.floor(v + 0.5) >= 4) == (y[fold == k] >= 4))
    assert np.mean(close) > 0.95 and np.mean(right) > 0.96


def test_levels_of_odd_rows(spark, small):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "The cat sat on the mat. " * 5, "x"), (3, "again", None), (None, "a b c", "x")], "doc_id long, text string, score string").withColumn("f", F.lit(1))
    none = spark.createDataFrame([], "id long, level int")
    got = reading_levels(docs, "doc_id", "text", none, "id", "level").collect()
    assert len(got) == 5 and all(r["reading_level"] is None for r in got)
    x, y = _graded(measured(table(spark, small, "documents"), "doc_id", "text"), table(spark, small, "doc_level"), "doc_id", "reading_level", 1000)
    got = {(r["doc_id"], r["n_words"]): r for r in reading_levels(docs, "doc_id", "text", none, "id", "level", keep=("score", "f"), model=fit(x, y)).collect()}
    assert got[3, 30]["reading_level"] in (1, 2) and got[1, 0]["reading_level"] is None
    assert reading_levels(docs.limit(0), "doc_id", "text", none, "id", "level").count() == 0


def test_rows_for_the_fit_are_bounded_by_the_labels(spark):
    docs = spark.range(3000).selectExpr("id % 2 d", "concat('some words here number ', id) t")
    labels = spark.createDataFrame([(0, 1), (1, 5), (1, 4)], "d long, l int")
    x, y = _graded(measured(docs, "d", "t"), labels, "d", "l", 100)
    assert len(x) == len(y) == 2 and sorted(y) == [1, 4.5]
    assert len(_graded(measured(docs, "d", "t"), labels, "d", "l", 1)[1]) == 1


def test_word_classes():
    of = {w: word_class(w) for w in "whereas which and between the their were information quickly walking political table cat".split()}
    assert list(of.values()) == ["subordinator", "relative", "coordinator", "preposition", "determiner", "pronoun", "auxiliary", "nominal", "adverb", "participle", "adjective", "adjective", "other"]


def test_variety_is_measured_over_the_whole_text():
    # words of one vector, so that only their variety differs, after the first 200
    a, b = (features("aaax " * 200 + " ".join(second))[1] for second in (["aaax"] * 200, [f"aa{c}{d}" for c in "bcdfghjklm" for d in "bcfghjkmnpqrtvwxzppp"]))
    assert np.flatnonzero(~np.isclose(a, b)).tolist() == [N_FEATURES - 9] and b[-9] > 0.4 > a[-9]


def test_is_english(spark):
    rows = [(x,) for x in ("en", "EN", " en-US", "en_GB", "English", "eng", "es", "", None, "enx", "fr-en")]
    got = [r[0] for r in spark.createDataFrame(rows, "l string").select(is_english(F.col("l"))).collect()]
    assert got == [True] * 6 + [False] * 5


def test_words_are_normalised():
    assert unicodedata.is_normalized("NFKC", " ".join(words("ﬀ ² Å")))

"""All similar pairs between set-valued records: exact Jaccard join by extended prefixes.

The tokens of every set are ordered from rare to frequent. Two sets whose overlap is at least o share their first k
common tokens within their prefixes of length ``size - o + k``, for every k <= o. So with k > 1 the prefixes get
longer, but a candidate must share k tokens at once; sets are joined on combinations of k prefix tokens. k is chosen for
each size class, sets of any size included: the signatures of every k are counted, and where they are few enough for that
k to win, the candidates they make are counted as well, over all sets (``_choose``). Candidates are then verified exactly.

Tokens are carried as 64-bit fingerprints. A set of n tokens is misjudged with a chance of at most n * n / 2**65, and
only if two of its own tokens collide; sets themselves keep their names.

Scale: sets with equal content make a class and are joined once, by a representative; ``similar_classes`` gives the classes
and the links between them, so a mass of copies costs one row each, and ``similar_sets`` writes out the pairs. Prefixes of
sets up to ``direct`` tokens come from a ranking per set; those of larger sets from a mergeable quantile sketch (an
over-long prefix loses nothing), so no task ever holds a giant set. Pairs of large sets are verified by a distributed
count, not by arrays. Signatures and classes that very many sets share are cut into hash blocks, whose pairs are the units of
the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import FEW, col, sent_if_few, stored

#: Largest set sizes of the size classes; the last class is open.
CLASSES = (8, 32, 128, 512, 2048, 8192)
#: Sets that share a signature, or copies in a class, in one block of the join.
BLOCK = 2048
#: What a candidate costs to deduplicate and verify, in signatures (measured).
CANDIDATE_COST = 5


def _needed(size: Column, threshold: float) -> Column:
    """The least overlap that a set of this size has with any set similar enough."""
    return F.greatest(F.lit(1), F.ceil(size * F.lit(threshold) - F.lit(1e-9))).cast("int")


def _rows(df: DataFrame, set_id: str, token: str, side: int) -> DataFrame:
    return df.select(F.lit(side).alias("side"), col(set_id).cast("string").alias("name"), col(token).cast("string").alias("token")).where("name is not null and token is not null")


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (own, t) fingerprints of sets and tokens, and the names of the sets: own, side, name. No two sets share a
    fingerprint: that is checked, and another seed taken if any do. The input is read once."""
    rows = rows.select("side", "name", F.xxhash64("token").alias("t")).distinct()
    seed = 0
    while True:
        rows = stored(rows.select(F.xxhash64(F.lit(seed), "side", "name").alias("own"), "side", "name", "t"))
        names = stored(rows.select("own", "side", "name").distinct())
        if names.groupBy("own").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return rows.select("own", "t"), names
        seed += 1


def similar_sets(df: DataFrame, set_id: str, token: str, threshold: float = 0.5, min_size: int = 1, other: DataFrame | None = None, direct: int = 100_000, in_arrays: int = 4096) -> DataFrame:
    """All pairs of sets with |A and B| / |A or B| >= threshold and at least min_size distinct tokens each.

    df holds one row per (set, token). Returns id_1, id_2, size_1, size_2, overlap, similarity. Within one table id_1 <
    id_2 in byte order; with ``other`` (same column names) id_1 is of df and id_2 of other. c copies of a set are
    c * (c - 1) / 2 pairs here; where that is too much, take ``similar_classes``.

    Rows with a null set or token do not count, repeated rows count once, similarity equal to the threshold is
    kept, sets without tokens appear in no pair, empty tables give no rows, other columns are ignored.
    direct: largest set ranked in one task. in_arrays: largest set compared as an array.
    """
    sets, pairs, copies = _similar(df, set_id, token, threshold, min_size, other, direct, in_arrays)
    a, b = (sets.select(F.col("set").alias(k), F.col("name").alias(f"name_{k}"), F.col("side").alias(f"side_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    columns = ["overlap", "name_a", "side_a", "size_a", "name_b", "side_b", "size_b"]
    both = pairs.join(a, "a").join(b, "b").select(*columns)
    counts = sets.groupBy(F.col("set").alias("key")).agg(F.count("*").alias("f")) if copies > BLOCK else None
    x, y = _blocked(sets.select(F.col("set").alias("key"), "own", "name", "side", "size"), counts, "own")
    alike = x.join(y, ["key", "lo", "hi"]).where("block_a != block_b or lo = hi").where("side_a < side_b or (side_a = side_b and name_a < name_b)")
    both = both.unionByName(alike.withColumn("overlap", F.col("size_a").cast("long")).select(*columns))
    if other is not None:
        both = both.where("side_a != side_b")
        first = F.col("side_a") == 0
    else:
        first = F.col("name_a") < F.col("name_b")
    pick = lambda what, i: F.when(first, F.col(f"{what}_{'ab'[i]}")).otherwise(F.col(f"{what}_{'ba'[i]}"))
    return both.select(
        pick("name", 0).alias("id_1"), pick("name", 1).alias("id_2"), pick("size", 0).alias("size_1"), pick("size", 1).alias("size_2"), "overlap",
        (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("similarity"),
    )


def similar_classes(df: DataFrame, set_id: str, token: str, threshold: float = 0.5, min_size: int = 1, direct: int = 100_000, in_arrays: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The same result without writing out copies: members and links.

    Members: id, size, class_id (the least id of the sets equal to this one, itself included), class_size, n_links (the similar
    sets of this one, its copies included); one row for each set of at least min_size tokens. Links: class_1 < class_2, overlap,
    similarity; one row for each pair of similar classes. Rows in and odd cases as in ``similar_sets``.
    """
    sets, pairs, _ = _similar(df, set_id, token, threshold, min_size, None, direct, in_arrays)
    classes = stored(sets.groupBy("set").agg(F.min("name").alias("class_id"), F.count("*").alias("class_size"), F.max("size").alias("size")))
    a, b = (classes.select(F.col("set").alias(k), F.col("class_id").alias(f"class_{k}"), F.col("class_size").alias(f"n_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    linked = stored(pairs.join(a, "a").join(b, "b"))
    ends = linked.select(F.col("a").alias("set"), F.col("n_b").alias("n")).unionByName(linked.select(F.col("b").alias("set"), F.col("n_a").alias("n")))
    classes = classes.join(ends.groupBy("set").agg(F.sum("n").alias("near")), "set", "left")
    of = classes.select("set", "class_id", "class_size", (F.col("class_size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    members = sets.select("set", F.col("name").alias("id"), "size").join(of, "set").select("id", "size", "class_id", "class_size", "n_links")
    links = linked.select(F.least("class_a", "class_b").alias("class_1"), F.greatest("class_a", "class_b").alias("class_2"), "overlap", (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("similarity"))
    return members, links


def _similar(df: DataFrame, set_id: str, token: str, threshold: float, min_size: int, other: DataFrame | None, direct: int, in_arrays: int) -> tuple[DataFrame, DataFrame, int]:
    """The sets (own, side, name, size, set: their representative), the similar pairs of representatives (a, b, overlap), and the
    most copies of a set."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = _rows(df, set_id, token, 0)
    if other is not None:
        rows = rows.unionByName(_rows(other, set_id, token, 1))
    base, names = _numbered(rows)

    # sets of equal content share a representative
    content = [F.count("*").cast("int").alias("size"), F.bit_xor("t").alias("c1"), F.bit_xor(F.xxhash64(F.col("t"), F.lit(1))).alias("c2")]
    sets = stored(base.groupBy("own").agg(*content).where(F.col("size") >= min_size).join(names, "own"))
    alike = ["size", "c1", "c2"]  # two fingerprints of 64 bits
    reps = sets.groupBy(*alike).agg(F.min("own").alias("set"), F.min("side").alias("side_1"), F.max("side").alias("side_2"))
    sets = stored(sets.join(reps, alike).select("own", "side", "name", "size", "set"))
    reps = reps.select(F.col("set").alias("own"), "set", "size", F.expr("shiftleft(1, side_2) | shiftleft(1, side_1)").alias("sides"))
    most = sets.groupBy("set").agg(F.count("*").alias("f"), F.max("size").alias("size")).agg(F.max("f").alias("f"), F.max("size").alias("size")).first()
    toks = _in_order(base, reps, threshold, direct, (most["size"] or 0) > direct)
    return sets, _verified(toks, stored(_candidates(toks, threshold, other is not None)), threshold, in_arrays), most["f"] or 0


def _blocked(df: DataFrame, counts: DataFrame | None, by: str) -> tuple[DataFrame, DataFrame]:
    """df(key, ...) for a join with itself on key, where a key may be very frequent: two frames to be joined on (key, lo, hi),
    other columns and block with the suffixes _a and _b. counts: key, f of the keys that may have more than BLOCK rows.

    The rows of a key with more than BLOCK rows are dealt into hash blocks; a row meets those of each other block once,
    under the numbers of the two (lo < hi), and those of its own (lo = hi), so each pair of rows meets just once, where
    ``block_a != block_b or lo = hi`` holds.
    """
    n = 0
    if counts is not None:
        large = stored(counts.where(F.col("f") > BLOCK).select("key", F.ceil(F.col("f") / BLOCK).cast("int").alias("blocks")))
        n = large.count()
    if n:
        df = df.join(sent_if_few(large, n), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        df = df.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
        df = df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).drop("blocks", "with")
    else:
        df = df.withColumns({"block": F.lit(0), "lo": F.lit(0), "hi": F.lit(0)})
    mine = [c for c in df.columns if c not in ("key", "lo", "hi")]
    a, b = (df.select("key", "lo", "hi", *(F.col(c).alias(f"{c}_{x}") for c in mine)) for x in "ab")
    return a, b


def _in_order(base: DataFrame, reps: DataFrame, threshold: float, direct: int, any_large: bool) -> DataFrame:
    """set, size, sides, t, at: the tokens that sets may share, with the least k for which they are in their set's prefix.

    Tokens are ordered by the number of sets that have them, then by t (signed), in sets of every size. Those of one set only can't be shared; they lead
    every prefix, so it is enough to count them.
    """
    often = base.groupBy("t").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    need = _needed(F.col("size"), threshold)
    large = reps.where(F.col("size") > direct)
    n_large = large.count() if any_large else 0  # at most rows / direct
    small = base.join(sent_if_few(large.select("own"), n_large), "own", "left_anti") if n_large else base
    by_set = W.partitionBy("own")
    small = small.join(often, "t").join(reps.where(F.col("size") <= direct), "own")
    small = small.select("*", F.row_number().over(by_set.orderBy("df", "t")).alias("row"), F.count("*").over(by_set).alias("kept")).where(F.col("kept") >= need)
    # place in the whole order is size - kept + row; in the prefix for k if place <= size - need + k
    columns = ["set", "size", "sides", "t"]
    toks = small.select(*columns, F.greatest(F.lit(1), F.col("row") - F.col("kept") + need).cast("int").alias("at"))
    if n_large:
        held = base.join(sent_if_few(large, n_large), "own").join(often, "t")
        # the order of the ranking above, (df, signed t), in one number: df and the upper half of t, its least value as 0
        held = stored(held.select(*columns, (F.shiftleft(F.col("df").cast("long"), 32) + F.shiftright("t", 32) + F.lit(2**31)).alias("key")))
        # percentile_approx reads doubles, so keys are compared as such: those that round to the cut are kept
        # tokens of one set only are left out here, which moves the cut to more of the frequent ones: too long, never too short
        share = min(1.0, 1 - threshold + 4 / direct + 2e-4)  # long enough for three tokens
        cut = held.groupBy("set").agg(F.percentile_approx("key", share, 10_000).alias("cut"))
        toks = toks.unionByName(held.join(sent_if_few(cut, n_large), "set").select(*columns, F.when(F.col("key").cast("double") <= F.col("cut").cast("double"), 1).otherwise(2**30).alias("at")))
    return stored(toks)


def _classed(df: DataFrame, threshold: float, ks: dict[int, int] | None = None) -> DataFrame:
    """Every set goes into the class of its size, and into the larger ones in which a partner may be.

    With ks (the k of each class), neighbouring classes of the same k count as one, numbered by the lowest: sets then needn't
    be in both.
    """
    most = F.floor(F.col("size") / F.lit(threshold) + F.lit(1e-9))
    number = lambda n, cuts: sum((F.when(n > c, 1).otherwise(0) for c in cuts), F.lit(0))
    cuts = CLASSES
    if ks is not None:
        known = sorted(ks)
        cuts = tuple(CLASSES[c - 1] for before, c in zip(known, known[1:]) if ks[before] != ks[c])
    return df.withColumn("class", F.explode(F.sequence(number(F.col("size"), cuts), number(most, cuts)))).withColumn("home", number(F.col("size"), cuts) == F.col("class"))


def _joined(ks: dict[int, int]) -> list[int]:
    """The k of each run of neighbouring classes of the same k, as ``_classed`` numbers them."""
    runs = [ks[c] for c in sorted(ks)]
    return [k for i, k in enumerate(runs) if i == 0 or k != runs[i - 1]]


def _signatures(classed: DataFrame, classes: list[int], k: int) -> DataFrame:
    """class, home, set, size, sides, key: the combinations of k prefix tokens of the sets of these classes."""
    carried = ["class", "home", "set", "size", "sides"]
    here = classed.where(F.col("class").isin(classes) & (F.col("at") <= k))
    if k == 1:
        return here.select(*carried, F.xxhash64("class", "t").alias("key"))
    here = here.groupBy(*carried).agg(F.sort_array(F.collect_list("t")).alias("ts")).select("*", F.posexplode("ts").alias("p1", "t1"))
    for j in range(2, k + 1):
        rest = here.withColumn("rest", F.expr(f"slice(ts, p{j - 1} + 2, size(ts))")).select("*", F.posexplode("rest").alias("q", f"t{j}"))
        here = rest.withColumn(f"p{j}", F.col(f"p{j - 1}") + F.col("q") + 1).drop("rest", "q")
    return here.select(*carried, F.xxhash64("class", *(f"t{j}" for j in range(1, k + 1))).alias("key"))


def _candidates(toks: DataFrame, threshold: float, between: bool) -> DataFrame:
    """a, b, size_a, size_b: representatives that share enough prefix tokens."""
    classed = _classed(toks.where("at <= 3"), threshold)
    ks, frequent = _choose(classed, threshold)
    if not ks:
        return toks.sparkSession.createDataFrame([], "a long, b long, size_a int, size_b int")
    sigs, runs = None, _joined(ks)
    classed = _classed(toks.where("at <= 3"), threshold, ks)
    for k in sorted(set(runs)):
        part = _signatures(classed, [c for c, x in enumerate(runs) if x == k], k)
        sigs = part if sigs is None else sigs.unionByName(part)
    a, b = _blocked(sigs, sigs.groupBy("key").agg(F.count("*").alias("f")) if frequent > BLOCK else None, "set")
    # a pair belongs to the class of its larger set; sizes must be compatible
    fit = (F.col("set_a") < F.col("set_b")) & (F.col("home_a") | F.col("home_b")) & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(threshold) - F.lit(1e-9))
    if between:
        fit = fit & (F.col("sides_a").bitwiseOR(F.col("sides_b")) == 3)
    met = a.join(b, ["key", "lo", "hi"]).where(fit & F.expr("block_a != block_b or lo = hi"))
    return met.select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "size_a", "size_b").distinct()


def _met(sigs: DataFrame) -> dict[int, tuple[float, int]]:
    """For each class the pairs of sets that share a signature, counted once for each they share, and the most sets that share one."""
    f = F.col("f").cast("double")
    by = sigs.groupBy("class", "key").agg(F.count("*").alias("f")).groupBy("class").agg(F.sum(f * (f - 1) / 2).alias("met"), F.max("f").alias("most"))
    return {r["class"]: (r["met"], r["most"]) for r in by.collect()}  # one row per class


def _choose(classed: DataFrame, threshold: float) -> tuple[dict[int, int], int]:
    """The k of each class, and the most sets that share a signature then. k is that of the least cost, which is the signatures emitted, and the candidates met at CANDIDATE_COST
    each. Both are counted over all sets of the class. The candidates of a larger k are counted only where its signatures alone
    don't cost more already than the best k so far.
    """
    lens = classed.groupBy("class", "set", "size").agg(*(F.count_if(F.col("at") <= k).cast("double").alias(f"n{k}") for k in (1, 2, 3)))
    two = F.col("n2") * (F.col("n2") - 1) / 2
    three = F.col("n3") * (F.col("n3") - 1) * (F.col("n3") - 2) / 6
    emitted = lens.groupBy("class").agg(F.sum("n1").alias("e1"), F.sum(two).alias("e2"), F.sum(three).alias("e3"), F.min(_needed(F.col("size"), threshold)).alias("least"))
    rows = {r["class"]: r for r in emitted.collect()}  # one row per class
    if not rows:
        return {}, 0
    met = _met(_signatures(classed, list(rows), 1))
    best = {c: (r["e1"] + CANDIDATE_COST * met.get(c, (0.0, 0))[0], 1, met.get(c, (0.0, 0))[1]) for c, r in rows.items()}
    for k in (2, 3):
        worth = [c for c, r in rows.items() if r["least"] >= k and r[f"e{k}"] < best[c][0]]
        met = _met(_signatures(classed, worth, k)) if worth else {}
        for c in worth:
            pairs, most = met.get(c, (0.0, 0))
            best[c] = min(best[c], (rows[c][f"e{k}"] + CANDIDATE_COST * pairs, k, most))
    return {c: k for c, (_, k, _) in best.items()}, max(most for _, _, most in best.values())


def _verified(toks: DataFrame, cand: DataFrame, threshold: float, in_arrays: int) -> DataFrame:
    """a, b, overlap of the candidates that are similar enough."""
    n = cand.count()
    if n <= FEW // 2:  # the other sets are left out of the verification
        toks = toks.join(sent_if_few(cand.select(F.explode(F.array("a", "b")).alias("set")).distinct(), 2 * n), "set", "left_semi")
    fits = F.col("size_a") <= in_arrays
    near = cand.where(fits & (F.col("size_b") <= in_arrays))
    far = cand.where(~(fits & (F.col("size_b") <= in_arrays)))
    arrays = toks.where(F.col("size") <= in_arrays).groupBy("set").agg(F.collect_list("t").alias("ts"))
    near = near.join(arrays.select(F.col("set").alias("a"), F.col("ts").alias("ta")), "a").join(arrays.select(F.col("set").alias("b"), F.col("ts").alias("tb")), "b")
    near = near.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("overlap"))
    at_a = toks.select(F.col("set").alias("a"), "t")
    far = far.join(at_a, "a").join(toks.select(F.col("set").alias("b"), "t"), ["b", "t"]).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("overlap"))
    enough = F.col("overlap") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("overlap")) - F.lit(1e-9)
    return near.unionByName(far).where(enough).select("a", "b", "overlap")


"""Rating prediction: item-item Pearson neighbours, feature-based boosted trees, and their weighted mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col

FEATURES = ("item_stars", "item_reviews", "user_reviews", "user_stars")


def ratings(df: DataFrame, user: str, item: str, stars: str) -> DataFrame:
    """user, item, rating: the mean where a pair is rated several times; rows with a null are left out."""
    rows = df.select(col(user).alias("user"), col(item).alias("item"), col(stars).cast("double").alias("rating")).dropna()
    return rows.groupBy("user", "item").agg(F.avg("rating").alias("rating"))


def item_similarity(r: DataFrame, least_common: int = 30, positive_only: bool = True) -> DataFrame:
    """item_1, item_2 (both directions), n_common, similarity: Pearson correlation over the users of both, centred on
    the means over these users only.

    One equi-join on the user and one aggregation of moments, each pair once. Items with fewer raters than least_common
    can't reach it and are left out first. Pairs without variance have no similarity.
    """
    rated = r.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least_common)
    r = r.join(rated.select("item"), "item", "left_semi")
    a, b = (r.select("user", F.col("item").alias(f"item_{k}"), F.col("rating").alias(x)) for k, x in ((1, "x"), (2, "y")))
    m = a.join(b, "user").where("item_1 < item_2").groupBy("item_1", "item_2").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy")
    ).where(F.col("n") >= least_common)
    num = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    den = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    m = m.where(den > 1e-9).select("item_1", "item_2", F.col("n").alias("n_common"), (num / F.sqrt(den)).alias("similarity"))
    if positive_only:
        m = m.where("similarity > 1e-12")
    return m.unionByName(m.select(F.col("item_2").alias("item_1"), F.col("item_1").alias("item_2"), "n_common", "similarity"))


def item_means(r: DataFrame) -> DataFrame:
    return r.groupBy("item").agg(F.avg("rating").alias("item_mean"))


def predict_by_items(r: DataFrame, targets: DataFrame, sims: DataFrame) -> DataFrame:
    """user, item, prediction for the target (user, item) pairs.

    The mean of the user's ratings of similar items, weighted by similarity; without such a neighbour the item's
    mean; for an unknown item 0. The target item is not its own neighbour. Users without ratings get the item mean.
    """
    targets = targets.select("user", "item").distinct()
    near = targets.join(r.select("user", F.col("item").alias("item_2"), "rating"), "user")
    near = near.join(sims.select(F.col("item_1").alias("item"), "item_2", "similarity"), ["item", "item_2"])
    weighted = near.groupBy("user", "item").agg((F.sum(F.col("similarity") * F.col("rating")) / F.sum(F.abs("similarity"))).alias("by_items"))
    out = targets.join(weighted, ["user", "item"], "left").join(item_means(r), "item", "left")
    return out.select("user", "item", F.coalesce("by_items", "item_mean", F.lit(0.0)).alias("prediction"))


def features(pairs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """pairs (user, item, ...) with item_stars, item_reviews of items(item, ...) and user_reviews, user_stars of users(user,
    ...), by inner joins. Whether a side is broadcast is left to its measured size."""
    return pairs.join(items.select("item", "item_stars", "item_reviews"), "item").join(users.select("user", "user_reviews", "user_stars"), "user")


def fit_trees(train: DataFrame, inputs: Sequence[str] = FEATURES, label: str = "rating", **params):
    """A pipeline of filling missing features by the median, assembling them, and gradient-boosted regression trees, fitted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    options = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "seed": 1} | params
    filled = [f"{c}_filled" for c in inputs]
    fill = Imputer(strategy="median", inputCols=list(inputs), outputCols=filled)
    return Pipeline(stages=[fill, VectorAssembler(inputCols=filled, outputCol="features"), GBTRegressor(labelCol=label, **options)]).fit(train)


def predict_by_features(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("user", "item", F.col("prediction"))


def hybrid(by_items: DataFrame, by_features: DataFrame, weight: float = 0.1) -> DataFrame:
    """weight * item-based + (1 - weight) * feature-based, joined by key; the item-based one where the other is missing."""
    a = by_items.select("user", "item", F.col("prediction").alias("p1"))
    b = by_features.select("user", "item", F.col("prediction").alias("p2"))
    mix = F.col("p1") * weight + F.col("p2") * (1 - weight)
    return a.join(b, ["user", "item"], "left").select("user", "item", F.coalesce(mix, F.col("p1")).alias("prediction"))


def rmse(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n pairs with a truth, and the root mean squared error over them."""
    j = predictions.join(truth.select("user", "item", "rating"), ["user", "item"])
    return j.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"))

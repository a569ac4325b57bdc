"""A trained next-place model: which place follows the last few, by logistic regression on lags.

Features of a step are the places one, two and three steps back, each with its lag, and
the last two together; they are hashed into buckets, so the model's size does not grow
with the number of places that are only looked back at.
"""

from __future__ import annotations

from pyspark.ml.feature import FeatureHasher
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.operators import linear
from hopweave.operators.forecast import by_context, ngrams
from hopweave.operators.trajectory import collapse
from hopweave.sources.shared import written

LAGS = 3


def windows(df: DataFrame, subject: str, place: str, order: str, *carried: str, lags: int = LAGS) -> DataFrame:
    """subject, order, carried columns, lag_1 (the place itself) to lag_n, next: every row of a collapsed trajectory with n places behind it; next is null at the end."""
    w = W.partitionBy(subject).orderBy(order)
    rows = collapse(df, subject, place, order)
    before = {f"lag_{i + 1}": F.lag(place, i).over(w) if i else F.col(place) for i in range(lags)}
    return rows.select(subject, order, *carried, *(c.alias(n) for n, c in before.items()), F.lead(place).over(w).alias("next")).where(F.col(f"lag_{lags}").isNotNull())


def hashed(rows: DataFrame, lags: int = LAGS, buckets: int = linear.BUCKETS) -> DataFrame:
    """rows of windows() with the vector `features`."""
    names = [f"lag_{i + 1}" for i in range(lags)]
    both = rows.withColumn("last_two", F.concat_ws(">", "lag_2", "lag_1"))
    return FeatureHasher(inputCols=[*names, "last_two"], outputCol="features", numFeatures=buckets).transform(both).drop("last_two")


def counted(rows: DataFrame, *by: str, lags: int = LAGS) -> DataFrame:
    """lag_1 to lag_n, by, n: how many rows have each window, so that what is worked out for windows is bounded by how many differ."""
    return rows.groupBy(*(f"lag_{i + 1}" for i in range(lags)), *by).agg(F.count("*").alias("n"))


def fit(train: DataFrame, lags: int = LAGS, buckets: int = linear.BUCKETS, **how) -> linear.Classifier:
    """A classifier of `next` from rows of windows(); equal rows are one row that weighs as many."""
    return linear.fit(hashed(counted(train.where("next IS NOT NULL"), "next", lags=lags), lags, buckets), "next", weight="n", **how)


def predict(model: linear.Classifier, rows: DataFrame, k: int, lags: int = LAGS, buckets: int = linear.BUCKETS) -> DataFrame:
    """rows with best: the k likeliest next places."""
    return model.ranked(hashed(rows, lags, buckets), k)


def last_windows(rows: DataFrame, subject: str) -> DataFrame:
    """The window at each subject's end."""
    return rows.where("next IS NULL").select(subject, *(c for c in rows.columns if c.startswith("lag_")))


def next_ranked(model: linear.Classifier, rows: DataFrame, subject: str, k: int, lags: int = LAGS, buckets: int = linear.BUCKETS) -> DataFrame:
    """subject, w, prob, rank: the k likeliest places after each subject's last window; subjects with shorter ways have none."""
    last, names = last_windows(rows, subject), [f"lag_{i + 1}" for i in range(lags)]
    best = last.join(predict(model, last.select(*names).distinct(), k, lags, buckets), names)
    return best.select(subject, F.posexplode("best").alias("i", "b")).select(subject, F.col("b.label").alias("w"), F.col("b.prob").alias("prob"), (F.col("i") + 1).alias("rank"))


def compared(train: DataFrame, train_windows: DataFrame, test_windows: DataFrame, subject: str, place: str, order: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """model, n, acc_k: this model and the n-gram model, both learned from train, on the same windows with a next place.

    The n-gram model ranks each distinct pair of last places once; an unseen pair's rank is that of the place alone.
    """
    most = max(ks)
    asked = written(counted(test_windows.where("next IS NOT NULL"), "next"), "asked")
    mine = linear.accuracy(predict(fit(train_windows), asked, most), "next", ks, "n").select(F.lit("logistic").alias("model"), "*")
    grams = ngrams(train, subject, place, order)
    pairs = asked.select(F.col("lag_2").alias("c2"), F.col("lag_1").alias("c1")).distinct()
    order_ = W.partitionBy("c2", "c1").orderBy(F.desc(F.round("prob", 9)), "w")
    ranks = by_context(grams, pairs).withColumn("rank", F.row_number().over(order_)).where(F.col("rank") <= most)
    hit = asked.join(ranks.select(F.col("c2").alias("lag_2"), F.col("c1").alias("lag_1"), F.col("w").alias("next"), "rank"), ["lag_2", "lag_1", "next"], "left")
    other = linear.hit_shares(hit, F.col("rank"), ks, "n")
    return mine.unionByName(other.select(F.lit("ngram").alias("model"), "*"))

"""Multinomial logistic regression on sparse features, fitted by MLlib over all rows at once.

The model is one row of weights for each class: classes times features, which is what the
driver and the tasks hold. Classes are the most frequent labels, max_classes at most; rows
of other labels are not trained on, and count as misses where a model is evaluated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes, and buckets of hashed features, at most: 1,000 x 4,096 weights are 33 MB.
MAX_CLASSES, BUCKETS = 1000, 1 << 12


@dataclass
class Classifier:
    """A fitted model and its classes in the order of its weights; without a model the one class, if any, is certain."""

    model: LogisticRegressionModel | None
    classes: list[str]

    def ranked(self, rows: DataFrame, k: int, features: str = "features") -> DataFrame:
        """rows with best: the k likeliest labels with prob, ties at nine digits by label; no labels without training rows."""
        if not self.classes:
            return rows.drop(features).withColumn("best", F.array().cast("array<struct<label: string, prob: double>>"))
        if self.model is None:
            return rows.drop(features).withColumn("best", F.array(F.struct(F.lit(self.classes[0]).alias("label"), F.lit(1.0).alias("prob"))))
        names = F.array(*map(F.lit, self.classes))
        found = self.model.setFeaturesCol(features).transform(rows).withColumn("__p", vector_to_array("probability"))
        each = F.transform("__p", lambda p, i: F.struct((-F.round(p, 9)).alias("r"), F.get(names, i).alias("label"), p.alias("prob")))
        best = F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["label"], x["prob"]))
        return found.withColumn("best", best).select(*(c for c in rows.columns if c != features), "best")


def fit(rows: DataFrame, label: str, features: str = "features", max_classes: int = MAX_CLASSES, reg: float = 1e-3, steps: int = 60, weight: str | None = None) -> Classifier:
    """A classifier of rows with a vector of features and a label; rows without a label are not read. weight counts a row as so many.

    Minimises the mean log loss plus reg / 2 times the squared weights (not those of the
    intercepts). Sums of gradients are merged as a tree over the tasks.
    """
    rows = rows.select(features, F.col(label).cast("string").alias("__label"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("__n")).where("__label IS NOT NULL")
    most = rows.groupBy("__label").agg(F.sum("__n").alias("n")).orderBy(F.desc("n"), "__label").limit(max_classes).collect()
    classes = [r["__label"] for r in most]
    if len(classes) < 2:
        return Classifier(None, classes)
    index = rows.sparkSession.createDataFrame(list(zip(classes, map(float, range(len(classes))), strict=True)), "__label string, __y double")
    known = rows.join(F.broadcast(index), "__label")  # max_classes rows
    lr = LogisticRegression(featuresCol=features, labelCol="__y", weightCol="__n", family="multinomial", regParam=reg, standardization=False, maxIter=steps, tol=1e-6, aggregationDepth=3)
    return Classifier(lr.fit(known), classes)


def accuracy(ranked: DataFrame, label: str, ks: tuple[int, ...] = (1, 3, 5), weight: str | None = None) -> DataFrame:
    """One row: n, and for each k the share of rows whose label is among the k likeliest. weight counts a row as so many."""
    place = F.array_position(F.transform("best", lambda x: x["label"]), F.col(label))
    return hit_shares(ranked, F.when(place > 0, place), ks, weight)


def hit_shares(rows: DataFrame, rank: Column, ks: tuple[int, ...], weight: str | None = None) -> DataFrame:
    """One row: n, and for each k the share of rows of a rank of at most k; rows without a rank are misses."""
    n = F.col(weight) if weight else F.lit(1)
    hits = lambda k: F.sum(F.when(rank <= k, n).otherwise(0)) / F.sum(n)
    return rows.agg(F.coalesce(F.sum(n).cast("long"), F.lit(0)).alias("n"), *(hits(k).alias(f"acc_{k}") for k in ks))

"""Summary aggregations: counts, distinct counts, histograms and trends.

All are one or two aggregations with map-side combine; small results are ordered with
a key that breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def route_lengths(df: DataFrame, subject: str, place: str) -> DataFrame:
    return df.groupBy(subject).agg(F.count(place).alias("n"))


def subjects_per(df: DataFrame, subject: str, column: str, exploded: bool = False) -> DataFrame:
    """column, n: distinct subjects per value, or per item of an array column."""
    rows = df.select(subject, F.explode(column).alias(column)) if exploded else df.select(subject, column)
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.countDistinct(subject).alias("n"))


def count_by(df: DataFrame, column: str, missing: str = "Unknown") -> DataFrame:
    """column, n: rows per value; a missing value has a name of its own."""
    return df.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def top_counts(counts: DataFrame, column: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), column).limit(n)


def core_counts(df: DataFrame, subject: str, uid: str, place: str, lists: dict[str, str]) -> DataFrame:
    """One row: rows, distinct subjects, uids, places and list items, median route length, and uids per subject."""
    base = df.agg(F.count("*").alias("rows"), F.countDistinct(subject).alias("subjects"), F.countDistinct(uid).alias("uids"), F.countDistinct(place).alias("places"))
    out = base
    for name, column in lists.items():
        out = out.crossJoin(df.select(F.explode(column).alias("x")).agg(F.countDistinct("x").alias(name)))  # one row each
    median = route_lengths(df, subject, place).agg(F.median("n").cast("int").alias("median_route"))
    ratio = F.when((F.col("uids") > 0) & (F.col("subjects") > 0), F.round(F.col("uids") / F.col("subjects"), 3))
    return out.crossJoin(median).withColumn("uid_ratio", ratio)


def by_subject(df: DataFrame, subject: str, column: str, order: str, missing: str = "Unknown") -> DataFrame:
    """column, n: subjects per value of the first row that has one."""
    first = df.groupBy(subject).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column))
    return count_by(first, column, missing)


def stops(df: DataFrame, subject: str, order: str) -> DataFrame:
    return df.groupBy(subject).agg(F.max(order).alias("stops"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n: equal-width bins from the least to the greatest value, the last one closed."""
    edges = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def distinct_by(df: DataFrame, subject: str, *by: Column | str) -> DataFrame:
    """by, n: distinct subjects per combination."""
    return df.groupBy(*by).agg(F.countDistinct(subject).alias("n"))


def first_seen(df: DataFrame, subject: str, date: str) -> DataFrame:
    """year, n: subjects by the year in which they are first seen."""
    first = df.where(F.col(date).isNotNull()).groupBy(subject).agg(F.min(date).alias("d"))
    return first.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("n"))


def month_heat(df: DataFrame, subject: str, place: str, date: str, n: int = 10) -> DataFrame:
    """month, place, n: distinct subjects by month at the n places with most subjects."""
    best = subjects_per(df, subject, place).orderBy(F.desc("n"), place).limit(n).select(place)
    rows = df.join(best, place, "left_semi").where(F.col(date).isNotNull())
    return distinct_by(rows, subject, F.date_format(date, "yyyy-MM").alias("month"), place)


def rolling_mean(df: DataFrame, value: str, window: int, order: str, *by: str) -> DataFrame:
    """Adds `smoothed`: the centred mean over window rows, of those that exist; even windows reach further back."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn("smoothed", F.avg(value).over(w))


def running_sum(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w))


def flows(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """a, b, n: moves from a place to the next one."""
    nxt = F.lead(place).over(W.partitionBy(subject).orderBy(order))
    return df.select(F.col(place).alias("a"), nxt.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def terms(df: DataFrame, subject: str, tokens: Column, k: int) -> DataFrame:
    """subject, term, n, rank: the k most frequent terms of each subject."""
    n = df.select(subject, F.explode(tokens).alias("term")).groupBy(subject, "term").agg(F.count("*").alias("n"))
    w = W.partitionBy(subject).orderBy(F.desc("n"), "term")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bounds(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def radii(df: DataFrame, n: str) -> DataFrame:
    """Adds `radius`: 8 to 28 by count, 8 where all counts are equal."""
    edges = df.agg(F.min(n).alias("__lo"), F.max(n).alias("__hi"))
    r = F.when(F.col("__hi") == F.col("__lo"), 8.0).otherwise(8 + 20 * (F.col(n) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(edges)).withColumn("radius", r).drop("__lo", "__hi")


def coverage(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """One row: rows, subjects, and how many rows have each column."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(subject).alias("subjects"), *(F.count(c).alias(f"n_{c}") for c in columns))


def mean_std(df: DataFrame, value: str, *by: str) -> DataFrame:
    """by, mean, std (of a sample; 0 for one value)."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def summary_tables(df: DataFrame, subject: str, uid: str, place: str, gender: str, nationality: str, perps: str, chiefs: str) -> dict[str, DataFrame]:
    """The tables of a dashboard, by name; persist df before using several of them."""
    return {
        "core": core_counts(df, subject, uid, place, {"perps": perps, "chiefs": chiefs}),
        "gender": count_by(df, gender),
        "nationality": top_counts(count_by(df, nationality), nationality, 15),
        "per_place": subjects_per(df, subject, place),
        "per_perp": subjects_per(df, subject, perps, exploded=True),
        "per_chief": subjects_per(df, subject, chiefs, exploded=True),
    }

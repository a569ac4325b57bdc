"""Running sums and row numbers over a whole table without one task that sees all of it.

Rows are dealt into buckets that follow one another in the order asked for, summed per
bucket, and counted on from what the buckets before have. A bucket depends on values
alone, so a task that runs again gives the same numbers. Only the buckets' totals, of
which there are some thousands, are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets for each doubling of a number.
PER_DOUBLING = 256


def spread(number: Column) -> Column:
    """An integer that does not fall as the number rises: its place on a logarithmic scale, so that buckets are narrow wherever numbers are dense."""
    x = number.cast("double")
    place = lambda v: F.floor(F.log2(v) * PER_DOUBLING) + (1 << 20)
    return F.when(x > 0, place(x)).when(x < 0, -place(-x)).otherwise(F.lit(0)).cast("long")


def by_text(key: Column, letters: int = 3) -> Column:
    """The first letters of a text: for hexadecimal digests, 16 ** letters buckets of like size."""
    return F.substring(key, 1, letters)


def running_sums(df: DataFrame, bucket: Column, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with the sum of each of `sums` over its row and all rows before it, in the order of bucket and then `order`."""
    rows = df.withColumns({"__b": bucket, **{f"__v_{n}": c for n, c in sums.items()}})
    totals = rows.groupBy("__b").agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    ahead = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("__b", *(F.coalesce(F.sum(f"__t_{n}").over(ahead), F.lit(0)).alias(f"__before_{n}") for n in sums))
    own = W.partitionBy("__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(before, "__b").withColumns({n: F.sum(f"__v_{n}").over(own) + F.col(f"__before_{n}") for n in sums})
    return out.drop("__b", *(f"__v_{n}" for n in sums), *(f"__before_{n}" for n in sums))


def numbered(df: DataFrame, bucket: Column, order: list[Column | str], out: str) -> DataFrame:
    """df with row numbers from 1."""
    return running_sums(df, bucket, order, {out: F.lit(1)})


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """by and, for each name in shares, the percentile (between the two nearest values in proportion); null values are left out.

    Exact, without a task that holds a group: equal values are counted first, the counts
    are summed in buckets of values, and of each group only the buckets in which the
    wanted places lie are put in order. Groups may have null keys. weight counts a row
    as so many.
    """
    keys = {f"__k{i}": F.col(c) for i, c in enumerate(by)}
    at = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    n = F.count("*") if weight is None else F.sum(weight)
    rows = df.where(F.col(value).isNotNull()).select(*(c.alias(k) for k, c in keys.items()), F.col(value).cast("double").alias("__v"), *([weight] if weight else []))
    counts = rows.groupBy(*keys, "__v").agg(n.cast("long").alias("__n")).withColumn("__b", spread(F.col("__v")))
    totals = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    upto = F.sum("__bn").over(at.orderBy("__b").rowsBetween(W.unboundedPreceding, 0))
    places = totals.withColumns({"__upto": upto, "__all": F.sum("__bn").over(at)})
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in shares.items())))
    asked = places.select(*keys, "__b", (F.col("__upto") - F.col("__bn")).alias("__before"), "__upto", "__all", each.alias("__s"))
    place = F.col("__s.p") * (F.col("__all") - 1)
    asked = asked.withColumns({"__place": place, "__low": F.floor(place), "__high": F.ceil(place)})
    inside = lambda c: (F.col("__before") <= F.col(c)) & (F.col(c) < F.col("__upto"))
    asked = asked.where(inside("__low") | inside("__high")).drop("__upto", "__all")
    wanted = asked.groupBy(*keys, "__b").agg(F.first("__before").alias("__before"), F.collect_list(F.struct("__s.name", "__place", "__low", "__high")).alias("__asked"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}"))
    near = counts.alias("c").join(wanted.alias("w"), same & (F.col("c.__b") == F.col("w.__b"))).select("c.*", "__before", "__asked")
    own = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("__end", F.col("__before") + F.sum("__n").over(own)).select(*keys, "__v", "__n", "__end", F.inline("__asked"))
    here = lambda c: (F.col("__end") - F.col("__n") <= F.col(c)) & (F.col(c) < F.col("__end"))
    found = near.groupBy(*keys, "name").agg(F.max(F.when(here("__low"), F.col("__v"))).alias("l"), F.max(F.when(here("__high"), F.col("__v"))).alias("h"), F.first("__place").alias("p"), F.first("__low").alias("f"))
    x = F.col("l") + (F.col("h") - F.col("l")) * (F.col("p") - F.col("f"))
    out = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, x)).alias(name) for name in shares))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by, strict=True)), *shares)

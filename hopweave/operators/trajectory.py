"""Operators on ordered hops: one row per subject and place, in the order of a column.

All of them partition by subject, so one shuffle by subject serves several in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.operators.numbering import numbered, percentiles, spread


def origin_destination(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """subject, origin, destination: places of the least and the greatest order."""
    return df.groupBy(subject).agg(F.min_by(place, order).alias("origin"), F.max_by(place, order).alias("destination"))


def renumber(df: DataFrame, subject: str, order: str, index: str, out: str = "ord") -> DataFrame:
    """Numbers the rows of a subject from 1, by the order where there is one, else by the row index."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(subject).orderBy(F.coalesce(F.col(order), F.col(index)), index)))


def renumber_if_gaps(df: DataFrame, subject: str, order: str, index: str, out: str = "ord") -> DataFrame:
    """Keeps the order if every row has one; otherwise all rows are numbered by row index."""
    gap = df.agg(F.coalesce(F.bool_or(F.col(order).isNull()), F.lit(False)).alias("__gap"))  # one row
    by_index = F.row_number().over(W.partitionBy(subject).orderBy(index))
    return df.crossJoin(F.broadcast(gap)).withColumn(out, F.when(F.col("__gap"), by_index).otherwise(F.col(order)).cast("int")).drop("__gap")


def appearance_ids(df: DataFrame, key: str, index: str, prefix: str = "HTV", out: str = "serial") -> DataFrame:
    """key, out: prefix and a number by first appearance, a rank over the distinct keys."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(index).alias("__first"))
    rows = numbered(first, spread(F.col("__first")), ["__first", key], "__i")
    return rows.select(key, F.concat(F.lit(prefix), F.col("__i").cast("string")).alias(out))


def collapse(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """Rows with a place that differs from the place of the subject's row before; blanks go first."""
    rows = df.where(F.col(place).isNotNull() & (F.trim(place) != ""))
    before = F.lag(place).over(W.partitionBy(subject).orderBy(order))
    return rows.withColumn("__before", before).where("__before IS NULL OR __before <> " + f"`{place}`").drop("__before")


def next_place(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """Adds previous and next place."""
    w = W.partitionBy(subject).orderBy(order)
    return df.withColumns({"previous": F.lag(place).over(w), "next": F.lead(place).over(w)})


def dwell(df: DataFrame, subject: str, at: str, *order: str) -> DataFrame:
    """Adds `dwell_days` to the next row; the open last stay and negative stays are dropped."""
    nxt = F.lead(at).over(W.partitionBy(subject).orderBy(*order))
    return df.withColumn("dwell_days", (F.unix_micros(nxt) - F.unix_micros(at)) / F.lit(86_400e6)).where("dwell_days >= 0")


def gaps(df: DataFrame, subject: str, at: str, *order: str) -> DataFrame:
    """Adds `gap_hours` since the row before; first rows are dropped."""
    before = F.lag(at).over(W.partitionBy(subject).orderBy(*order))
    return df.withColumn("gap_hours", (F.unix_micros(at) - F.unix_micros(before)) / F.lit(3_600e6)).where("gap_hours IS NOT NULL")


def last_place(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    return df.where(F.col(place).isNotNull()).groupBy(subject).agg(F.max_by(place, order).alias("last_place"))


def fill_static(df: DataFrame, subject: str, order: str, columns: list[str]) -> DataFrame:
    """Missing values of fixed attributes, from the rows before, else from the rows after, of the same subject."""
    w = W.partitionBy(subject).orderBy(order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns})


def transitions(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """a, b, weight: distinct subjects per move, repeats collapsed."""
    steps = next_place(collapse(df, subject, place, order), subject, place, order)
    return steps.where("next IS NOT NULL").groupBy(F.col(place).alias("a"), F.col("next").alias("b")).agg(F.countDistinct(subject).alias("weight"))


def place_profile(df: DataFrame, subject: str, place: str, order: str, actor: str, k: int = 5) -> DataFrame:
    """place, visits, subjects, n_in, n_out, top_actors (the k most frequent, joined)."""
    steps = next_place(collapse(df, subject, place, order), subject, place, order)
    base = steps.groupBy(place).agg(F.count("*").alias("visits"), F.countDistinct(subject).alias("subjects"), F.count("previous").alias("n_in"), F.count("next").alias("n_out"))
    n = df.where(F.col(actor).isNotNull()).groupBy(place, actor).agg(F.count("*").alias("n"))
    best = n.withColumn("r", F.row_number().over(W.partitionBy(place).orderBy(F.desc("n"), actor))).where(F.col("r") <= k)
    names = best.groupBy(place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(actor).alias("x")))), lambda s: s["x"]), ", ").alias("top_actors"))
    return base.join(names, place, "left")


def actor_profile(df: DataFrame, subject: str, place: str, actor: str) -> DataFrame:
    """actor, rows, places, subjects (summed over places, so a subject counts once for each)."""
    by_place = df.groupBy(actor, place).agg(F.count("*").alias("n"), F.countDistinct(subject).alias("s"))
    return by_place.groupBy(actor).agg(F.sum("n").alias("rows"), F.count("*").alias("places"), F.sum("s").alias("subjects"))


def duration_medians(df: DataFrame, subject: str, place: str, order: str, days: Column, whole: bool = True) -> DataFrame:
    """grain, a, b, med: median duration per pair of places, per place reached, and overall; no rows without durations."""
    rows = df.withColumn("__a", F.lag(place).over(W.partitionBy(subject).orderBy(order))).withColumn("__d", days)
    rows = rows.where(F.col("__d").isNotNull() & F.col(place).isNotNull()).select(F.col("__a").alias("a"), F.col(place).alias("b"), F.col("__d").alias("d"))
    null = F.lit(None).cast("string")
    counts = rows.groupBy("a", "b", "d").agg(F.count("*").alias("n"))
    grain = lambda name, a, b: F.struct(F.lit(name).alias("grain"), a.alias("a"), b.alias("b"))
    pair = F.when(F.col("a").isNotNull(), grain("pair", F.col("a"), F.col("b")))
    grains = F.filter(F.array(pair, grain("place", null, F.col("b")), grain("all", null, null)), lambda g: g.isNotNull())
    each = counts.select(F.explode(grains).alias("g"), "d", "n").select("g.*", "d", "n")
    out = percentiles(each, ["grain", "a", "b"], "d", {"med": 0.5}, "n")
    out = out.withColumn("med", F.col("med").cast("int")) if whole else out
    return out


def hop_percentiles(df: DataFrame, subject: str, value: Column) -> DataFrame:
    """One row: median and 90th percentile of a number per subject."""
    per = df.groupBy(subject).agg(value.cast("double").alias("x"))
    counts = per.groupBy("x").agg(F.count("*").alias("n"))
    return percentiles(counts, [], "x", {"median": 0.5, "p90": 0.9}, "n").crossJoin(counts.agg(F.sum("n").alias("n")))  # one row each


def attribute_mode(df: DataFrame, subject: str, column: str) -> DataFrame:
    """subject, column: its most frequent value, the smallest of equals."""
    return df.where(F.col(column).isNotNull()).groupBy(subject).agg(F.mode(column, True).alias(column))


def traceroute(df: DataFrame, subject: str, place: str, order: str, who, actor: str, distinct: bool = True) -> DataFrame:
    """step, place, actor of one subject, repeats collapsed if asked."""
    rows = df.where(F.col(subject) == who)
    rows = collapse(rows, subject, place, order) if distinct else rows
    return rows.select(F.row_number().over(W.partitionBy(subject).orderBy(order)).alias("step"), F.col(place), F.col(actor))


def route_dag(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """subject, src, dst: edges between numbered steps."""
    w = W.partitionBy(subject).orderBy(order)
    n, nxt = F.row_number().over(w), F.lead(place).over(w)
    name = lambda i, p: F.concat(F.lit("Step "), i.cast("string"), F.lit(": "), p)
    rows = df.select(subject, n.alias("n"), F.col(place).alias("p"), nxt.alias("q")).where("q IS NOT NULL")
    return rows.select(subject, name(F.col("n"), F.col("p")).alias("src"), name(F.col("n") + 1, F.col("q")).alias("dst"))


def paths(df: DataFrame, subject: str, place: str, order: str) -> DataFrame:
    """subject, path: places in order, repeats collapsed."""
    rows = collapse(df, subject, place, order)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(place).alias("p"))))
    return rows.groupBy(subject).agg(F.transform(pairs, lambda s: s["p"]).alias("path"))


def last_context(path: Column, n: int = 2) -> Column:
    """The last n places of a path, or all of a shorter one."""
    return F.when(F.size(path) >= n, F.slice(path, -n, n)).otherwise(path)


def append_final(path: Column, final: Column) -> Column:
    """The path with the final place, unless it ends there in any case."""
    blank = F.coalesce(F.trim(final), F.lit("")) == ""
    same = F.lower(F.try_element_at(path, F.lit(-1))) == F.lower(final)
    return F.when(blank | F.coalesce(same, F.lit(False)), path).otherwise(F.concat(path, F.array(final)))


def arrivals(steps: DataFrame, subject: str, step: str, days: str, start: str) -> DataFrame:
    """Adds weeks, cumulative days and the date of arrival along a path."""
    total = F.sum(days).over(W.partitionBy(subject).orderBy(step).rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumns({"weeks": F.round(F.col(days) / 7, 2), "cumulative": total, "arrival": F.date_add(start, F.floor(total).cast("int"))})

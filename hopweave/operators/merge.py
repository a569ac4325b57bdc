"""Set-like merging of datasets with conflict resolution.

Rows are keyed by subject, order and place. One shuffle by key serves conflict
detection and resolution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The priority of a source that no order names.
LAST = 1_000_000


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows with `source` and `source_order`, the place of the source in the dict."""
    return union_by_name([df.withColumns({"source": F.lit(s), "source_order": F.lit(i)}) for i, (s, df) in enumerate(frames.items())])


def subject_key(uid: Column, sid: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(uid), F.lit("")), sid, F.lit(""))


def merge_key(subject: Column, order: Column, place: Column) -> Column:
    return F.concat(subject, F.lit("||r="), F.coalesce(order.cast("string"), F.lit("")), F.lit("||l="), F.coalesce(place, F.lit("")))


def conflicts(rows: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """key, n_rows, n_sources: keys of which a list differs between rows, its order included."""
    found = rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), *(F.countDistinct(c).alias(f"__{c}") for c in lists))
    differs = reduce(lambda a, b: a | b, (F.col(f"__{c}") > 1 for c in lists))
    return found.where(differs).select(key, "n_rows", "n_sources")


def conflict_report(rows: DataFrame, key: str, lists: list[str], top: int = 300, examples: int = 3) -> DataFrame:
    """The first keys with a conflict, and example rows of each as texts."""
    keys = conflicts(rows, key, lists).orderBy(key).limit(top)
    w = W.partitionBy(key).orderBy("source_order", *lists)
    some = rows.join(keys.select(key), key, "left_semi").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= examples)
    shown = F.concat_ws(" / ", "source", *(F.array_join(c, ";") for c in lists))
    return keys.join(some.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(shown)), " || ").alias("examples")), key)


def union_items(lists: Column) -> Column:
    """Distinct items of a list of lists, in the order of first occurrence."""
    return F.array_distinct(F.flatten(lists))


def priority_of(source: str, order: list[str]) -> Column:
    table = F.create_map(*(F.lit(x) for i, s in enumerate(order) for x in (s, i)))
    return F.coalesce(F.try_element_at(table, F.col(source)), F.lit(LAST))


def resolve(rows: DataFrame, key: str, lists: list[str], strategy: str, order: list[str], index: str) -> DataFrame:
    """One row of each key.

    priority: of the source named first in order; keep_last: of the source that was
    added last; union_lists: as priority, with each list the union over the key's rows
    in source order. Ties go to the smaller index.
    """
    if strategy not in ("priority", "keep_last", "union_lists"):
        raise ValueError(f"unknown strategy {strategy}")
    by = [F.desc("source_order")] if strategy == "keep_last" else [priority_of("source", order), F.col("source_order")]
    best = W.partitionBy(key).orderBy(*by, index)
    out = rows.withColumn("__n", F.row_number().over(best))
    if strategy == "union_lists":
        # by aggregation of the key's rows, sorted, not by a running list in each row
        pairs = rows.groupBy(key).agg(*(F.array_sort(F.collect_list(F.struct("source_order", F.col(index).alias("i"), F.col(c).alias("x")))).alias(f"__{c}") for c in lists))
        out = out.where("__n = 1").join(pairs, key)
        return out.withColumns({c: union_items(F.transform(f"__{c}", lambda s: s["x"])) for c in lists}).drop("__n", *(f"__{c}" for c in lists))
    return out.where("__n = 1").drop("__n")


def resolve_manually(rows: DataFrame, key: str, lists: list[str], decisions: DataFrame, order: list[str], index: str) -> DataFrame:
    """resolve() by priority, but for keys with a decision: `union`, or the source to choose if it has the key."""
    d = decisions.select(key, "decision", "choice")
    tagged = rows.join(d, key, "left")
    chosen = F.coalesce((F.col("decision") == "choose") & (F.col("choice") == F.col("source")), F.lit(False))
    best = W.partitionBy(key).orderBy(F.when(chosen, 0).otherwise(1), priority_of("source", order), "source_order", index)
    base = tagged.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    union = resolve(rows.join(d.where("decision = 'union'").select(key), key, "left_semi"), key, lists, "union_lists", order, index).select(key, *(F.col(c).alias(f"__{c}") for c in lists))
    return base.join(union, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in lists}).drop(*(f"__{c}" for c in lists), "decision", "choice")


def summary(before: DataFrame, after: DataFrame, subject: str, key: str, lists: list[str]) -> DataFrame:
    """One row: rows before and after, subjects, and keys in conflict."""
    parts = [
        before.agg(F.count("*").alias("rows_before")),
        after.agg(F.count("*").alias("rows_after"), F.countDistinct(subject).alias("subjects")),
        conflicts(before, key, lists).agg(F.count("*").alias("conflicts")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each

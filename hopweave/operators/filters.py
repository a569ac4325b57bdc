"""Filters, predicates, distinct values, pages and limits.

A filter that is not asked for is not part of the plan: arguments are looked at on the
driver. Comparisons with a column alone reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.functions import text as T

ANY = ("", "any", None)


def equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows in which every column asked for has its value; "Any" or blank asks for nothing."""
    for column, value in wanted.items():
        if value not in ANY and str(value).strip().lower() != "any":
            df = df.where(F.col(column) == value)
    return df


def contains_any(items: Column, tokens: list[str]) -> Column:
    """True if the array holds one of the tokens in any case; true without tokens, false for a null array."""
    if not tokens:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.transform(items, F.lower), F.array(*(F.lit(t.lower()) for t in tokens))), F.lit(False))


def contains_exact(items: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(items, name), F.lit(False))


def in_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Numbers from low to high, both included; what is no number is out."""
    v = c.try_cast("double")
    out = v.isNotNull()
    if low is not None:
        out &= v >= low
    if high is not None:
        out &= v <= high
    return out


def year_between(c: Column, low: int, high: int) -> Column:
    """A missing year is out of every range."""
    return F.coalesce(c.between(low, high), F.lit(False))


def substring_in(columns: list[Column], part: str, literal: bool = True) -> Column:
    """True if one of the columns holds the part in any case; as a pattern unless literal."""
    hit = [F.lower(T.text(c)).contains(part.lower()) if literal else F.lower(T.text(c)).rlike(part.lower()) for c in columns]
    return T.any_of(hit)


def tokens_in_text(items: Column, asked: str) -> Column:
    """contains_any() for tokens in a text, between commas."""
    return contains_any(items, [t.strip() for t in asked.split(",") if t.strip()])


def composite(df: DataFrame, *, equal: dict | None = None, any_token: dict[str, list[str]] | None = None, numbers: dict[str, tuple] | None = None, substring: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that meet all of the conditions that are asked for."""
    df = equals(df, **(equal or {}))
    for column, tokens in (any_token or {}).items():
        if tokens:
            df = df.where(contains_any(F.col(column), tokens))
    for column, (low, high) in (numbers or {}).items():
        df = df.where(in_range(F.col(column), low, high))
    if substring and substring[1].strip():
        df = df.where(substring_in([F.col(c) for c in substring[0]], substring[1].strip()))
    return df


def plausible(c: Column, below: float = 2000) -> Column:
    """The number if it is below a bound, else null."""
    v = c.try_cast("double")
    return F.when(v < below, v)


def first_subjects(df: DataFrame, subject: str, order: str, n: int) -> DataFrame:
    """Rows of the n subjects that appear first."""
    first = df.groupBy(subject).agg(F.min(order).alias("__o")).orderBy("__o", subject).limit(n)
    return df.join(first.select(subject), subject, "left_semi")


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in a complete order; Spark keeps n rows of each task only."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """Page number (from 1) of size rows in a complete order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def distinct_values(df: DataFrame, columns: list[str], lists: list[str]) -> DataFrame:
    """kind, value: the distinct values that are not blank of columns, and of the items of lists."""
    value = lambda c, x: F.struct(F.lit(c).alias("kind"), T.smart_blank(x).alias("value"))
    each = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)), lambda x: value(c, x))
    items = [each(c) for c in lists]
    # one pass over the rows gives the values of all
    return df.select(F.inline(F.concat(F.array(*(value(c, F.col(c)) for c in columns)), *items) if columns else F.concat(*items))).where("value <> ''").distinct()


def filter_options(df: DataFrame, columns: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """kind, value: what each filter can be set to, in one call; kinds by the column or list that holds them, of which any may be missing."""
    columns, lists = ({k: c for k, c in x.items() if c in df.columns} for x in (columns, lists))
    if not columns and not lists:
        return df.sparkSession.createDataFrame([], "kind string, value string")
    names = {c: k for k, c in (columns | lists).items()}
    kind = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("kind")]
    return distinct_values(df, list(columns.values()), list(lists.values())).select(kind.alias("kind"), "value")


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row of each key, the first in a complete order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pick_columns(df: DataFrame, first: list[str], chosen: list[str] | None = None) -> DataFrame:
    """The chosen columns, those of `first` before the others."""
    names = chosen or df.columns
    return df.select(*[c for c in first if c in names], *[c for c in names if c not in first])


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column that fits best: equal to a candidate but for case and outer spaces, before one that holds a candidate; earlier candidates first."""
    plain = {c: c.strip().lower() for c in columns}
    fits = [(not plain[c] == k.lower(), i, j, c) for i, k in enumerate(candidates) for j, c in enumerate(columns) if k.lower() in plain[c]]
    return min(fits)[3] if fits else None


def legacy_filter(df: DataFrame, nationality: str | None = None, gender: str | None = None, years: tuple[float, float] | None = None, place: str | None = None, *, columns: dict[str, str] | None = None) -> DataFrame:
    """composite() by position: nationality, gender, range of years, part of a place's name; columns gives their names in df."""
    c = {"nationality": "nationality", "gender": "gender", "year": "year", "place": "location"} | (columns or {})
    return composite(df, equal={c["nationality"]: nationality, c["gender"]: gender}, numbers={c["year"]: tuple(years)} if years else None, substring=([c["place"]], place) if place else None)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; an error that names the columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def coerce_for_save(df: DataFrame) -> DataFrame:
    """Dates as ISO texts, other scalars as texts, nulls as blanks; arrays stay."""
    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "map", "struct")):
            return c
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(name)
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))

"""From raw case tables to the long table of one row per subject and hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopweave.functions import fuzzy
from hopweave.functions import text as T
from hopweave.operators.filters import require
from hopweave.operators.trajectory import append_final, appearance_ids
from hopweave.sources.readers import REQUIRED, normalize_headers

# ---- fixed values: columns of the processed table
PROCESSED = (
    "Serialized ID", "Unique ID", "Location", "Route_Order", "Perpetrators (NLP)", "Chiefs (NLP)", "Locations (NLP)", "Gender of Victim",
    "Nationality of Victim", "Time Spent (days)", "Time Spent (raw)", "Date of Interview", "Left Home Country Year",
)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def with_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    """df with the missing columns as nulls."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def matching(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name holds one of the parts in any case."""
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def extracted(df: DataFrame) -> DataFrame:
    """df with token lists, normalised attributes, days and dates; columns are found by their names."""
    joined = lambda cols, f: F.array_distinct(F.concat(*(f(col(c)) for c in cols))) if cols else F.array().cast("array<string>")
    time = col("Time Spent in Location / Cities / Places")
    return df.withColumns(
        {
            "Locations (NLP)": joined(matching(df, "location", "borders", "cities crossed"), T.location_tokens),
            "Perpetrators (NLP)": joined(matching(df, "perpetrator"), T.person_tokens),
            "Chiefs (NLP)": joined(matching(df, "chief"), T.person_tokens),
            "Gender of Victim": T.normalize_gender(col("Gender of Victim")),
            "Nationality of Victim": T.normalize_nationality(col("Nationality of Victim")),
            "Time Spent (days)": T.duration_upload(time),
            "Time Spent (raw)": T.compact_time(time),
            "Date of Interview": T.parse_date(col("Date of Interview")),
            "Left Home Country Year": T.extract_year(col("Left Home Country Year")),
        }
    )


def standardize(raw: DataFrame, index: str) -> DataFrame:
    """The processed table of an upload: one row per case and place, in the order of the text.

    index numbers the rows of the upload; cases without an id are known by a signature.
    """
    df = extracted(with_columns(normalize_headers(raw)))
    first = F.try_element_at(col("Locations (NLP)"), F.lit(1))
    sign = T.row_signature(col("Date of Interview"), col("Nationality of Victim"), col("Gender of Victim"), first)
    df = df.withColumn("Unique ID", F.coalesce(F.nullif(T.clean_id(col("Unique ID")), F.lit("")), sign))
    rows = df.select("*", F.posexplode_outer("Locations (NLP)").alias("__pos", "Location"))
    ids = appearance_ids(df, "Unique ID", index, out="Serialized ID")
    rows = rows.join(ids, "Unique ID")
    order = F.struct(col(index), F.coalesce("__pos", F.lit(0)))
    from pyspark.sql import Window as W

    rows = rows.withColumn("Route_Order", F.row_number().over(W.partitionBy("Serialized ID").orderBy(order)))
    return rows.select(*(col(c) for c in PROCESSED))


def standardize_strict(raw: DataFrame, index: str) -> DataFrame:
    """The strict pipeline: required columns, lists split at separators, final place appended, fuzzy duplicates removed."""
    df = require(normalize_headers(raw), list(REQUIRED))
    places = fuzzy.fuzzy_dedupe(F.transform(T.split_list(col("City / Locations Crossed")), T.standardize_location))
    people = lambda c: fuzzy.fuzzy_dedupe(F.transform(T.split_list(col(c)), T.titlecase_keep_caps))
    df = df.withColumns(
        {
            "Perpetrators (NLP)": people("Name of the Perpetrators involved"),
            "Chiefs (NLP)": people("Human traffickers/ Chief of places"),
            "__route": places,
            "Gender of Victim": T.standardize_gender(col("Gender of Victim")),
            "Nationality of Victim": T.standardize_nationality(col("Nationality of Victim")),
        }
    )
    df = df.withColumn("Locations (NLP)", append_final(F.col("__route"), F.nullif(T.standardize_location(col("Final Location")), F.lit("")))).drop("__route")
    ids = appearance_ids(df, "Unique ID", index, out="Serialized ID")
    rows = df.join(ids, "Unique ID", "left").select("*", F.posexplode_outer("Locations (NLP)").alias("__pos", "Location"))  # rows without an id stay
    rows = rows.withColumn("Route_Order", F.coalesce("__pos", F.lit(0)) + 1).drop("__pos")
    return rows.withColumns({c: T.smart_blank(col(c)) for c, t in rows.dtypes if t == "string" and c not in ("Serialized ID",)})


def resolved(df: DataFrame, columns: dict[str, str], text_columns: list[str], actor_lists: list[str]) -> DataFrame:
    """sid, route, location, doc_id, text, actors, days: a common schema for evaluations; columns names sid, route, location and time."""
    actors = F.array_distinct(F.flatten(F.array(*(F.coalesce(col(c), F.array().cast("array<string>")) for c in actor_lists)))) if actor_lists else F.array().cast("array<string>")
    days = T.duration_sum(col(columns["time"])) if columns.get("time") else F.lit(None).cast("double")
    return df.select(
        col(columns["sid"]).cast("string").alias("sid"), col(columns["route"]).try_cast("int").alias("route"), T.normalize_location(col(columns["location"])).alias("location"),
        T.doc_id(col(columns["sid"]), col(columns["route"])).alias("doc_id"), T.piped(*(col(c) for c in text_columns)).alias("text"), actors.alias("actors"),
        F.when(days < 2000, days).alias("days"),
    )

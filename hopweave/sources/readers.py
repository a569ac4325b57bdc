"""Scans of raw tables, gazetteers, token files and query sets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.functions import text as T
from hopweave.operators.filters import find_column
from hopweave.operators.merge import union_by_name
from hopweave.sources.excel import read_excel

#: Lines of an archive that are passed on together.
LINES = 10_000

# ---- fixed values: headers and formats of the inputs
REQUIRED = (
    "Unique ID", "Interviewer Name", "Date of Interview", "Gender of Victim", "Nationality of Victim", "Left Home Country Year", "Borders Crossed",
    "City / Locations Crossed", "Final Location", "Name of the Perpetrators involved", "Hierarchy of Perpetrators", "Human traffickers/ Chief of places",
    "Time Spent in Location / Cities / Places",
)
ALIASES = {
    "Unique ID (Victim)": "Unique ID",
    "UniqueID": "Unique ID",
    "Victim ID": "Unique ID",
    "Interviewer": "Interviewer Name",
    "Gender": "Gender of Victim",
    "Nationality": "Nationality of Victim",
    "Left Home Country (Year Range)": "Left Home Country Year",
    "Borders/Countries Crossed": "Borders Crossed",
    "Locations Crossed": "City / Locations Crossed",
    "City/Locations Crossed": "City / Locations Crossed",
    "Name of the Perpetrators": "Name of the Perpetrators involved",
    "Human traffickers / Chief of places": "Human traffickers/ Chief of places",
    "Time Spent in Location/Cities/Places": "Time Spent in Location / Cities / Places",
}
GEONAMES = (
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class", "feature_code", "country_code", "cc2", "admin1_code",
    "admin2_code", "admin3_code", "admin4_code", "population", "elevation", "dem", "timezone", "modification_date",
)
NAMES = ["name", "asciiname", "city", "place", "town"]
LATS, LONS = ["lat", "latitude", "y"], ["lon", "lng", "longitude", "x"]
COUNTRIES, POPULATIONS = ["country", "country_code", "cc", "iso2"], ["population", "pop"]


def read_csv(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """A CSV file with a header, as texts; quoted fields may hold line breaks.

    With position, `file` and `row` (from 0) say where a row stood. A file whose fields
    may hold line breaks is read by one task, in order.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if not position:
        return rows
    at = rows.withColumns({"file": F.input_file_name(), "__at": F.monotonically_increasing_id()})
    return at.withColumn("row", F.row_number().over(W.partitionBy("file").orderBy("__at")) - 1).drop("__at")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or a whole-file JSON document where lines are no records."""
    df = spark.read.json(path)
    return spark.read.json(path, multiLine=True) if "_corrupt_record" in df.columns else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path."""
    end = path.lower().rstrip("/").rpartition(".")[2]
    if end == "csv":
        return read_csv(spark, path)
    if end in ("json", "jsonl"):
        return read_json(spark, path)
    if end == "xlsx":
        return read_excel(spark, path)
    if end == "parquet":
        return spark.read.parquet(path)
    if end in ("txt", "ttl"):
        return spark.read.text(path)
    raise ValueError(f"unknown kind of file: {path}")


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return union_by_name([read_any(spark, p) for p in paths])


def normalize_headers(df: DataFrame) -> DataFrame:
    """Headers trimmed, white space collapsed, aliases resolved."""
    clean = [" ".join(c.split()) for c in df.columns]
    return df.toDF(*(ALIASES.get(c, c) for c in clean))


def template(spark: SparkSession) -> DataFrame:
    """No rows, with the required columns."""
    return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in REQUIRED))


def gazetteer_frame(df: DataFrame, name, lat, lon, country, population, alternatives=None) -> DataFrame:
    alt = F.filter(F.split(T.text(alternatives), ","), lambda x: x != "") if alternatives is not None else F.array().cast("array<string>")
    rows = df.select(F.trim(name).alias("name"), lat.alias("lat"), lon.alias("lon"), country.alias("country"), population.try_cast("long").alias("population"), alt.alias("alt_list"))
    return rows.where("name IS NOT NULL AND name <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def geonames_rows(lines: DataFrame, min_population: int = 0) -> DataFrame:
    """A gazetteer from lines (value) of 19 columns between tabs; shorter lines lack their last columns."""
    parts = F.split("value", "\t", -1)
    df = lines.select(*(F.nullif(F.get(parts, i), F.lit("")).alias(c) for i, c in enumerate(GEONAMES)))
    rows = gazetteer_frame(df, F.col("name"), F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double"), F.col("country_code"), F.col("population"), F.col("alternatenames"))
    return rows.where(F.coalesce("population", F.lit(0)) >= min_population)


def read_geonames(spark: SparkSession, path: str, min_population: int = 0) -> DataFrame:
    """A tab-separated file of 19 columns without header and quotes."""
    return geonames_rows(spark.read.text(path), min_population)


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, member, value: the lines of the largest text file of each ZIP archive of a path.

    An archive is unpacked by the task that reads it, some thousand lines at a time; the
    driver sees neither the archive nor its lines.
    """
    schema = "file string, member string, value string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    texts = [i for i in z.infolist() if i.filename.endswith(".txt")]
                    if not texts:
                        continue
                    best = max(texts, key=lambda i: (i.file_size, i.filename))
                    with io.TextIOWrapper(z.open(best), encoding="utf-8", errors="replace", newline="\n") as f:
                        while some := [x.rstrip("\r\n") for x in islice(f, LINES)]:
                            yield pa.RecordBatch.from_arrays([pa.array([v] * len(some), pa.string()) for v in (file.as_py(), best.filename)] + [pa.array(some, pa.string())], names=["file", "member", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_geonames_zip(spark: SparkSession, path: str, min_population: int = 0) -> DataFrame:
    """A gazetteer from the largest text file of an archive."""
    return geonames_rows(archive_lines(spark, path), min_population)


def read_gazetteer_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A gazetteer CSV. Strict: columns name, lat, lon; else the delimiter is sniffed, bad lines are dropped and columns are found by usual names."""
    if strict:
        df = spark.read.csv(path, header=True)
        if not {"name", "lat", "lon"} <= set(df.columns):
            raise ValueError("a gazetteer needs the columns name, lat and lon")
        sep = ","
    else:
        first = spark.read.text(path).first()
        line = first[0] if first else ""
        sep = max(",;\t|", key=lambda s: line.count(s))
        df = spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED")
    pick = lambda names: find_column(df.columns, names)
    name, lat, lon, country, pop = (pick(n) for n in (NAMES, LATS, LONS, COUNTRIES, POPULATIONS))
    if not (name and lat and lon):
        raise ValueError(f"no name, latitude or longitude among {df.columns}")
    opt = lambda c: F.col(f"`{c}`") if c else F.lit(None).cast("string")
    return gazetteer_frame(df, F.col(f"`{name}`"), T.coordinate(F.col(f"`{lat}`"), "lat"), T.coordinate(F.col(f"`{lon}`"), "lon"), opt(country), opt(pop))


def read_pairs_csv(spark: SparkSession, path: str, pair: str = "Coordinates", name: str = "Name", country: str = "Country Code", population: str = "Population") -> DataFrame:
    """A gazetteer CSV with both coordinates in one column."""
    df = spark.read.csv(path, header=True, sep=";" if ";" in (spark.read.text(path).first() or [""])[0] else ",")
    lat, lon = T.split_pair(F.col(f"`{pair}`"))
    return gazetteer_frame(df, F.col(f"`{name}`"), lat, lon, F.col(f"`{country}`"), F.col(f"`{population}`"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """token: the distinct places of a file whose lines are lists in text."""
    lines = spark.read.text(path)
    return lines.select(F.explode(T.parse_places(F.col("value"))).alias("token")).where("token <> ''").distinct()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, text, relevance (doc_id, grade) of a JSON-lines query set with alternative keys; queries without an id or a text are left out.

    A judgement without a grade has grade 0; one whose grade is no whole number is left out.
    """
    item = "array<struct<doc_id: string, id: string, uid: string, grade: string>>"
    names = ("qid", "id", "query_id", "text", "query")
    df = spark.read.schema(", ".join([*(f"{n} string" for n in names), f"relevance {item}", f"labels {item}"])).json(path)
    first = lambda *cols: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols), F.lit(""))
    given = F.when(F.size("relevance") > 0, F.col("relevance")).otherwise(F.coalesce("labels", F.array().cast(item)))
    judged = F.transform(given, lambda x: F.struct(first(x["doc_id"], x["id"], x["uid"]).alias("doc_id"), F.coalesce(x["grade"], F.lit("0")).try_cast("int").alias("grade")))
    rows = df.select(first("qid", "id", "query_id").alias("qid"), first("text", "query").alias("text"), F.filter(judged, lambda x: x["grade"].isNotNull()).alias("relevance"))
    return rows.where("qid <> '' AND text <> ''")

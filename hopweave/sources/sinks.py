"""Sinks: CSV with joined lists, JSON records, archives of small tables, evaluation reports."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.functions.text import join_csv


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts joined by semicolons."""
    return df.select(*(join_csv(F.col(f"`{c}`").cast("array<string>")).alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.csv(path, header=True, mode="overwrite", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path, mode="overwrite")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.text(path)


#: Rows of a table in an archive at most; larger results belong in write_csv().
MOST_ROWS = 100_000


def archive(tables: dict[str, DataFrame], extra: dict[str, str] | None = None) -> bytes:
    """A ZIP of one CSV per small table; an error for a table of more than MOST_ROWS rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            rows = flat(df).limit(MOST_ROWS + 1).toPandas()
            if len(rows) > MOST_ROWS:
                raise ValueError(f"{name} has more than {MOST_ROWS} rows")
            z.writestr(f"{name}.csv", rows.to_csv(index=False))
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return out.getvalue()


def report_archive(report: dict, folds: dict[str, DataFrame]) -> bytes:
    """An evaluation report with its tables by fold."""
    return archive(folds, {"report.json": json.dumps(report, sort_keys=True, default=str)})

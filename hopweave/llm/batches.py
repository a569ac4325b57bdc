"""Row-wise work on documents over Arrow batches.

Nothing here shuffles: one document is one row in and at most one row out, so a
lost executor only costs the partitions it was working on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of an Arrow batch at most: both sides of the pipe hold whole batches of documents.
ROWS = 1000
#: Text bytes that one call of an operator's function gets at most, unless a single text is longer.
SLICE_BYTES = 500_000


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with batches of at most ROWS rows from now on in the session, unless it has fewer."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= ROWS:
        conf.set(name, str(ROWS))
    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold SLICE_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """Python strings; null counts as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def map_documents(docs: DataFrame, make: Callable[[], Callable[[list[str]], list]], out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, then the columns of the DDL string out.

    make() runs once in each task and returns a function from texts to a list of
    columns (lists or numpy arrays) in the order of out. Other columns of docs are
    not read, so their names cannot clash with the results'.
    """
    fields = T._parse_datatype_string(out).fields
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])
    kinds, names = [to_arrow_type(f.dataType) for f in fields], [id_col, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in pieces(batch, 1):
                work = work or make()
                columns = work(texts_of(part, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return map_arrow(docs.select(docs[id_col], docs[text_col].cast("string").alias("__text")), run, schema)


def keep_documents(docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, for which the function of make() says True."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            for part in pieces(batch, at):
                work = work or make()
                yield part.filter(pa.array(np.asarray(work(texts_of(part, at)), dtype=bool)))

    return map_arrow(docs, run, docs.schema)

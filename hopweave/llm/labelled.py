"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hopweave.llm.batches import map_arrow
from hopweave.llm.shared import written


def remainder(id_col: str, of: int) -> Column:
    """crc32 of an id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, label and text of at most max_rows labelled rows for which keep holds.

    Which rows is decided by a hash of the id, so it depends on no order or partition.
    Only ids and labels are sorted, and the side that is broadcast has max_rows rows. Of
    several documents of one id the least text counts, so the bound holds for them too.
    """
    some = (
        labels.select(F.col(id_col), F.col(label).cast("int").alias("label"))
        .where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & keep)
        .orderBy(F.xxhash64(id_col), id_col, "label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(some), id_col).select(id_col, "label", "text")
    kinds, names = [to_arrow_type(f.dataType) for f in rows.schema], rows.columns

    def run(batches):
        import pyarrow as pa

        least: dict = {}
        for b in batches:
            for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, y) not in least or t < least[i, y]:
                    least[i, y] = t
        columns = [[i for i, _ in least], [y for _, y in least], list(least.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return written(map_arrow(rows.repartition(id_col), run, rows.schema), "labelled")

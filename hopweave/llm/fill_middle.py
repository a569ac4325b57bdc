"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and written in another order.

An automaton over bytes counts the text's units (code points) and knows the sentinels.
Its table has a row for each beginning of a sentinel and a column for each class of
bytes, and says for every step which row comes next, whether a unit begins, and whether
a sentinel ends. No beginning is longer than two bytes, so three bytes decide what a
step emits; the table is unrolled over the classes of three bytes, and one pass of numpy
looks the emitted transitions of all positions up at once. Units are counted for each
cell of some kilobytes. The second pass locates the cuts: by the counts in a cell, and by
looking at the transitions within that cell only.

Cuts and forms come from digests of the id, so a task that runs again gives the same
rows. One document is one row in and one row out; nothing is shuffled.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel,
stays plain; a null id counts as the empty text; equal rows give equal rows; texts are
used whole, however long; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.batches import map_arrow, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = 1
#: Percent of documents that stay plain, and percent of the others that are suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a cell of counts.
CELL = 4096
UNIT, FOUND = 1, 2


def table(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte; the row after a step, and what it emits, by row and class.

    Classes: 0 a byte that begins another unit, 1 a continuation byte, then one for each byte of the sentinels.
    """
    words = [s.encode() for s in sentinels]
    letters = sorted(set(b"".join(words)))
    classes = np.zeros(256, np.uint8)
    classes[0x80:0xC0] = 1
    classes[letters] = np.arange(2, 2 + len(letters))
    rows = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda x: (len(x), x))
    after = np.zeros((len(rows), 2 + len(letters)), np.uint8)
    emits = np.full_like(after, UNIT)
    emits[:, 1] = 0
    for r, row in enumerate(rows):
        for c, letter in enumerate(letters, 2):
            read = row + bytes([letter])
            emits[r, c] |= FOUND * any(read.endswith(w) for w in words)
            after[r, c] = rows.index(max((x for x in rows if read.endswith(x)), key=len))
    return classes, after, emits


def unrolled(after: np.ndarray, emits: np.ndarray) -> np.ndarray:
    """What the last of three steps from the first row emits, by the classes of the three bytes."""
    c = np.arange(after.shape[1])
    row = after[after[0][c[:, None]], c[None, :]]
    return emits[row[:, :, None], c[None, None, :]].ravel()


CLASSES, AFTER, EMITS = table()
STEPS, K = unrolled(AFTER, EMITS), AFTER.shape[1]


class Scan:
    """Transitions of some texts that lie one after the other in data; text i is data[ends[i]:ends[i + 1]]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.ends = ends
        c = np.zeros(len(data) + 2, np.uint16)
        c[2:] = CLASSES[data]
        emitted = STEPS[(c[:-2] * K + c[1:-1]) * K + c[2:]]
        self.units = emitted & UNIT
        found = np.flatnonzero(emitted & FOUND)
        of = np.searchsorted(ends, found, side="right") - 1
        self.holds = np.zeros(len(ends) - 1, bool)
        self.holds[of[found - 2 >= ends[of]]] = True  # a sentinel does not run over the end of a text
        per_cell = np.add.reduceat(self.units, np.arange(0, len(data), CELL), dtype=np.int64) if len(data) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(per_cell)])

    def count(self, at: int) -> int:
        """Units that begin before a byte."""
        cell = at // CELL
        return int(self.before[cell]) + int(self.units[cell * CELL : at].sum(dtype=np.int64))

    def locate(self, unit: int, end: int) -> int:
        """The byte at which a unit (counted over all texts) begins; end if there are no more."""
        cell = int(np.searchsorted(self.before, unit, side="right")) - 1
        if cell * CELL >= end or unit >= self.before[-1]:
            return end
        here = np.flatnonzero(self.units[cell * CELL : (cell + 1) * CELL])
        return min(end, cell * CELL + int(here[unit - int(self.before[cell])]))


def cut(data: np.ndarray, ends: np.ndarray, digests: list[str]) -> tuple[list[int], list[str], list, list, list[bytes]]:
    """n, form, prefix_chars, middle_chars, output of texts whose id has these digests."""
    scan, raw = Scan(data, ends), data.tobytes()
    ns, forms, prefixes, middles, outputs = [], [], [], [], []
    begun = [scan.count(int(e)) for e in ends]
    p, s, m = (x.encode() for x in SENTINELS)
    for i, digest in enumerate(digests):
        a, b, n = int(ends[i]), int(ends[i + 1]), begun[i + 1] - begun[i]
        h1, h2, h3, h4 = (int(digest[j : j + 8], 16) for j in (0, 8, 16, 24))
        ns.append(n)
        if not n or scan.holds[i] or h3 % 100 >= 100 - PLAIN:
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            outputs.append(raw[a:b])
            continue
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        x, y = scan.locate(begun[i] + first, b), scan.locate(begun[i] + second, b)
        spm = h4 % 100 < SUFFIX_FIRST
        forms.append("spm" if spm else "psm")
        prefixes.append(first)
        middles.append(second - first)
        outputs.append(s + raw[y:b] + p + raw[a:x] + m + raw[x:y] if spm else p + raw[a:x] + s + raw[y:b] + m + raw[x:y])
    return ns, forms, prefixes, middles, outputs


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts one after the other, and where each begins; null counts as empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def strings(values: list[bytes]) -> pa.Array:
    """An Arrow array of texts, as their bytes are."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.Array.from_buffers(pa.large_string(), len(values), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(values))]).cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form (plain, psm or spm), prefix_chars, middle_chars, output of each document."""
    fields = "n long, form string, prefix_chars long, middle_chars long, output string"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                ns, forms, prefixes, middles, outputs = cut(*bytes_of(part.column(2)), part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), strings(outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    return map_arrow(docs.select(docs[id_col], digest.alias("__digest"), docs[text_col].cast("string").alias("__text")), run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made; the text holds no sentinel, so each occurs once."""
    part = lambda after, before: F.substring_index(F.substring_index(output, before, 1), after, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(part(PREFIX, SUFFIX), middle, part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), middle, part(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_H = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
f AS (SELECT *, least({_H(0)} % (n + 1), {_H(1)} % (n + 1)) AS a, greatest({_H(0)} % (n + 1), {_H(1)} % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H(2)} % 100 >= {100 - PLAIN} THEN 'plain' WHEN {_H(3)} % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words joined by one space. A window is ten
consecutive words of an item; an item of fewer words, but not none, is one window. Any
window of ten holds five consecutive words that begin at a multiple of five in the item,
so one automaton over these fives, and the short items, finds every place where a window
can be: it has about one node for a character of the benchmark, where the windows
themselves would take ten. Each document is scanned once; where a five is found, the up
to six windows of the document around it are looked up among the digests of all windows.
Hit words are turned into character offsets of the original text.

Words are runs of ASCII digits, ASCII letters (A-Z lowered) and characters beyond
U+007F, so work on UTF-8 bytes cuts words at the same places.

The benchmark is shipped to the executors only up to BLOCK_BYTES of text at a time, which
take about 50 bytes of memory each. A larger benchmark is cut into blocks by item (a
longer item into parts that overlap by nine words), and the documents carry what earlier
blocks have hit through a checkpoint between two blocks, so memory stays bounded and no
window is left out.

Defined cases: null and empty texts have no words, no hits and no items; items
without words have no windows; an item id that repeats is one item with the windows
of all its rows; windows of an item with a null id are hit but cannot be listed; an
empty benchmark or an empty table leaves every document clean; of other columns
only those asked for are carried.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import keep_documents, map_arrow, pieces, texts_of
from hopweave.llm.shared import cut
from hopweave.llm.shipping import Shipped

WINDOW, ANCHOR = 10, 5
#: Text bytes of items in one automaton; a broadcast never holds more.
BLOCK_BYTES = 4_000_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def folded(text: str) -> bytes:
    """UTF-8 with A-Z lowered and every byte outside words as a space, of the same length."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def words_of(text: str) -> list[bytes]:
    return folded(text).split()


def digest(words: list[bytes]) -> tuple[int, int]:
    """Two 64-bit numbers for a window."""
    import xxhash

    return divmod(xxhash.xxh3_128_intdigest(b" ".join(words)), 1 << 64)


class Scanner:
    """The automaton of some items: texts by item id."""

    def __init__(self, items: list[tuple[str | None, str]]):
        import ahocorasick

        short: dict[tuple[bytes, ...], set[str | None]] = {}
        anchors: set[bytes] = set()
        first, second, owner = [], [], []
        self.names = [item for item, _ in items]
        for n, (item, text) in enumerate(items):
            words = words_of(text)
            if 0 < len(words) < WINDOW:
                short.setdefault(tuple(words), set()).add(item)
                continue
            anchors.update(b" ".join(words[i : i + ANCHOR]) for i in range(0, len(words) - ANCHOR + 1, ANCHOR))
            for i in range(len(words) - WINDOW + 1):
                a, b = digest(words[i : i + WINDOW])
                first.append(a)
                second.append(b)
                owner.append(n)
        self.short = [(len(w), {i for i in who if i is not None}) for w, who in short.items()]
        first, second, owner = np.array(first, np.uint64), np.array(second, np.uint64), np.array(owner, np.int32)
        order = np.argsort(first, kind="stable")
        self.first, self.second, self.owner = first[order], second[order], owner[order]
        self.automaton = ahocorasick.Automaton()
        shown = lambda w: " " + w.decode("latin-1") + " "
        for w in anchors:
            self.automaton.add_word(shown(w), (-1,))
        for k, w in enumerate(short):  # a short item may be an anchor as well
            w = shown(b" ".join(w))
            self.automaton.add_word(w, (*self.automaton.get(w, ()), k))
        self.empty = not anchors and not short
        if not self.empty:
            self.automaton.make_automaton()

    def owners(self, window: list[bytes]) -> np.ndarray:
        """Numbers of the items that have a window."""
        a, b = digest(window)
        lo, hi = (np.searchsorted(self.first, np.uint64(a), side) for side in ("left", "right"))
        return self.owner[lo:hi][self.second[lo:hi] == np.uint64(b)] if lo < hi else self.owner[:0]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, merged ranges of hit words, and ids of items with a window in it."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), [], set()
        found = list(self.automaton.iter(" " + b" ".join(words).decode("latin-1") + " "))
        if not found:
            return len(words), [], set()
        ends = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
        ranges, items, maybe = [], set(), set()
        for end, kinds in found:
            last = int(np.searchsorted(ends, end))
            for k in kinds:
                if k < 0:
                    at = last + 1 - ANCHOR
                    maybe.update(range(max(0, at + ANCHOR - WINDOW), min(at, len(words) - WINDOW) + 1))
                else:
                    ranges.append((last + 1 - self.short[k][0], last + 1))
                    items |= self.short[k][1]
        for at in maybe:
            if len(who := self.owners(words[at : at + WINDOW])):
                ranges.append((at, at + WINDOW))
                items.update(x for x in map(self.names.__getitem__, who) if x is not None)
        return len(words), merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of ranges of words."""
    raw = folded(text)
    words = [m.span() for m in _WORD.finditer(raw)]
    lead = (np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    return [(int(at[words[a][0]]), int(at[words[b - 1][1]])) for a, b in ranges]


def parts_of(text: str) -> list[str]:
    """A text, or parts of at most BLOCK_BYTES that overlap by nine words, so that every window is in one."""
    if len(text) * 4 <= BLOCK_BYTES or len(text.encode("utf-8", "surrogatepass")) <= BLOCK_BYTES:
        return [text]
    out, part, size = [], [], 0
    for w in words_of(text):
        if size + len(w) >= BLOCK_BYTES and len(part) > WINDOW:
            out.append(part)
            part = part[1 - WINDOW :]
            size = sum(len(x) + 1 for x in part)
        part.append(w)
        size += len(w) + 1
    return [b" ".join(p).decode("utf-8", "surrogatepass") for p in [*out, part]]


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Blocks of at most BLOCK_BYTES of items, in the order in which they come.

    Items stream to the driver a partition at a time.
    """
    rows, size = [], 0
    for item, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        for part in parts_of(text or ""):
            n = len(part.encode("utf-8", "surrogatepass"))
            if rows and size + n > BLOCK_BYTES:
                yield rows
                rows, size = [], 0
            rows.append((item, part))
            size += n
    yield rows


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, n_words, hits (start and end of hit words by turns), spans (the same as characters), items (sorted)."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    waiting = blocks(items, item_col, item_text_col)
    block, first = next(waiting), True
    while True:  # the driver holds a block and the one after it
        after = next(waiting, None)
        rows = _pass(rows, Shipped(spark, block), first, last=after is None)
        if after is None:
            return rows
        rows, block, first = cut(rows), after, False


def _pass(rows: DataFrame, shipped: Shipped, first: bool, last: bool) -> DataFrame:
    """Adds what one block hits; the text stays in the row until the last block."""
    import pyarrow as pa

    id_field = rows.schema.fields[0]
    text = "" if last else ", __text string"
    schema = f"`{id_field.name}` {id_field.dataType.simpleString()}{text}, n_words long, hits array<int>, spans array<int>, items array<string>"

    def run(batches):
        s = shipped.get(Scanner)
        for batch in batches:
            for part in pieces(batch, 1):
                texts = texts_of(part, 1)
                found = [s.scan(t) for t in texts]
                hits, names = [h for _, h, _ in found], [i for _, _, i in found]
                if not first:
                    got = part.to_pydict()
                    hits = [merged(h + list(zip(o[::2], o[1::2], strict=True))) for h, o in zip(hits, got["hits"], strict=True)]
                    names = [i | set(o) for i, o in zip(names, got["items"], strict=True)]
                flat = lambda x: [v for r in x for v in r]
                ints = pa.list_(pa.int32())
                columns = [part.column(0)] + ([] if last else [part.column(1)])
                columns += [pa.array([n for n, _, _ in found], pa.int64()), pa.array([flat(h) for h in hits], ints)]
                columns += [pa.array([flat(original_offsets(t, h)) if h and last else [] for t, h in zip(texts, hits, strict=True)], ints)]
                columns += [pa.array([sorted(i) for i in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_field.name] + ([] if last else ["__text"]) + ["n_words", "hits", "spans", "items"])

    return map_arrow(rows, run, schema)


def n_hit() -> Column:
    """Words in hits."""
    return F.aggregate(F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, without a hit word."""
    for n, block in enumerate(blocks(items)):
        docs = cut(docs) if n else docs
        shipped = Shipped(docs.sparkSession, block)

        def make(shipped=shipped):
            s = shipped.get(Scanner)
            return lambda texts: [not s.scan(t)[1] for t in texts]

        docs = keep_documents(docs, make, text_col)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    hit = n_hit()
    return scan(docs, items).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP4_SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hw AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM h, (SELECT unnest(range(0, {WINDOW})) AS k) WHERE k < n GROUP BY rid),
hi AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.rid = hw.rid LEFT JOIN hi ON d.rid = hi.rid
"""

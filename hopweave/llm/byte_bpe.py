"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file gives bytes of a token and its rank. The library's BPE model works on
characters, so each byte is written as one printable character (the usual byte
table of byte-level BPE) and every way to split a token into two tokens becomes a
merge, in the order of the merged token's rank: the pair that is merged next is
then the adjacent pair whose joined bytes have the lowest rank, leftmost first.

Each match of the pattern is encoded on its own, so equal matches have equal ids:
a task encodes each distinct match once and keeps what it needs of it, up to CACHE
matches; beyond that it keeps the first quarter, among which frequent matches are, and
encodes the others again when they come. Matches that are new go to the library many
at a time, with a character between them that is no byte's and so is a token alone.

Decoding reverses the byte table on whole ids: bytes of a character that was split
over several tokens come together again before UTF-8 decoding.

Defined cases: null and empty texts have no ids and decode to no bytes; a text of
any length is encoded whole; equal rows give equal results; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import map_arrow, map_documents
from hopweave.llm.shipping import Shipped

#: Matches that a task keeps.
CACHE = 250_000
#: Between matches that the library gets at once; the byte table has no such character.
BETWEEN = "\n"
#: Matches that the library gets at once, and rows that are decoded at once.
MANY, DECODED = 1024, 64


def byte_table() -> list[str]:
    """The character for each byte: itself if printable and not a space, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """What is kept of each match: made(ids) of its ids."""

    def __init__(self, bpe: ByteBpe, made: Callable[[list[int]], object]):
        self.bpe, self.made = bpe, made

    def of(self, texts: list[str]) -> list[list[str]]:
        """The matches of each text; all of them are kept now."""
        parts = [self.bpe.find(t) for t in texts]
        all_of = set(chain.from_iterable(parts))
        new = all_of.difference(self)
        if new and len(self) + len(new) > CACHE:
            first = dict(islice(self.items(), CACHE // 4))
            self.clear()
            self.update(first)
            new = all_of.difference(self)
        for some in iter(lambda it=iter(new): list(islice(it, MANY)), []):
            self.update(zip(some, map(self.made, self.bpe.ids_of(some)), strict=True))
        return parts


class ByteBpe:
    """An encoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.char = byte_table()
        shown = {t: self._shown(t) for t in ranks}
        merges = [
            (shown[t[:i]], shown[t[i:]])
            for t in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.between = max(ranks.values()) + 1
        vocab = {shown[t]: r for t, r in ranks.items()} | {BETWEEN: self.between}
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Split(BETWEEN, "isolated")
        byte_of = {ord(c): b for b, c in enumerate(self.char)}
        self.bytes_of = {r: shown[t].translate(byte_of).encode("latin-1") for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.tuples = Kept(self, tuple)
        self.listed = Kept(self, lambda ids: (",".join(map(str, ids)), self.decode_bytes(ids)))

    def _shown(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.char)

    def ids_of(self, parts: list[str]) -> list[list[int]]:
        """Ids of each match, encoded on its own."""
        line = BETWEEN.join([self._shown(p.encode()) for p in parts])
        ids = self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids
        ends = [i for i, x in enumerate(ids) if x == self.between]
        return [ids[a:b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=True)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts."""
        return [list(chain.from_iterable(map(self.tuples.__getitem__, p))) for p in self.tuples.of(texts)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the bytes that they decode to, of texts."""
        out = []
        for parts in self.listed.of(texts):
            listed, raw = zip(*map(self.listed.__getitem__, parts), strict=True) if parts else ((), ())
            ids = ",".join(listed)
            out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()))
        return out

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Start and end of each id in characters; ids that share a split character overlap on it."""
        lead = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
        at = np.concatenate([[0], np.cumsum(lead)])  # characters begun before a byte
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return [(int(at[s] if lead[s] else at[s] - 1), int(at[e])) for s, e in zip(starts, ends, strict=True)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 (ids cut within a character) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _shipped(spark: SparkSession, path: str, pattern: str) -> Shipped:
    """Rank files are one or two MB whatever the corpus: their size does not grow with the data."""
    with open(path, "rb") as f:
        return Shipped(spark, (f.read(), pattern))


def build(packed: tuple[bytes, str]) -> ByteBpe:
    lines, pattern = packed
    return ByteBpe({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, starts and ends array<int> (character offsets)."""
    shipped = _shipped(docs.sparkSession, path, pattern)

    def make():
        bpe = shipped.get(build)

        def work(texts):
            ids = bpe.encode_all(texts)
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            return [ids, [[s for s, _ in x] for x in spans], [[e for _, e in x] for x in spans]]

        return work

    return map_documents(docs, make, "ids array<int>, starts array<int>, ends array<int>", id_col, text_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for rows of ids; null ids decode to the empty text."""
    shipped = _shipped(encoded.sparkSession, path, pattern)

    def run(batches):
        import pyarrow as pa

        bpe = shipped.get(build)
        for b in batches:
            for row in range(0, b.num_rows, DECODED):
                part = b.slice(row, DECODED)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(i.as_py() or []) for i in part.column(1)], pa.string())], names=[id_col, "text"])

    rows = encoded.select(id_col, F.col(ids_col).alias("__ids"))
    return map_arrow(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of encoding each text and decoding its ids again."""
    shipped = _shipped(docs.sparkSession, path, pattern)

    def make():
        bpe = shipped.get(build)
        return lambda texts: list(zip(*bpe.digests(texts), strict=True))

    return map_documents(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

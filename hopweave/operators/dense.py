"""Scores of all linked pairs of a dense graph, by products of blocks of its matrix.

Rows of (pair, common neighbour) are some n ** 3 where most nodes are linked. Here a node is
one row of bits, n / 8 bytes, and each task multiplies two groups of such rows. Shuffled
bytes are n ** 2 / 8 for each group, and results leave a task in batches of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.operators.numbering import by_text, numbered, spread
from hopweave.sources.shared import written

#: Bytes of one task's part of the matrix while it is made, one for each pair; and of a group of its rows, as bits.
MAKING, GROUP_BYTES = 1 << 28, 1 << 26
#: Rows of a group at most, and at least; groups of a smaller graph, about.
MOST, LEAST, GROUPS = 8192, 256, 8
#: Rows and columns of a block of results, and neighbours that are multiplied at once, whole bytes of bits.
SIDE, DEEP = 1024, 2048
#: Links that are marked at once.
MARKS = 1 << 21


def members(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, i from 0) of dst of edges, and l, the numbers of each subject's (src) nodes."""
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    ids = edges.select(F.col("dst").alias("id")).distinct()
    number = isinstance(ids.schema["id"].dataType, T.NumericType)
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    nodes = numbered(ids, spread(F.col("id")), ["id"], "i") if number else numbered(ids, by_text(digest), [digest, "id"], "i")
    nodes = written(nodes.select("id", (F.col("i") - 1).cast("int").alias("i")), "nodes")
    lists = edges.join(nodes.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.collect_set("i").alias("l"))
    return nodes, written(lists.where("size(l) > 1").select("l"), "lists")


def bit_rows(nodes: DataFrame, lists: DataFrame, n: int) -> DataFrame:
    """id, i, d, bits of each node with a neighbour: its degree, and its neighbours as a row of n bits."""
    rows = max(1, min(-(-n // GROUPS), MAKING // n))
    blocks, width = -(-n // rows), -(-n // 8)
    schema = T.StructType([nodes.schema["id"], *T._parse_datatype_string("i int, d int, bits binary").fields])
    kind = nodes.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, at = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if made is None:
                first = batch.column(0)[0].as_py() * rows
                made = np.zeros((min(rows, n - first), n), bool)
            node = pc.is_valid(batch.column(2))
            ids.append(batch.column(1).filter(node))
            at.append(batch.column(2).filter(node))
            found = batch.column(3).filter(pc.invert(node))
            _mark(made, first, found.flatten().to_numpy(), pc.list_value_length(found).to_numpy(), MARKS)
        if made is None:
            return
        made[np.arange(len(made)), first + np.arange(len(made))] = False
        own = pa.concat_arrays(ids).take(pc.sort_indices(pa.concat_arrays(at)))
        step = max(1, (1 << 24) // n)
        for s in range(0, len(made), step):
            part = made[s : s + step]
            d = part.sum(axis=1, dtype=np.int32)
            bits = np.packbits(part, axis=1)[d > 0]
            offsets = np.arange(len(bits) + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(offsets), pa.py_buffer(bits.tobytes())])
            i = np.flatnonzero(d > 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(s + i)), pa.array(first + s + i, pa.int32()), pa.array(d[d > 0]), packed], names=schema.names)

    block = lambda c: F.floor(c / rows).cast("int")
    none = lambda k, name: F.lit(None).cast(k).alias(name)
    dealt = nodes.select(block(F.col("i")).alias("b"), "id", "i", none("array<int>", "l"))
    dealt = dealt.unionAll(lists.select(F.explode(F.array_distinct(F.transform("l", block))).alias("b"), none(kind, "id"), none("int", "i"), "l"))
    return dealt.repartitionById(blocks, "b").mapInArrow(run, schema)


def _mark(made: np.ndarray, first: int, flat: np.ndarray, sizes: np.ndarray, at_once: int) -> None:
    """Sets the links of the nodes first, first + 1, ... with all nodes of the lists that they are in."""
    which, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    here = np.flatnonzero((flat >= first) & (flat < first + len(made)))
    ends = np.cumsum(sizes[which[here]], dtype=np.int64)
    done = 0
    while done < len(here):
        before = int(ends[done - 1]) if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, before + at_once, side="right")))
        some = here[done:stop]
        many = sizes[which[some]]
        other = np.arange(many.sum()) + np.repeat(starts[which[some]] - (np.cumsum(many) - many), many)
        made[np.repeat(flat[some] - first, many), flat[other]] = True
        done = stop


def _products(left: np.ndarray, right: np.ndarray, worth: np.ndarray | None, deep: int) -> np.ndarray:
    """For each row of left and of right, the worth (1 each, without it) of the bits that both have; columns that either lacks are skipped."""
    kind = np.float32 if worth is None else np.float64  # counts below 2 ** 24 are exact
    out = np.zeros((len(left), len(right)), kind)
    for s in range(0, left.shape[1], deep // 8):
        a, b = left[:, s : s + deep // 8], right[:, s : s + deep // 8]
        if a.any() and b.any():
            a, b = np.unpackbits(a, axis=1).astype(kind), np.unpackbits(b, axis=1).astype(kind)
            if worth is not None:
                a *= worth[s * 8 : s * 8 + a.shape[1]]
            out += a @ b.T
    return out


def linked_scores(nodes: DataFrame, lists: DataFrame, n: int, measure: str) -> DataFrame:
    """src < dst, score by the measure, of all pairs of nodes that a list has both of, in the graph of these pairs."""
    rows = written(bit_rows(nodes, lists, n), "bits")
    width = -(-n // 8)
    size = max(1, min(MOST, max(LEAST, -(-n // GROUPS)), GROUP_BYTES // width))
    groups = -(-n // size)
    kind, whole = nodes.schema["id"].dataType, measure in ("common", "pref_attach")
    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind), T.StructField("score", T.LongType() if whole else T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, bits, worth, task = [], [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0)[0].as_py()
            every = batch.column(4).drop_null()
            if len(every):
                known = every.flatten()
                worth = np.zeros(width * 8)
                degree = known.field(1).to_numpy().astype(np.float64)
                # what has one neighbour only is common to no pair
                worth[known.field(0).to_numpy()] = np.where(degree > 1, 1 / (np.log(np.maximum(degree, 2)) if measure == "adamic_adar" else degree), 0)
                degrees = np.zeros(width * 8, np.int64)
                degrees[known.field(0).to_numpy()] = degree
            node = pc.is_valid(batch.column(2))
            ids.append(batch.column(1).filter(node))
            at.append(batch.column(2).filter(node).to_numpy())
            packed = batch.column(3).filter(node)
            bits.append(np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, width))
        if task is None:
            return
        ids, at, bits = pa.chunked_array(ids).combine_chunks(), np.concatenate(at), np.concatenate(bits)
        high = (isqrt(8 * task + 1) - 1) // 2
        low = task - high * (high + 1) // 2
        own = [x[np.argsort(at[x])] for x in (np.flatnonzero(at // size == low), np.flatnonzero(at // size == high))]
        for i in range(0, len(own[0]), SIDE):
            for j in range(i if low == high else 0, len(own[1]), SIDE):
                yield from _block(own[0][i : i + SIDE], own[1][j : j + SIDE], ids, at, bits, degrees, worth)

    def _block(x, y, ids, at, bits, degrees, worth) -> Iterator[pa.RecordBatch]:
        left, to = bits[x], at[y]
        linked = ((left[:, to >> 3] >> (7 - (to & 7)).astype(np.uint8)) & 1).astype(bool) & (at[x][:, None] < to)
        p, q = np.nonzero(linked)
        if not len(p):
            return
        dx, dy = degrees[at[x]][p], degrees[to][q]
        if measure == "pref_attach":
            score = dx * dy
        else:
            score = _products(left, bits[y], worth if measure in ("adamic_adar", "resource_alloc") else None, DEEP)[p, q]
            score = score.astype(np.int64) if whole else score.astype(np.float64)
            if measure == "jaccard":
                score /= dx + dy - score
        a, b = ids.take(pa.array(x[p])), ids.take(pa.array(y[q]))
        first = pc.less(a, b)
        yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(score)], names=schema.names)

    # one row of all degrees, as large as some 64 of the rows of bits, goes to each task
    every = rows.agg(F.collect_list(F.struct("i", "d")).alias("every"))
    tasks = groups * (groups + 1) // 2
    own = F.floor(F.col("i") / size).cast("int")
    task = lambda o: (F.greatest(own, o) * (F.greatest(own, o) + 1) / 2).cast("int") + F.least(own, o)
    others = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), task)
    dealt = rows.select(F.explode(others).alias("t"), "id", "i", "bits", F.lit(None).cast(every.schema["every"].dataType).alias("every"))
    none = lambda name: F.lit(None).cast(dealt.schema[name].dataType).alias(name)
    dealt = dealt.unionAll(every.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("t"), none("id"), none("i"), none("bits"), "every"))
    return dealt.repartitionById(tasks, "t").mapInArrow(run, schema)

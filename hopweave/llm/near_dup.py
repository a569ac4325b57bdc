"""Near-duplicate documents by BagMinHash signatures, banded and verified.

A document is the multiset of its five-word shingles. A signature has SIZE components;
component j is the earliest point, over all shingles, of Poisson processes whose points
are dealt out to the components. A shingle of weight w owns the stretch [0, w) of the
weight axis. The axis is cut into dyadic levels [0, 1), [1, 2), [2, 4), ...; each level
of each shingle has a process of its own with a rate in proportion to the level's
length, seeded by shingle and level alone, and a point counts if its height, found by
the binary digits of a random number within the level, lies below w. So two multisets
share a component with exactly the probability of their weighted Jaccard similarity,
and only processes that can still beat the latest component are followed.

Documents with the same words are one node, by the digest of the words. Nodes that agree on a band are a bucket. In each of PIVOTS rounds a bucket has a pivot, and
the pairs of it with all other nodes of the bucket that are not connected to it yet are
tested: pairs whose signatures leave a similarity of THRESHOLD possible are verified on
the multisets, and the links join components. The pivot, all pairs of which are then
settled, leaves the bucket; a bucket whose nodes are all connected is done.

What is left are large buckets that are no single class, mostly texts that share a long
passage and little else. Comparing all pairs there would grow with the square of the
group, so candidates come from a prefix filter on the multisets instead: the shingles of
each text that is left are ordered from the rarest among those texts, and two texts of
similarity t share one of the first n - ceil(t n) + 1; at the first that they share, what
follows it in both must suffice for t as well. Texts that share a passage only differ
just there. The filter loses no pair. In a first pass the most similar pair of each two
components is verified, in a second all pairs that still lie in two components. Pairs
are only skipped between nodes that are connected anyway, so classes are the connected
components of all links, without all pairs of a group.

Work on hot buckets, shingles and classes is min, max, counts and joins, which combine
before the shuffle or which adaptive execution splits; members of a frequent shingle are
dealt to blocks of at most BLOCK rows. Nothing of the size of the documents reaches the
driver. What is broadcast is a Bloom filter of fixed size over the nodes to verify;
beyond its capacity it only lets more rows through.

Defined cases: null texts and texts without a word are alone in their class; texts of
one to four words are one shingle of all their words; a null id has a null class; rows
of one id are one class, whatever their texts; ids may have any type that can be
compared; an empty table gives an empty result; other columns are not read
(drop_copies() carries them, under any name).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.batches import map_arrow, pieces, texts_of
from hopweave.llm.decontaminate import words_of
from hopweave.llm.shared import Scratch, cut
from hopweave.llm.shipping import Shipped

WORDS = 5
THRESHOLD = 0.8
#: Bands of ROWS components: a pair of similarity 0.8 misses all of them once in 16,000 times.
BANDS, ROWS = 32, 6
SIZE = BANDS * ROWS
#: A pair is verified if its signatures agree on this share; 3.5 standard deviations below THRESHOLD.
POSSIBLE = 0.7
PIVOTS = 3
#: Rows of one shingle that a task holds of either side of a comparison.
BLOCK = 256
#: 64-bit words of the Bloom filter.
BLOOM = 1 << 18

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the five-word windows; of all words if there are fewer."""
    import xxhash

    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    if not k:
        return h
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i] + _U(i + 1))
    return out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(len(bags), SIZE) components as 64-bit patterns of arrival times; bags: distinct shingles and weights, none empty."""
    n = len(bags)
    h = np.full(n * SIZE, np.inf)
    doc = np.repeat(np.arange(n), [len(s) for s, _ in bags])
    shingle = np.concatenate([s for s, _ in bags]) if n else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]).astype(float) if n else np.zeros(0)
    parts = []
    level, low, high = 0, 0.0, 1.0
    while True:
        own = weight > low
        if not own.any():
            break
        parts.append((doc[own], mixed(shingle[own] + _U((level * 0xD1B54A32D192ED03) & (2**64 - 1))), np.zeros(own.sum()), np.full(own.sum(), high - low), np.full(own.sum(), low), weight[own]))
        level, low, high = level + 1, high, high * 2
    if not parts:
        return h.reshape(n, SIZE).view(np.uint64)
    doc, seed, at, length, low, weight = (np.concatenate(p) for p in zip(*parts, strict=True))
    step, many, latest = 0, 1, np.full(n, np.inf)
    while len(doc):
        draw = seed[:, None] + (np.arange(step + 1, step + many + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]
        a = mixed(draw)
        b = mixed(a ^ _U(0x5851F42D4C957F2D))
        gaps = -np.log(((a >> _U(11)).astype(float) + 0.5) * 2.0**-53)
        gaps[:, 0] += at  # times are kept in units of 1 / rate, so that they add up alike whatever `many` is
        np.cumsum(gaps, axis=1, out=gaps)
        when = gaps / (length * SIZE)[:, None]
        height = low[:, None] + length[:, None] * ((b & _U(0xFFFFFFFF)).astype(float) * 2.0**-32)
        hit = (when < latest[doc][:, None]) & (height < weight[:, None])
        where = (doc[:, None] * SIZE + ((b >> _U(32)) % _U(SIZE)).astype(np.int64))[hit]
        np.minimum.at(h, where, when[hit])
        latest = h.reshape(n, SIZE).max(axis=1)
        alive = when[:, -1] < latest[doc]
        step += many
        many = min(16, many * 2)
        doc, seed, at, length, low, weight = doc[alive], seed[alive], gaps[alive, -1], length[alive], low[alive], weight[alive]
    return h.reshape(n, SIZE).view(np.uint64)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text in order, and their weights."""
    return np.unique(shingles(words_of(text)), return_counts=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays in which an item stands as often as its weight."""
    total = len(a) + len(b)
    if not total:
        return 0.0
    items, which = np.unique(np.concatenate([a, b]), return_inverse=True)
    na, nb = np.bincount(which[: len(a)], minlength=len(items)), np.bincount(which[len(a) :], minlength=len(items))
    both = int(np.minimum(na, nb).sum())
    return both / (total - both)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (digest of the words), n (shingles), buckets array<long>, sig (a byte for each component); null key for no words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                words = [words_of(t) for t in texts_of(part, 1)]
                full = [i for i, w in enumerate(words) if w]
                key: list = [None] * len(words)
                for i in full:
                    key[i] = digest(words[i])
                n = [max(0, len(w) - WORDS + 1) or min(1, len(w)) for w in words]
                s = mixed(signatures([np.unique(shingles(words[i]), return_counts=True) for i in full]))
                bands = np.zeros((len(full), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands * _U(0x9E3779B97F4A7C15) + s[:, r::ROWS])
                bands = mixed(bands + np.arange(BANDS, dtype=np.uint64) * _U(0xD1B54A32D192ED03)).view(np.int64)
                tail = (s & _U(0xFF)).astype(np.uint8)
                buckets, sig = [None] * len(words), [None] * len(words)
                for k, i in enumerate(full):
                    buckets[i], sig[i] = bands[k], tail[k].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "key", "n", "buckets", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, key binary, n bigint, buckets array<bigint>, sig binary")


def digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _agreement(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with est, the share of components that agree, where that and the sizes leave a link possible."""
    sig = nodes.select("id", "n", "sig")
    both = pairs.join(sig.toDF("a", "na", "sa"), "a").join(sig.toDF("b", "nb", "sb"), "b")
    both = both.where(F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")).select(*pairs.columns, "sa", "sb")

    def run(batches):
        for x in batches:
            if x.num_rows:
                sa, sb = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("sa", "sb"))
                est = pa.array((sa == sb).mean(1))
                yield pa.RecordBatch.from_arrays([*x.columns[:-2], est], names=[*x.schema.names[:-2], "est"])

    return map_arrow(both, run, T.StructType([*both.schema.fields[:-2], T.StructField("est", T.DoubleType())])).where(F.col("est") >= POSSIBLE)


def _bloom_bits(column) -> tuple:
    h = F.xxhash64(column)
    return F.pmod(h, F.lit(BLOOM)).cast("int"), [F.pmod(F.shiftright(h, n), F.lit(64)).cast("int") for n in (20, 28, 36)]


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over column doc: each id sets three bits of one word."""
    word, bits = _bloom_bits("doc")
    both = F.expr("shiftleft(1L, x0) | shiftleft(1L, x1) | shiftleft(1L, x2)")
    rows = ids.select(word.alias("w"), *(b.alias(f"x{i}") for i, b in enumerate(bits))).select("w", both.alias("m"))
    out = np.zeros(BLOOM, np.int64)
    for r in rows.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas().itertuples():
        out[r.w] = r.m
    return out


def _bags_of(docs: DataFrame, wanted: DataFrame, bag: Callable[[list[bytes]], np.ndarray], kind: str, keep: Scratch, id_col: str, text_col: str) -> DataFrame:
    """id and bag of the nodes in wanted (id, key, doc); written, so that texts are read once and one Python process works at a time."""
    shipped = Shipped(docs.sparkSession, _bloom(wanted))
    word, bits = _bloom_bits("id")
    both = F.expr("shiftleft(1L, x0) | shiftleft(1L, x1) | shiftleft(1L, x2)")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull())
    rows = rows.select("t", word.alias("w"), *(b.alias(f"x{i}") for i, b in enumerate(bits))).select("t", "w", both.alias("m"))
    packed = pa.binary() if kind == "binary" else pa.list_(pa.int64())

    def run(batches):
        bloom = shipped.get()
        for batch in batches:
            w, m = (batch.column(c).to_numpy() for c in (1, 2))
            maybe = batch.filter(pa.array((bloom[w] & m) == m))
            for part in pieces(maybe, 0):
                words = [x for x in map(words_of, texts_of(part, 0)) if x]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in words], pa.binary()), pa.array([bag(x) for x in words], packed)], names=["key", "bag"])

    found = map_arrow(rows, run, f"key binary, bag {kind}").join(wanted.select("id", "key"), "key").select("id", "bag")
    return keep.written(found.dropDuplicates(["id"]), "bags")  # several rows may have the text of a node


def sorted_shingles(words: list[bytes]) -> bytes:
    """32-bit hashes of shingles in order, each as often as it occurs."""
    return np.sort((shingles(words) >> _U(32)).astype(np.uint32)).tobytes()


def numbered_shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of shingles and of the how manieth of its kind each is: a set for the multiset."""
    s = np.sort(shingles(words))
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return mixed(s + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, keep: Scratch, id_col: str, text_col: str) -> DataFrame:
    """pairs (a, b) with j, the similarity of their multisets."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
    bags = _bags_of(docs, ids.join(nodes.select("id", "key", "doc"), "id"), sorted_shingles, "binary", keep, id_col, text_col)
    both = pairs.select("a", "b").join(bags.toDF("b", "bb"), "b").join(bags.toDF("a", "ba"), "a")

    def run(batches):
        for x in batches:
            j = [similarity(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)) for a, b in zip(x.column(2), x.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(j, pa.float64())], names=["a", "b", "j"])

    return map_arrow(both.select("a", "b", "ba", "bb"), run, "a bigint, b bigint, j double")


def _pivot_round(nodes: DataFrame, members: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """members (bucket, id, comp): possible pairs (a, b) with the pivots, and the members without the pivots."""
    pivot = members.groupBy("bucket").agg(F.min_by(F.struct("id", "comp"), F.struct(F.xxhash64("id", F.lit(n)), "id")).alias("p"))
    rows = members.join(pivot, "bucket").where("id != p.id")
    pairs = rows.where("comp != p.comp").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
    return _agreement(pairs, nodes).select("a", "b"), rows.select("bucket", "id")


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """rows (id, ...) with comp, the component of the node."""
    if labels is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(labels, "id", "left").select(*rows.columns, F.coalesce("comp", "id").alias("comp"))


def _open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (bucket, id) with comp, of the buckets that have several components."""
    named = _named(members.select("bucket", "id"), labels)
    several = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("bucket")
    return named.join(several, "bucket")


def _joined(labels: DataFrame | None, links: DataFrame, keep: Scratch) -> DataFrame | None:
    """labels (id, comp) after more links (a, b): components of the components."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links, keep).withColumnRenamed("class", "comp")
    of = lambda c: labels.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(ends, keep).select(F.col("id").alias("comp"), "class")
    known = labels.unionAll(merged.join(labels.select(F.col("id").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("id"), "comp"))
    return cut(known.join(merged, "comp", "left").select("id", F.coalesce("class", "comp").alias("comp")))


def first_that_may_differ(n) -> Column:
    """How many of n shingles, the rarest first, must hold one of any text of similarity THRESHOLD."""
    return F.col(n) - F.ceil(F.col(n) * THRESHOLD - 1e-9) + 1


def _prefixes(docs: DataFrame, nodes: DataFrame, rest: DataFrame, keep: Scratch, id_col: str, text_col: str) -> DataFrame:
    """id, n, item, at: the shingles in the prefix of each node of rest (id) that other nodes of rest have too, and their places."""
    bags = _bags_of(docs, rest.join(nodes.select("id", "key", "doc"), "id"), numbered_shingles, "array<bigint>", keep, id_col, text_col)
    items = bags.select("id", F.size("bag").cast("long").alias("n"), F.explode("bag").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("f")).where("f > 1")
    shared = items.join(often, "item")
    of_node = W.partitionBy("id")
    place = F.row_number().over(of_node.orderBy("f", "item")) - 1 + F.col("n") - F.count("*").over(of_node)  # after those of its own
    return shared.select("id", "n", "item", place.alias("at")).where(F.col("at") < first_that_may_differ("n"))


def _prefix_pairs(prefixes: DataFrame, labels: DataFrame | None, one: bool) -> DataFrame:
    """Pairs (a, b, ca, cb) of nodes in different components that a shingle of their prefixes leaves possible; if one, of each two components one in each block.

    Most members of a frequent shingle are in one component as a rule. They are not
    compared with one another: blocks of them meet blocks of the others, and blocks of
    the others meet.
    """
    rows = _named(prefixes, labels)
    sizes = rows.groupBy("item", "comp").agg(F.count("*").alias("f"))
    main = sizes.groupBy("item").agg(F.max_by("comp", F.struct("f", "comp")).alias("main"), F.max("f").alias("fm"), F.sum("f").alias("f")).where("f > fm")
    rows = rows.join(main, "item").withColumn("own", F.col("comp") == F.col("main"))
    blocks = lambda f: F.ceil(f / BLOCK).cast("int")
    km, ko = blocks(F.col("fm")), blocks(F.col("f") - F.col("fm"))
    rows = rows.select("item", "id", "comp", "n", "at", "own", km.alias("km"), ko.alias("ko"))
    rows = rows.withColumn("o", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("km")).otherwise(F.col("ko"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("ko") - 1)
    to_main = F.transform(F.sequence(F.lit(0), F.col("km") - 1), lambda c: F.struct(F.col("o").alias("x"), (-1 - c).alias("y")))
    to_others = F.transform(others, lambda c: F.struct(F.least("o", c).alias("x"), F.greatest("o", c).alias("y")))
    from_main = F.transform(others, lambda c: F.struct(c.alias("x"), (-1 - F.col("o")).alias("y")))
    rows = rows.select("item", "id", "comp", "n", "at", "own", F.inline(F.when(F.col("own"), from_main).otherwise(F.concat(to_others, to_main))))

    def pairs_of(ids, comps, n, at, own):
        number = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        comp = np.array([number[c] for c in comps])
        left, seen = n - at, set()
        for i in np.flatnonzero(~own):  # each of the others against the block's main members and the others after it
            free = own.copy()
            free[i + 1 :] = True
            need = np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + n[i]) - 1e-9)
            fits = free & (comp != comp[i]) & (np.minimum(n, n[i]) >= THRESHOLD * np.maximum(n, n[i]) - 1e-9) & (np.minimum(left, left[i]) >= need)
            for j in np.flatnonzero(fits).tolist():
                a, b = (i, j) if ids[i] < ids[j] else (j, i)
                if one:
                    two = (min(comp[a], comp[b]), max(comp[a], comp[b]))
                    if two in seen:
                        continue
                    seen.add(two)
                yield ids[a], ids[b], comps[a], comps[b]

    def run(batches):
        held, key = [], None

        def flush():
            if len(held) < 2:
                return
            ids, comps, n, at, own = zip(*sorted(held), strict=True)
            found = pairs_of(ids, comps, np.array(n), np.array(at), np.array(own))
            while some := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["a", "b", "ca", "cb"])

        for batch in batches:
            for i, c, n, at, own, *where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != key:
                    yield from flush()
                    held, key = [], where
                held.append((i, c, n, at, own))
        yield from flush()

    dealt = rows.select("id", "comp", "n", "at", "own", "item", "x", "y").repartition("item", "x", "y").sortWithinPartitions("item", "x", "y")
    return map_arrow(dealt, run, "a bigint, b bigint, ca bigint, cb bigint").distinct()


def components(links: DataFrame, keep: Scratch) -> DataFrame:
    """id and class (the least id of its component) of the nodes in links (a, b), by least labels and pointer jumps."""
    both = keep.written(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("class")))
    while True:
        near = both.join(labels.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        new = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("class").alias("old"), F.least("class", "c").alias("m"))
        jump = new.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        new = cut(new.join(jump, "m").select("id", "old", F.least("m", "mm").alias("class")))
        changed = new.where("old != class").limit(1).count()
        labels = new.select("id", "class")
        if not changed:
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id (the least id of the document's near-duplicates and itself), n_links, similarity.

    n_links counts the verified links of the document's text to other texts that hold its
    class together (the class is connected by them; texts that are connected already are
    not compared again). similarity is 1 if another id has the same words, else that of
    the best of these links; null for a document that is alone.
    """
    named, ids, _ = _classes(docs, id_col, text_col)
    out = ids.join(named, "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "similarity")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, similarity: the verified links between texts that hold the classes together, by the least id of each text."""
    return _classes(docs, id_col, text_col)[2]


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids with their class and links; all ids; links between the least ids of texts."""
    keep = Scratch(docs.sparkSession)
    found = keep.written(sketches(docs, id_col, text_col), "sketches")
    ids = found.where(F.col("key").isNotNull() & F.col("id").isNotNull()).select("id", "key")
    same = ids.groupBy("key").agg(F.min("id").alias("doc"), (F.min("id") != F.max("id")).alias("copies")).withColumn("node", F.monotonically_increasing_id())
    same = keep.written(same, "nodes")  # written once, so a node has one number
    own = same.withColumnRenamed("doc", "id")
    nodes = found.join(own, ["id", "key"]).dropDuplicates(["node"])
    nodes = keep.written(nodes.select(F.col("node").alias("id"), "key", F.col("id").alias("doc"), "n", "buckets", "sig"), "sigs")
    # rows of one id with different words are one class as well
    some = F.xxhash64("key")
    several = ids.groupBy("id").agg(F.min(some).alias("x"), F.max(some).alias("y")).where("x != y").select("id")
    several = ids.join(several, "id").join(same, "key").select("id", "node")
    least = several.groupBy("id").agg(F.min("node").alias("a"))
    labels = _joined(None, several.join(least, "id").select("a", F.col("node").alias("b")).where("a != b").distinct(), keep)

    found_links: list[DataFrame] = []

    def tested(pairs):
        # they are part of the result, and so stay
        found_links.append(keep.written(_verified(docs, pairs, nodes, keep, id_col, text_col).where(F.col("j") >= THRESHOLD), "links", last=True))
        return found_links[-1].select("a", "b")

    members = keep.written(_open(nodes.select(F.explode("buckets").alias("bucket"), "id"), labels), "members")
    for n in range(PIVOTS):
        if members.isEmpty():
            break
        pairs, rest = _pivot_round(nodes, members, n)
        labels = _joined(labels, tested(keep.written(pairs, "pairs")), keep)
        members = keep.written(_open(rest, labels), "members")
        keep.forget("pairs", "bags", "edges")
        keep.forget("members", newest=1)
    if not members.isEmpty():
        prefixes = keep.written(_prefixes(docs, nodes, members.select("id").distinct(), keep, id_col, text_col), "prefixes")
        keep.forget("members", "bags")
        for one in (True, False):
            pairs = _agreement(_prefix_pairs(prefixes, labels, one), nodes)
            if one:  # the most similar pair of each two components
                best = F.max_by(F.struct("a", "b"), F.struct("est", "a", "b")).alias("p")
                pairs = pairs.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(best).select("p.*")
            labels = _joined(labels, tested(keep.written(pairs.select("a", "b"), "pairs")), keep)
            keep.forget("pairs", "bags", "edges")
    # a class is named by its least document
    of_node = _named(same.select(F.col("node").alias("id"), "key", "doc", "copies"), labels)
    least = of_node.groupBy("comp").agg(F.min("doc").alias("class"))
    every = reduce(DataFrame.unionAll, found_links) if found_links else docs.sparkSession.createDataFrame([], "a bigint, b bigint, j double")
    linked = every.unionAll(every.select("b", "a", "j")).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links"), F.max("j").alias("best"))
    best = F.when(F.col("copies"), 1.0).otherwise(F.col("best")).alias("similarity")
    of_text = of_node.join(least, "comp").join(linked, "id", "left").select("key", "class", "n_links", best)
    named = ids.join(of_text, "key").groupBy("id").agg(F.min("class").alias("class"), F.max("n_links").alias("n_links"), F.max("similarity").alias("similarity"))
    named = keep.written(named, "classes", last=True)
    doc = lambda c: same.select(F.col("node").alias(c), F.col("doc").alias(f"doc_{c}"))
    pairs = every.join(doc("a"), "a").join(doc("b"), "b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), F.col("j").alias("similarity"))
    pairs = keep.written(pairs, "pairs", last=True) if found_links else pairs
    found_ids = keep.written(found.select("id"), "ids", last=True)
    keep.drop()
    return named, found_ids, pairs


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the least id. Rows with a null id stay.

    Of several rows of an id the first by all other columns stays.
    """
    gone = _classes(docs, id_col, text_col)[0].where(F.col("id") != F.col("class")).select(F.col("id").alias(id_col))
    known = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    plain = lambda t: "map<" not in t and "variant" not in t
    order = [F.col(f"`{c}`") if plain(t) else F.to_json(F.struct(f"`{c}`")) for c, t in docs.dtypes]
    n = next(f"n{k}" for k in range(len(docs.columns) + 1) if f"n{k}" not in {c.lower() for c in docs.columns})
    known = known.withColumn(n, F.row_number().over(W.partitionBy(id_col).orderBy(*order))).where(F.col(n) == 1).drop(n)
    return known.unionAll(docs.where(F.col(id_col).isNull()))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))

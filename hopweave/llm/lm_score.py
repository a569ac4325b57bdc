"""Masked pseudo-likelihood with a bidirectional window network.

Each token of a text is hidden in turn and predicted from the two tokens before and
the two after it; the sum of the log-probabilities of all tokens scores the text. The
network adds one embedding per place and neighbour, takes tanh, and predicts in two
steps: a class of 32 tokens, then the token within its class, so a prediction costs 64
outputs instead of the whole vocabulary.

Words are counted in each task and summed by word. The WORDS most frequent ones have an
output of the network each; every other word belongs to one of BUCKETS classes by length
and ending, which the network predicts, and is then predicted itself within its class:
words of the vocabulary, which grows with the corpus (least_count), by their share of
the class, and all rarer or unseen words letter by letter, by counts of letters after up
to ORDER letters in the rare words of the corpus. So the probabilities of a class add up
to at most one over all texts, and the neighbours of a rarer word bear on its class only.

The tokens of every document are numbered once and written, with what the tail says of
them; training and scoring read that table. Training reads every document: documents are
dealt into slices of about SLICE tokens by a hash of id and tokens, and each slice, in
the order of that hash, starts from the same network and takes steps on every token. The
networks are averaged, weighted by the tokens that they have seen, by a tree reduction of
whole numbers, for `rounds` rounds. So the network depends on the documents alone, not on
how they are partitioned, or which task ends first. What the corpus contributes grows
with it; what is shipped is one network, one table of letters, and a vocabulary of at
most VOCABULARY words, beyond which words are predicted by their letters.

Defined cases: null texts and texts without tokens have 0 tokens, a score of 0 and a
null mean; texts of any length are scored whole, in blocks; equal rows give equal
scores, under any partitioning of the corpus; an empty corpus gives a network without
training; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopweave.llm.batches import map_arrow, map_documents, pieces, texts_of
from hopweave.llm.keeping import Rows
from hopweave.llm.shared import written
from hopweave.llm.shipping import Shipped

CLASSES = IN_CLASS = 32
SIZE = CLASSES * IN_CLASS
BUCKETS = 63
#: The last token: what stands before the first and after the last word.
EDGE = SIZE - 1
WORDS = SIZE - BUCKETS - 1
PLACES = (-2, -1, 1, 2)
WIDTH = 16
ROUNDS = 1
BATCH, LEAST, RATE = 4096, 512, 0.1
#: Tokens of a slice, and steps by which weights of networks are counted when they are averaged.
SLICE, FINE = 4_000_000, 2.0**40
#: Words of the vocabulary at most: some 20 MB where they are shipped to.
VOCABULARY = 400_000
#: Weights and hidden values count in steps of 1 / GRID when texts are scored.
GRID = 2.0**16
ONES = np.ones((CLASSES, 1), np.float32)
#: Outputs are cut at this distance from 0, so that their exponentials are finite.
FAR = 60
#: Tokens that are scored at once.
BLOCK = 8192
#: Distinct words that a task counts or numbers before it starts afresh.
CACHE = 300_000
#: Letters (bytes of UTF-8) before a letter that predict it, rows for each number of them, and the weight of the shorter context.
ORDER, ROWS, PRIOR = 4, 4096, 5.0
#: A byte that UTF-8 has not: before the first and after the last letter.
STOP = 255

_any = re.compile(r"\w+|[^\w\s]").findall
#: The same on ASCII text, where it is quicker; the separators are white space to the other.
_plain = re.compile(r"\w+|[^\w\s\x1c-\x1f]", re.ASCII).findall


def tokens_of(text: str) -> list[str]:
    """Words, and signs one by one."""
    return _plain(text) if text.isascii() else _any(text)


class Numbers:
    """The network's number of each token; a word outside its vocabulary gets that of its bucket."""

    def __init__(self, words: list[str], tail: Tail | None = None):
        self.fixed, self.tail = {w: i for i, w in enumerate(words)}, tail
        self.rows, self.at = Rows(CACHE), np.zeros(1024, np.uint16)
        self.logs = np.zeros(1024)

    def rows_of(self, found: list[list[str]]) -> list[np.ndarray]:
        """Rows of the tokens of texts, to be looked up in at and logs before the next call."""
        self.rows.trim()
        out = [np.fromiter(map(self.rows.__getitem__, f), np.int64, len(f)) for f in found]
        if new := self.rows.new:
            self.rows.new = []
            n = len(self.rows)
            if n > len(self.at):
                self.at, self.logs = (np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)]) for x in (self.at, self.logs))
            self.at[n - len(new) : n] = [self.fixed.get(w, 0) for w in new]
            self.logs[n - len(new) : n] = 0
            rare = [(k, w) for k, w in enumerate(new, n - len(new)) if w not in self.fixed]
            if rare:
                rows, words = zip(*rare, strict=True)
                own = np.array([bucket_of(w) for w in words])
                self.at[list(rows)] = WORDS + own
                if self.tail:
                    self.logs[list(rows)] = self.tail.within(words, own)
        return out

    def of(self, text: str) -> np.ndarray:
        (rows,) = self.rows_of([tokens_of(text.lower())])
        return self.at[rows]


def bucket_of(word: str) -> int:
    return (min(len(word), 7) * 9 + zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % 9) % BUCKETS


def letters(words: list[str], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words, each word with a STOP at its end; rows (one a context, shortest first) of each letter; where words start."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    n = np.array([len(r) + 1 for r in raw])
    line = np.frombuffer(bytes([STOP]) * ORDER + b"".join(r + bytes([STOP]) * (ORDER + 1) for r in raw), np.uint8).astype(np.int64)
    starts = np.cumsum(n) - n
    at = np.arange(n.sum()) + ORDER * (1 + np.repeat(np.arange(len(raw)), n))
    rows = np.empty((ORDER + 1, len(at)), np.int64)
    rows[0] = np.repeat([bucket_of(w) for w in words] if own is None else own, n)
    before = np.zeros(len(at), np.int64)
    for k in range(1, ORDER + 1):
        before = before * 256 + line[at - k]
        rows[k] = BUCKETS + (k - 1) * ROWS + (before * 0x9E3779B1 & 0xFFFFFFFF) % ROWS
    return line[at], rows, starts


class Tail:
    """Log-probabilities of words within their class: shares of the vocabulary's words, spelling of the others."""

    def __init__(self):
        self.known: dict[str, float] = {}
        self.spelled = np.full(BUCKETS, -np.log(2))
        self.counts = np.zeros((BUCKETS + ORDER * ROWS, 256), np.float32)
        self.totals: np.ndarray | None = None

    def load(self, known: list[tuple[str, int]], rare: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Tail:
        """known: words and counts; rare: tokens of other words by class; keys and counts: cells of the table of letters."""
        own = np.array([bucket_of(w) for w, _ in known], int)
        n = np.array([c for _, c in known], float)
        of = np.bincount(own, n, BUCKETS)
        self.spelled = np.log((rare + 1) / (of + rare + 2))
        logs = np.log((of + 1) / (of + rare + 2))[own] + np.log(n / of[own])
        self.known = dict(zip((w for w, _ in known), logs.tolist(), strict=True))
        self.counts.reshape(-1)[keys] = counts
        return self

    def spell(self, words: list[str], own: np.ndarray) -> np.ndarray:
        """Log-probabilities of the letters of words, each of them given the class."""
        if not words:
            return np.zeros(0)
        letter, rows, starts = letters(words, own)
        p = np.full(len(letter), 1 / 256)
        if self.totals is None:
            self.totals = self.counts.sum(1, dtype=float)
        for r in rows:
            p = (self.counts[r, letter] + PRIOR * p) / (self.totals[r] + PRIOR)
        return np.add.reduceat(np.log(p), starts)

    def within(self, words: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each word, none of them one of the network's own, given its class (own)."""
        own = np.array([bucket_of(w) for w in words], int) if own is None else own
        out = np.array([self.known.get(w, 0.0) for w in words])
        rare = [k for k, w in enumerate(words) if w not in self.known]
        out[rare] = self.spell([words[k] for k in rare], own[rare]) + self.spelled[own[rare]]
        return out


class Network:
    """Embeddings by place, and the two output layers."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.embed = draw(len(PLACES), SIZE, WIDTH)
        self.to_class, self.class_bias = draw(CLASSES, WIDTH), np.zeros(CLASSES, np.float32)
        self.to_word, self.word_bias = draw(CLASSES, IN_CLASS, WIDTH), np.zeros((CLASSES, IN_CLASS), np.float32)
        self.tail = Tail()

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def forward(self, near: np.ndarray, target: np.ndarray):
        """Hidden layer, probabilities of classes and within the target's class, and tokens by class; rows sorted by class."""
        h = self.hidden(near)
        cuts = np.searchsorted(target // IN_CLASS, np.arange(CLASSES + 1))
        pc, pw = h @ self.to_class.T, np.empty((len(target), IN_CLASS), np.float32)
        pc += self.class_bias
        for c in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[c], cuts[c + 1])
            np.matmul(h[s], self.to_word[c].T, out=pw[s])
        pw += self.word_bias[target // IN_CLASS]
        for p in (pc, pw):
            np.exp(np.clip(p, -FAR, FAR, out=p), out=p)
            p /= p @ ONES
        return h, pc, pw, cuts

    def with_tail(self, tail: Tail) -> Network:
        self.tail = tail
        return self

    def text_sums(self, texts: list[np.ndarray]) -> np.ndarray:
        """Sums of log-probabilities of numbered texts."""
        near, target = windows(texts)
        logs = [self.log_probs(near[a : a + BLOCK], target[a : a + BLOCK]) for a in range(0, len(target), BLOCK)]
        return np.bincount(np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.concatenate([*logs, np.zeros(0)]), len(texts))

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = np.take(self.embed[0], near[:, 0], axis=0)
        for p in range(1, len(PLACES)):
            h += np.take(self.embed[p], near[:, p], axis=0)
        return np.tanh(h, out=h)

    def log_probs(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given its neighbours.

        Hidden values and weights are rounded to multiples of 1 / GRID, so that products
        and sums of the double precision matrix products are exact: a token's result does
        not depend on the tokens that are scored with it.
        """
        order = np.argsort(target // IN_CLASS, kind="stable")
        t = target[order]
        h = np.rint(self.hidden(near[order]).astype(float) * GRID) / GRID
        to_class, to_word = (np.rint(w.astype(float) * GRID) / GRID for w in (self.to_class, self.to_word))
        cuts = np.searchsorted(t // IN_CLASS, np.arange(CLASSES + 1))
        lw = np.empty((len(t), IN_CLASS), np.float32)
        for c in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[c], cuts[c + 1])
            lw[s] = h[s] @ to_word[c].T
        lw += self.word_bias[t // IN_CLASS]
        lc = (h @ to_class.T).astype(np.float32)
        lc += self.class_bias
        rows, logs = np.arange(len(t)), np.zeros(len(t))
        for x, at in ((lc, t // IN_CLASS), (lw, t % IN_CLASS)):
            np.clip(x, -FAR, FAR, out=x)
            logs += x[rows, at]
            logs -= np.log(np.exp(x, out=x).sum(1))
        out = np.empty(len(t))
        out[order] = logs
        return out


class Trainer:
    """Adagrad steps on a network."""

    def __init__(self, net: Network):
        self.net, self.seen = net, 0
        self.sums = [np.full_like(p, 1e-4) for p in net.parts()]

    def batch(self) -> int:
        """Tokens of the next step: few at first, so that small corpora make steps as well."""
        return min(BATCH, max(LEAST, self.seen // 16))

    def step(self, near: np.ndarray, target: np.ndarray) -> None:
        net = self.net
        order = np.argsort(target // IN_CLASS, kind="stable")
        near, target = near[order], target[order]
        h, gc, gw, cuts = net.forward(near, target)
        rows, n = np.arange(len(target)), np.float32(len(target))
        gc[rows, target // IN_CLASS] -= 1
        gw[rows, target % IN_CLASS] -= 1
        gc /= n
        gw /= n
        dh, d_word, d_bias = np.empty_like(h), np.zeros_like(net.to_word), np.zeros_like(net.word_bias)
        present = np.flatnonzero(np.diff(cuts))
        for c in present:
            s = slice(cuts[c], cuts[c + 1])
            np.matmul(gw[s].T, h[s], out=d_word[c])
            np.matmul(gw[s], net.to_word[c], out=dh[s])
        d_bias[present] = np.add.reduceat(gw, cuts[present], axis=0)
        dh += gc @ net.to_class
        dh *= 1 - h * h
        row = (near + np.arange(len(PLACES), dtype=np.uint16) * np.uint16(SIZE)).ravel()  # SIZE * len(PLACES) rows; short integers are sorted by radix
        by = np.argsort(row, kind="stable")
        ids = row[by]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        used, d_used = ids[first], np.add.reduceat(np.take(dh, by // len(PLACES), axis=0), first, axis=0)
        embed, total = net.embed.reshape(-1, WIDTH), self.sums[0].reshape(-1, WIDTH)
        now = total[used] + d_used * d_used
        total[used] = now
        embed[used] -= RATE * d_used / np.sqrt(now)
        for part, total, g in zip(net.parts()[1:], self.sums[1:], [gc.T @ h, gc.sum(0), d_word, d_bias], strict=True):
            total += g * g
            g *= RATE
            part -= g / np.sqrt(total)
        self.seen += len(target)


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours and targets of all tokens of numbered texts; beyond its ends a text has EDGE, which no token is."""
    edge = np.full(2, EDGE, np.uint16)
    line = np.concatenate([edge, *(x for t in texts for x in (t, edge))])
    at = np.flatnonzero(line != EDGE)
    near = np.empty((len(at), len(PLACES)), np.uint16)
    for k, p in enumerate(PLACES):
        near[:, k] = line[at + p]
    return near, line[at]


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts."""

    def run(batches):
        import pyarrow as pa

        def packed(n):
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        n: Counter = Counter()
        for b in batches:
            for part in pieces(b, 0):
                for t in texts_of(part, 0):
                    n.update(tokens_of(t.lower()))
                if len(n) > CACHE:
                    yield packed(n)
                    n = Counter()
        if n:
            yield packed(n)

    part = map_arrow(docs.select(F.col(text_col).cast("string").alias("t")), run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def numbered(docs: DataFrame, words: list[str], tail: Tail, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, within (the sum of what the tail says of words within their class) and tokens (16 bits each) of each text."""
    shipped = Shipped(docs.sparkSession, (words, tail))

    def make():
        numbers = shipped.get(unpacked)

        def work(texts):
            rows = numbers.rows_of([tokens_of(t.lower()) for t in texts])
            return [[len(r) for r in rows], sums([numbers.logs[r] for r in rows]), [numbers.at[r].tobytes() for r in rows]]

        return work

    return map_documents(docs, make, "n_tokens long, within double, tokens binary", id_col, text_col)


def unpacked(model: tuple[list[str], Tail]) -> Numbers:
    return Numbers(*model)


def sums(parts: list[np.ndarray]) -> np.ndarray:
    """The sum of each part, added up one by one, so that equal parts have equal sums."""
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return np.bincount(owner, np.concatenate([*parts, np.zeros(0)]), len(parts))


def _tokens(batch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint16) for t in batch.column(column).to_pylist()]


def _trained(table: DataFrame, net: Network, tokens: int, id_col: str = "doc_id") -> Network:
    """One round over numbered texts of so many tokens: a network of each slice, and their average weighted by tokens."""
    shipped = Shipped(table.sparkSession, net.flat())

    def run(batches):
        import pyarrow as pa

        trainer = Trainer(Network().load(shipped.get()))
        near, target = windows([])
        for b in batches:
            for part in pieces(b, 0):
                more = windows(_tokens(part, 0))
                near, target = np.concatenate([near, more[0]]), np.concatenate([target, more[1]])
                at = 0
                while len(target) - at >= (size := trainer.batch()):
                    trainer.step(near[at : at + size], target[at : at + size])
                    at += size
                near, target = near[at:], target[at:]
        if len(target):
            trainer.step(near, target)
        if trainer.seen:
            share = np.rint(trainer.net.flat() * (trainer.seen / tokens) * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([share.tobytes()], pa.binary())], names=["net"])

    slices = max(1, -(-tokens // SLICE))
    rows = table.select("tokens", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "tokens").alias("__h"))
    rows = rows.repartition(slices, "__h").sortWithinPartitions("__h").select("tokens")
    one = lambda r: np.frombuffer(bytes(r.net), np.int64)
    total = map_arrow(rows, run, "net binary").rdd.map(one).treeAggregate(np.zeros(1, np.int64), lambda a, b: a + b, lambda a, b: a + b, depth=2)
    return Network().load(total / FINE) if len(total) > 1 else net


def least_count(tokens: int, sizes: dict[int, int] | None = None) -> int:
    """Words seen so often are in the vocabulary: it grows with the root of the corpus, up to VOCABULARY words.

    sizes: the number of words by eighths of doublings of their count.
    """
    least, held = max(5, round(tokens**0.5 / 640)), 0
    for place, n in sorted((sizes or {}).items(), reverse=True):
        held += n
        if held > VOCABULARY:
            return max(least, math.ceil(2 ** ((place + 1) / 8) - 1e-9))
    return least


def _tail(counted: DataFrame, head: list[str], known: list[tuple[str, int]], least: int) -> Tail:
    """Shares and letters of all words but the network's own; counted: word, n of the whole corpus."""
    shipped, cells = Shipped(counted.sparkSession, head), (BUCKETS + ORDER * ROWS) * 256

    def run(batches):
        import pyarrow as pa

        own = set(shipped.get())
        total = np.zeros(cells + BUCKETS)
        for b in batches:
            rows = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in own]
            if rows:
                letter, contexts, starts = letters([w for w, _ in rows])
                n = np.array([n for _, n in rows], float)
                each = np.repeat(n, np.diff(np.append(starts, len(letter))))
                for c in contexts:
                    np.add.at(total, c * 256 + letter, each)
                np.add.at(total, cells + np.array([bucket_of(w) for w, _ in rows]), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    rare = map_arrow(counted.where(F.col("n") < least).select("word", "n"), run, "cell long, n long")
    found = rare.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = found.column("cell").to_numpy(), found.column("n").to_numpy()
    tokens = np.zeros(BUCKETS)
    tokens[cell[cell >= cells] - cells] = n[cell >= cells]
    return Tail().load(known, tokens, cell[cell < cells], n[cell < cells])


def learn_numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[tuple[list[str], Network], DataFrame]:
    """learn(), and the numbered texts, which are written: training and scoring read them instead of the texts."""
    counted = written(count_words(docs, text_col), "words")
    head = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    place = F.floor(F.log2("n") * 8).cast("int").alias("place")
    least = least_count(tokens, {r.place: r.n for r in counted.groupBy(place).agg(F.count("*").alias("n")).collect()})  # some hundred rows
    vocabulary = counted.where(F.col("n") >= least).toArrow()
    own = set(head)
    known = [(w, n) for w, n in zip(vocabulary.column("word").to_pylist(), vocabulary.column("n").to_pylist(), strict=True) if w not in own]
    net = Network()
    net.tail = _tail(counted, head, sorted(known), least)
    table = written(numbered(docs, head, net.tail, id_col, text_col), "tokens")
    for _ in range(rounds):
        net = _trained(table, net, tokens, id_col).with_tail(net.tail)
    return (head, net), table


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[list[str], Network]:
    """The network's own words, and the network of the whole corpus with all others."""
    return learn_numbered(docs, id_col, text_col, rounds)[0]


class Scorer:
    """Scores texts on the driver, as scored() does on the executors."""

    def __init__(self, model: tuple[list[str], Network]):
        self.net = model[1]
        self.numbers = Numbers(model[0], self.net.tail)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and sums of the network's log-probabilities of texts: of words of its own and of the classes of others."""
        rows = self.numbers.rows_of([tokens_of(t.lower()) for t in texts])
        return np.array([len(r) for r in rows]), self.net.text_sums([self.numbers.at[r] for r in rows])


def scored(table: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, pll (sum of log-probabilities) and mean_pll of numbered texts."""
    shipped = Shipped(table.sparkSession, net.flat())

    def run(batches):
        import pyarrow as pa

        own = Network().load(shipped.get())
        for b in batches:
            for part in pieces(b, 3):
                pll = own.text_sums(_tokens(part, 3)) + part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pll)], names=[id_col, "n_tokens", "pll"])

    schema = T.StructType([table.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("pll", T.DoubleType())])
    out = map_arrow(table.select(id_col, "n_tokens", "within", "tokens"), run, schema)
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


def score(docs: DataFrame, model: tuple[list[str], Network], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, pll and mean_pll, one row per row of docs."""
    return scored(numbered(docs, model[0], model[1].tail, id_col, text_col), model[1], id_col)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, table = learn_numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored(table, model[1])

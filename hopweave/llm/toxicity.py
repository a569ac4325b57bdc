"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled documents (see labelled()). Their terms are
words and word beginnings of PREFIXES letters (which stand for inflected and compound
forms) whose presence, or repeated presence, goes with the label: all of them with a
chi-squared of at least min_chi2; of two terms of which one begins the other the
stronger stays, so a word is at most one term. Terms are weighted (1 + ln tf) * idf; all
other words together are one background term that every text has once. Vectors have
length one. So the words of a long text that say nothing about toxicity do not drown
those that do, and how often these occur still counts. (With every word a term of its
own, neighbours are texts on the same subject: README has the figures.)

The index is inverted and block-max: per term the examples that hold it in order,
and for each block of BLOCK examples the largest weight. A query visits blocks by
falling upper bound and stops when no block left can reach its k-th best example, so
its neighbours are those of a scan over all examples, ties going to the smaller
example number. Their votes are weighted by closeness. An isotonic fit on the votes
that each example gets from the others turns votes into scores. Texts without any
term are nobody's neighbour and get the share of label 1 among examples without one.

Defined cases: null and empty texts have no terms; without examples every score is
0.5, with one class only its smoothed share; copies of an example are examples of
their own; repeated rows give equal scores; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import map_arrow, map_documents, pieces, texts_of
from hopweave.llm.labelled import labelled, remainder
from hopweave.llm.shared import written
from hopweave.llm.shipping import Shipped

MAX_ROWS = 12_000
MIN_CHI2, MIN_DOCS = 30.0, 5
#: Letters of word beginnings that may be terms.
PREFIXES = range(3, 9)
#: Marks a form that occurs twice or more in a text.
AGAIN = "2 "
NEIGHBOURS, BLOCK = 25, 512
THRESHOLD = 0.7
#: Queries whose neighbours a task keeps, by their terms.
CACHE = 50_000

_words = re.compile(r"[^\W\d_]+").findall


class Terms:
    """The terms by word: a word itself (marked by a final $) or one of its beginnings."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.known: dict[str, int] = {}

    def of(self, word: str) -> int:
        """Number of a word's term, or -1."""
        for t in forms(word):
            if t in self.number:
                return self.number[t]
        return -1

    def counts(self, text: str) -> tuple[tuple[int, int], ...]:
        """(term, how often) of the terms in a text, by term."""
        found: Counter = Counter()
        for w, n in Counter(_words(text.lower())).items():
            t = self.known.get(w)
            if t is None:
                if len(self.known) >= 4 * CACHE:
                    self.known.clear()
                t = self.known[w] = self.of(w)
            if t >= 0:
                found[t] += n
        return tuple(sorted(found.items()))


def forms(word: str) -> list[str]:
    """What may be a term: the whole word, and its beginnings short of the whole."""
    return [word + "$", *(word[:n] for n in PREFIXES if n < len(word))]


def choose_terms(rows: DataFrame, min_chi2: float = MIN_CHI2, min_docs: int = MIN_DOCS) -> list[str]:
    """Terms of labelled rows (text, label) that go with the label, the strongest first."""

    def run(batches):
        import pyarrow as pa

        def packed(n):
            form, label = zip(*n, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(label, pa.int32()), pa.array(list(n.values()), pa.int64())], names=["form", "label", "n"])

        n: Counter = Counter()
        for b in batches:
            for p in pieces(b, 0):
                for text, label in zip(texts_of(p, 0), p.column(1).to_pylist(), strict=True):
                    own: Counter = Counter()
                    for w, k in Counter(_words(text.lower())).items():
                        for f in forms(w):
                            own[f] += k
                    n.update((f, label) for f in own)
                    n.update((AGAIN + f, label) for f, k in own.items() if k > 1)
                    n["", label] += 1
                if len(n) > 1_000_000:
                    yield packed(n)
                    n.clear()
        if n:
            yield packed(n)

    part = map_arrow(rows.select("text", "label"), run, "form string, label int, n long")
    by_form = part.groupBy("form").agg(F.sum(F.col("n") * F.col("label")).cast("double").alias("a"), F.sum("n").cast("double").alias("t"))
    found = written(by_form.where((F.col("t") >= min_docs) & (F.col("a") >= min_docs) | (F.col("form") == "")), "forms")
    total = found.where("form = ''").first()
    if total is None:
        return []
    a, t, pos, every = F.col("a"), F.col("t"), F.lit(total.a), F.lit(total.t)
    more = a * every - t * pos  # more often with the label than without
    under = t * (every - t) * pos * (every - pos)
    chi2 = F.when(under > 0, every * more * more / under)
    return strongest([(r.form, r.chi2) for r in found.where("form != ''").where(more > 0).select("form", chi2.alias("chi2")).where(F.col("chi2") >= min_chi2).collect()])


def strongest(forms: list[tuple[str, float]]) -> list[str]:
    """Forms by falling chi-squared, whole words a little before beginnings, without those that begin a stronger one or that one begins."""
    ranked = sorted((-c if f.endswith("$") else -0.9 * c, -len(f), f.removeprefix(AGAIN)) for f, c in forms)
    taken: dict[str, None] = {}
    longer: set[str] = set()  # beginnings of what is taken
    for _, _, form in ranked:
        begun = [form.rstrip("$")[:n] for n in range(1, len(form.rstrip("$")) + 1)]
        if form not in taken and form not in longer and not any(b in taken for b in begun):
            taken[form] = None
            longer.update(begun)
    return list(taken)


class Index:
    """Labelled examples as sparse unit vectors in a block-max inverted index."""

    def __init__(self, terms: list[str], examples: list[tuple[int, int, tuple[tuple[int, int], ...]]]):
        """examples: (doc id, label, term counts)."""
        self.terms = Terms(terms)
        bare = [y for _, y, c in examples if not c]
        every = [y for _, y, _ in examples]
        share = lambda ys: (sum(ys) + 0.5) / (len(ys) + 1.0)
        self.bare_score = share(bare) if bare else share(every)
        some = sorted((e for e in examples if e[2]), key=lambda e: (max(e[2], key=lambda x: (x[1], -x[0]))[0], e[2], e[0], e[1]))
        self.ids = [e[0] for e in some]
        self.labels = np.array([e[1] for e in some], dtype=float)
        df = np.bincount([t for e in some for t, _ in e[2]], minlength=len(terms)) if some else np.zeros(len(terms))
        self.idf = np.log((1 + len(examples)) / (1 + df)) + 1
        self.n_blocks = -(-len(some) // BLOCK)
        self.block_max = np.zeros((len(terms) + 1, self.n_blocks))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(terms) + 1)]
        self.vectors = [self.vector(e[2]) for e in some]
        for n, (t, w) in enumerate(self.vectors):
            for a, b in zip(t, w, strict=True):
                postings[a].append((n, b))
                self.block_max[a, n // BLOCK] = max(self.block_max[a, n // BLOCK], b)
        self.where = [np.array([n for n, _ in p], dtype=np.int64) for p in postings]
        self.weight = [np.array([w for _, w in p]) for p in postings]
        self.starts = [np.searchsorted(w, np.arange(self.n_blocks + 1) * BLOCK) for w in self.where]
        self.cuts, self.values = np.zeros(0), np.array([share(every)])
        if len(some) > 1 and len(set(every)) > 1:
            self.cuts, self.values = isotonic(np.array([self.vote(*self.nearest(v, skip=n)) for n, v in enumerate(self.vectors)]), self.labels)

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([a for a, _ in counts] + [len(self.idf)], dtype=np.int64)
        w = np.append((1 + np.log(np.array([b for _, b in counts], dtype=float))) * self.idf[t[:-1]], 1.0)
        return t, w / np.sqrt((w**2).sum())

    def block(self, b: int, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Cosines of the examples in a block."""
        out = np.zeros(min(BLOCK, len(self.ids) - b * BLOCK))
        for a, q in zip(t, w, strict=True):
            s, e = self.starts[a][b], self.starts[a][b + 1]
            out[self.where[a][s:e] - b * BLOCK] += q * self.weight[a][s:e]
        return out

    def nearest(self, vector, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a term in common."""
        t, w = vector
        bound = w @ self.block_max[t]
        order = np.argsort(-bound, kind="stable")
        best, cos, kth = np.zeros(0, np.int64), np.zeros(0), -1.0
        for b in order:
            if bound[b] <= 0 or bound[b] < kth - 1e-12:
                break
            got = self.block(b, t, w)
            if b * BLOCK <= skip < b * BLOCK + len(got):
                got[skip - b * BLOCK] = 0
            hit = np.flatnonzero(got > 0)
            best, cos = np.concatenate([best, hit + b * BLOCK]), np.round(np.concatenate([cos, got[hit]]), 12)
            if len(best) > k:
                first = np.lexsort((best, -cos))[:k]
                best, cos = best[first], cos[first]
            kth = cos.min() if len(best) == k else -1.0
        first = np.lexsort((best, -cos))
        return best[first], cos[first]

    def vote(self, best: np.ndarray, cos: np.ndarray) -> float:
        """The neighbours' mean label, each weighted by the inverse of its distance."""
        if not len(best):
            return self.bare_score
        w = 1 / (1.05 - np.minimum(cos, 1))
        return float((w * self.labels[best]).sum() / w.sum())

    def score(self, counts) -> tuple[float, list[int], list[float]]:
        """Score, and ids and cosines of the nearest examples as evidence."""
        if not counts or not len(self.ids):
            return float(self.bare_score), [], []
        best, cos = self.nearest(self.vector(counts))
        v = self.vote(best, cos)
        return float(self.values[np.searchsorted(self.cuts, v, side="right")]), [self.ids[n] for n in best], cos.tolist()


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step function: values[searchsorted(cuts, v)], by pooling adjacent violators; a little smoothed."""
    groups: list[list[float]] = []  # first x, sum, count
    for v in np.unique(x):
        own = y[x == v]
        groups.append([v, own.sum(), len(own)])
        while len(groups) > 1 and groups[-2][1] / groups[-2][2] >= groups[-1][1] / groups[-1][2]:
            _, s, c = groups.pop()
            groups[-1][1] += s
            groups[-1][2] += c
    base = y.mean()
    return np.array([g[0] for g in groups[1:]]), np.array([(g[1] + base) / (g[2] + 1.0) for g in groups])


def learn(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """An index of at most max_rows labelled rows for which keep holds."""
    rows = labelled(docs, labels, label, keep, max_rows, id_col, text_col)
    terms = choose_terms(rows)
    shipped = Shipped(docs.sparkSession, terms)

    def make():
        known = shipped.get(Terms)

        def work(texts):
            found = [known.counts(t) for t in texts]
            return [[[a for a, _ in c] for c in found], [[b for _, b in c] for c in found]]

        return work

    keyed = rows.select(F.struct(F.col(id_col).alias("id"), "label").alias("k"), "text")
    got = map_documents(keyed, make, "t array<int>, c array<int>", "k").collect()
    return Index(terms, sorted((r.k.id, r.k.label, tuple(zip(r.t, r.c, strict=True))) for r in got))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, neighbours (ids of examples, nearest first) and cosines, one row per row of docs."""
    shipped = Shipped(docs.sparkSession, index)

    def make():
        own, known = shipped.get(), {}

        def one(text):
            counts = own.terms.counts(text)
            if counts not in known:
                if len(known) >= CACHE:
                    known.clear()
                known[counts] = own.score(counts)
            return known[counts]

        return lambda texts: list(zip(*map(one, texts), strict=True))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_documents(docs, make, f"score double, neighbours array<{kind}>, cosines array<double>", id_col, text_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    index = learn(docs, labels, remainder("doc_id", 3) != 1)
    return score(docs, index).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "neighbours")

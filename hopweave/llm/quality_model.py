"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting goes round the features in
a fixed order; each step fits a tree of depth two on one feature's bins and adds it,
shrunk, to that feature's lookup table. Then the pairs whose best cut into four
quadrants explains most of what is left get tables of their own, boosted alike. A
score is the logistic of an intercept plus one table entry per feature and pair, so
scoring a batch is a bin lookup and a sum.

Learning takes at most max_rows labelled rows (see labelled()); their features are
computed on the executors, and only those come to the driver.

Defined cases: null and empty texts have features of no words and a score like any
other text; without labelled rows, or with one class only, every score is the share
of label 1 (0.5 without rows), smoothed; repeated rows give equal scores; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.batches import keep_documents, map_documents
from hopweave.llm.labelled import labelled, remainder
from hopweave.llm.quality_rules import SPACE, repeated_words
from hopweave.llm.shipping import Shipped

MAX_ROWS = 12_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 200, 60, 8
RATE = 0.1
#: A document is kept if its score is at least this.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "word_length", "distinct_share", "top_word_share", "repeat_share", "dup_line_share", "log_line_words",
    "symbol_rate", "pipe_rate", "mark_rate", "stop_rate", "comma_rate", "digit_share", "upper_share", "other_share", "same_as_before",
)

_keep = lambda keep: bytes(b for b in range(256) if not keep(b))
_UPPER, _DIGIT, _HIGH = _keep(lambda b: 0x41 <= b <= 0x5A), _keep(lambda b: 0x30 <= b <= 0x39), _keep(lambda b: b >= 0x80)
_LOWER = _keep(lambda b: 0x61 <= b <= 0x7A)


def features(text: str) -> list[float]:
    """FEATURES of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    m, size = max(1, n), max(1, len(raw))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    upper, lower = len(raw.translate(None, _UPPER)), len(raw.translate(None, _LOWER))
    counts = np.bincount(ids) if n else np.zeros(1)
    return [
        np.log1p(n),
        sum(map(len, words)) / m,
        len(number) / m,
        counts.max() / m,
        repeated_words(ids, len(number)) / m,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"@", b"~", b"^")) / m,
        raw.count(b"|") / m,
        (raw.count(b"!") + raw.count(b"?")) / m,
        raw.count(b".") / m,
        raw.count(b",") / m,
        len(raw.translate(None, _DIGIT)) / size,
        upper / max(1, upper + lower),
        len(raw.translate(None, _HIGH)) / size,
        float((ids[1:] == ids[:-1]).sum()) / m,
    ]


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1) if len(edges) else np.zeros((len(x), 0), int)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Where to cut ordered bins in two, and the gain; 0 where no cut gains."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0, 0.0
    gain = a**2 / (b + 1.0) + (g.sum() - a) ** 2 / (h.sum() - b + 1.0) - g.sum() ** 2 / (h.sum() + 1.0)
    k = int(np.argmax(gain))
    return (k + 1, float(gain[k])) if gain[k] > 1e-9 else (0, 0.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of depth two on gradients and curvatures by bin."""
    cut, _ = _best_cut(g, h)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    bounds = [0, *([c] if (c := _best_cut(g[:cut], h[:cut])[0]) else []), cut, *([cut + c] if (c := _best_cut(g[cut:], h[cut:])[0]) else []), len(g)]
    out = np.empty(len(g))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values on a grid of the best cut into four quadrants, and its gain."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(x):
        lt = x[:-1, :-1]
        lb, rt = x[:-1, -1:] - lt, x[-1:, :-1] - lt
        return lt, lb, rt, x[-1, -1] - lt - lb - rt

    gs, hs = parts(a), parts(b)
    gain = sum(p**2 / (q + 1.0) for p, q in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [p[i, j] / (q[i, j] + 1.0) for p, q in zip(gs, hs, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1.0))


class AdditiveModel:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape if len(x) else (0, 0)
        share = (y.sum() + 0.5) / (n + 1.0) if n else 0.5
        self.intercept, self.edges, self.coarse = float(np.log(share / (1 - share))), [], []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if n == 0 or y.min() == y.max():
            return
        cuts = lambda c, b: np.unique(np.quantile(c, np.linspace(0, 1, b + 1)[1:-1]))
        self.edges, self.coarse = [cuts(x[:, f], BINS) for f in range(k)], [cuts(x[:, f], PAIR_BINS) for f in range(k)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        fine, rough = bins_of(x, self.edges), bins_of(x, self.coarse)
        margin = np.full(n, self.intercept)
        slopes = lambda: ((p := 1 / (1 + np.exp(-margin))), y - p, p * (1 - p))[1:]
        for _ in range(ROUNDS):
            for f in range(k):
                g, h = (np.bincount(fine[:, f], w, len(self.tables[f])) for w in slopes())
                step = RATE * _tree(g, h)
                self.tables[f] += step
                margin += step[fine[:, f]]
        cells = {(a, b): rough[:, a] * (len(self.coarse[b]) + 1) + rough[:, b] for a, b in combinations(range(k), 2) if len(self.coarse[a]) and len(self.coarse[b])}
        grid = lambda p: [np.bincount(cells[p], w, (len(self.coarse[p[0]]) + 1) * (len(self.coarse[p[1]]) + 1)).reshape(-1, len(self.coarse[p[1]]) + 1) for w in slopes()]
        gains = {p: _quadrants(*grid(p))[1] for p in cells}
        self.pairs = sorted(cells, key=lambda p: (-gains[p], p))[:PAIRS]
        self.grids = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for at, p in enumerate(self.pairs):
                step = RATE * _quadrants(*grid(p))[0]
                self.grids[at] += step
                margin += step.ravel()[cells[p]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features."""
        margin = np.full(len(x), self.intercept)
        fine, rough = bins_of(x, self.edges), bins_of(x, self.coarse)
        for f, t in enumerate(self.tables):
            margin += t[fine[:, f]]
        for (a, b), t in zip(self.pairs, self.grids, strict=True):
            margin += t[rough[:, a], rough[:, b]]
        return 1 / (1 + np.exp(-margin))


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """A model of at most max_rows labelled rows for which keep holds."""
    rows = labelled(docs, labels, label, keep, max_rows, id_col, text_col)
    # the label rides with the id, so one pass gives both
    keyed = rows.select(F.struct(F.col(id_col).alias("id"), "label").alias("k"), "text")
    got = map_documents(keyed, lambda: lambda texts: [[features(t) for t in texts]], "x array<double>", "k").collect()
    got.sort(key=lambda r: (r.k.id, r.k.label, r.x))
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return AdditiveModel(x, np.array([r.k.label for r in got], dtype=float))


def score(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (how likely label 1 is), one row per row of docs."""
    shipped = Shipped(docs.sparkSession, model)

    def make():
        m = shipped.get()
        return lambda texts: [m.score(_matrix(texts))]

    return map_documents(docs, make, "score double", id_col, text_col)


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that score the threshold or more."""
    shipped = Shipped(docs.sparkSession, model)

    def make():
        m = shipped.get()
        return lambda texts: m.score(_matrix(texts)) >= threshold

    return keep_documents(docs, make, text_col)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels, remainder("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

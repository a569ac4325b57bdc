"""Trained models, links and retrieval against brute force on small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hopweave.operators import forecast, graph, linear, next_place, numbering, retrieval


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_gradient_is_zero_at_the_fit(spark):
    """The fit minimises mean log loss and squared weights: the gradient, worked out by hand, vanishes there."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = np.array(["a", "b", "c"])[np.argmax(x[:, :3] + rng.gumbel(size=(200, 3)), axis=1)]
    rows = spark.createDataFrame([(str(t), Vectors.dense(v)) for t, v in zip(y, x, strict=True)], ["label", "features"])
    fit = linear.fit(rows, "label", reg=0.05, steps=300)
    w, b = fit.model.coefficientMatrix.toArray(), np.array(fit.model.interceptVector)
    p = softmax(x @ w.T + b)
    one = np.array([[t == c for c in fit.classes] for t in y], float)
    assert np.abs((p - one).T @ x / len(x) + 0.05 * w).max() < 1e-3
    assert np.abs((p - one).mean(axis=0)).max() < 1e-3
    best = fit.ranked(rows, 3).collect()
    for r, q in zip(best, p, strict=True):
        want = sorted((-round(v, 9), c) for v, c in zip(q, fit.classes, strict=True))
        assert [z.label for z in r.best] == [c for _, c in want]
        assert [z.prob for z in r.best] == pytest.approx([-v for v, _ in want])


def test_one_class_or_none(spark):
    rows = spark.createDataFrame([("a", Vectors.dense([1.0])), ("a", Vectors.dense([2.0]))], ["label", "features"])
    assert [r.best[0].label for r in linear.fit(rows, "label").ranked(rows, 2).collect()] == ["a", "a"]
    none = rows.limit(0)
    assert all(r.best == [] for r in linear.fit(none, "label").ranked(rows, 2).collect())


def test_most_frequent_classes(spark):
    rows = spark.createDataFrame([(c, Vectors.dense([float(i)])) for i, c in enumerate("aaabbbccd")], ["label", "features"])
    assert linear.fit(rows, "label", max_classes=2).classes == ["a", "b"]


@pytest.fixture(scope="module")
def ways(spark):
    """Trajectories in which the place after two others is known."""
    rng, rows = random.Random(4), []
    for s in range(120):
        way = [rng.choice("ABC"), rng.choice("DEF")]
        while len(way) < 9:
            way.append("ABCDEF"[(2 * "ABCDEF".index(way[-1]) + "ABCDEF".index(way[-2]) + 1) % 6])
        rows += [(f"s{s}", i, p) for i, p in enumerate(way)]
    rows += [("short", 0, "A"), ("short", 1, "B"), ("blank", 0, None), ("blank", 1, " ")]
    return spark.createDataFrame(rows, "sid string, ord int, loc string")


def test_windows_by_brute_force(spark, ways):
    got = {(r.sid, r.ord): (r.lag_3, r.lag_2, r.lag_1, r.next) for r in next_place.windows(ways, "sid", "loc", "ord").collect()}
    want = {}
    by = defaultdict(list)
    for r in ways.orderBy("sid", "ord").collect():
        if r.loc and r.loc.strip() and (not by[r.sid] or by[r.sid][-1][1] != r.loc):
            by[r.sid].append((r.ord, r.loc))
    for s, way in by.items():
        for i in range(2, len(way)):
            want[s, way[i][0]] = (way[i - 2][1], way[i - 1][1], way[i][1], way[i + 1][1] if i + 1 < len(way) else None)
    assert got == want


def test_equal_windows_are_fitted_and_ranked_once(spark, ways, monkeypatch):
    """What is trained on and ranked is bounded by how many windows differ; figures are those of all rows."""
    rows = next_place.windows(ways, "sid", "loc", "ord")
    many = rows.unionAll(rows).unionAll(rows)
    seen, fit, hashed = [], linear.fit, next_place.hashed
    monkeypatch.setattr(next_place, "hashed", lambda r, *a: seen.append(r.count()) or hashed(r, *a))
    model = next_place.fit(many)
    assert seen == [rows.where("next IS NOT NULL").select("lag_1", "lag_2", "lag_3", "next").distinct().count()]
    plain = fit(hashed(rows.where("next IS NOT NULL")), "next")
    assert model.classes == plain.classes and np.abs(model.model.coefficientMatrix.toArray() - plain.model.coefficientMatrix.toArray()).max() < 1e-3
    got = next_place.next_ranked(model, rows, "sid", 2).groupBy("sid").count().collect()
    assert seen[-1] == next_place.last_windows(rows, "sid").select("lag_1", "lag_2", "lag_3").distinct().count() < len(got)
    assert {r["count"] for r in got} == {2}
    a, b = (next_place.compared(ways, rows, r, "sid", "loc", "ord").orderBy("model").collect() for r in (rows, many))
    assert [r.n for r in b] == [3 * r.n for r in a] and [r[2:] for r in b] == [pytest.approx(r[2:]) for r in a]
    none = next_place.compared(ways, rows, rows.limit(0), "sid", "loc", "ord").collect()
    assert [(r.n, r.acc_1) for r in none] == [(0, None)] * 2


def test_next_place_learns_a_rule(spark, ways):
    rows = next_place.windows(ways, "sid", "loc", "ord")
    train, test = rows.where("hash(sid) % 3 <> 0"), rows.where("hash(sid) % 3 = 0")
    out = {r.model: r for r in next_place.compared(ways.where("hash(sid) % 3 <> 0"), train, test, "sid", "loc", "ord").collect()}
    assert out["logistic"].n == out["ngram"].n == test.where("next IS NOT NULL").count() > 50
    assert out["logistic"].acc_1 > 0.95 and out["logistic"].acc_1 <= out["logistic"].acc_3 <= out["logistic"].acc_5
    model = next_place.fit(train)
    ranks = next_place.next_ranked(model, rows, "sid", 2).collect()
    assert {r.sid for r in ranks} == {r.sid for r in rows.select("sid").distinct().collect()}
    assert all(0 < r.prob <= 1 and r["rank"] in (1, 2) for r in ranks)


def test_link_scores_by_brute_force(spark):
    rng = random.Random(8)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)} | {(0, i) for i in range(1, 40)}
    pairs = [(a, b) for a in range(40) for b in range(40) if rng.random() < 0.2] + [(1, 99), (98, 99), (3, 3), (1, 2), (1, 2)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    got = graph.link_scores(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert Counter((r.src, r.dst) for r in got) == Counter(pairs)
    for r in got:
        a, b = near[r.src], near[r.dst]
        both = a & b if r.src != r.dst else set()
        assert r.common == len(both)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(near[z])) for z in both))
        assert r.resource_alloc == pytest.approx(sum(1 / len(near[z]) for z in both))
        assert r.pref_attach == len(a) * len(b)
        if r.src != r.dst:
            assert r.jaccard == pytest.approx(len(both) / len(a | b) if a | b else 0)


def test_link_scores_of_twins_by_brute_force(spark):
    """Cliques that overlap, a pair alone, and a clique with a tail: nodes alike are counted, in and out of their class."""
    groups = [range(0, 6), range(4, 10), range(20, 22), range(30, 36)]
    edges = {(a, b) for g in groups for a in g for b in g if a < b} | {(35, 40), (40, 41), (9, 20)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    pairs = [(a, b) for a in near for b in near]
    got = graph.link_scores(spark.createDataFrame(sorted(edges), "src long, dst long"), spark.createDataFrame(pairs, "src long, dst long")).collect()
    assert Counter((r.src, r.dst) for r in got) == Counter(pairs)
    for r in got:
        both = near[r.src] & near[r.dst] if r.src != r.dst else set()
        assert r.common == len(both)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(near[z])) for z in both))
        assert r.resource_alloc == pytest.approx(sum(1 / len(near[z]) for z in both))
        assert r.pref_attach == len(near[r.src]) * len(near[r.dst])


def shared_by_brute_force(rows):
    """All measures of pairs of actors with a subject in common, in the graph of these pairs."""
    of, near = defaultdict(set), defaultdict(set)
    for s, a in rows:
        if s is not None and a is not None:
            of[s].add(a)
    for x in of.values():
        for a in x:
            near[a] |= x - {a}
    out = {}
    for a in near:
        for b in near[a]:
            if a < b:
                both = near[a] & near[b]
                out[a, b] = {
                    "common": len(both), "jaccard": len(both) / len(near[a] | near[b]), "adamic_adar": sum(1 / math.log(len(near[z])) for z in both),
                    "resource_alloc": sum(1 / len(near[z]) for z in both), "pref_attach": len(near[a]) * len(near[b]),
                }
    return out


@pytest.mark.parametrize("measure", ["common", "jaccard", "adamic_adar", "resource_alloc", "pref_attach"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_of_a_dense_graph_by_brute_force(spark, monkeypatch, measure, kind):
    """Pairs that are neither all nor few are scored by blocks of the matrix as by sets, in blocks that nodes do not fill; no row is made for a common neighbour."""
    for name, value in {"LEAST": 8, "GROUPS": 5, "SIDE": 4, "DEEP": 16, "MARKS": 7}.items():
        monkeypatch.setattr(graph.dense, name, value)
    monkeypatch.setattr(graph, "link_scores", None)
    rng = random.Random(5)
    node = (lambda x: 3 * x - 40) if kind == "long" else "n{}".format
    rows = [(s, node(x)) for s in range(60) for x in rng.sample(range(77), rng.choice([2, 3, 8]))]
    rows += rows[:5] + [(100, node(500)), (101, node(501)), (102, node(501)), (103, node(502)), (103, node(503)), (104, None), (None, node(1)), (None, node(2))]
    want = shared_by_brute_force(rows)
    got = graph.shared_scores(spark.createDataFrame(rows, f"src long, dst {kind}"), measure).collect()
    assert len(got) == len(want) and {(r.src, r.dst) for r in got} == want.keys()
    assert all(r.score == pytest.approx(want[r.src, r.dst][measure], abs=1e-12) for r in got)


def test_scores_of_a_sparse_graph(spark, monkeypatch):
    """Where few pairs share a subject, and where none does, scores are those of the rows."""
    monkeypatch.setattr(graph.dense, "linked_scores", None)
    rows = [(s, x) for s in range(2000) for x in (s, s + 1, s + 2)]
    want = shared_by_brute_force(rows)
    got = graph.shared_scores(spark.createDataFrame(rows, "src long, dst long"), "adamic_adar").collect()
    assert {(r.src, r.dst): pytest.approx(r.score) for r in got} == {k: v["adamic_adar"] for k, v in want.items()}
    for rows in ([], [(1, 1), (2, 1), (3, 2)]):
        assert graph.shared_scores(spark.createDataFrame(rows, "src long, dst long"), "jaccard").count() == 0


def test_nodes_alike_are_one(spark):
    """A complete graph is one class; a node with other neighbours is a class of its own."""
    full = spark.range(300).selectExpr("id AS src").crossJoin(spark.range(300).selectExpr("id AS dst")).where("src <> dst")
    both = full.unionAll(spark.createDataFrame([(7, 999), (999, 7)], "src long, dst long"))
    assert {(r.twin, r["size"]) for r in graph.twins(both).collect()} == {(0, 299), (7, 1), (999, 1)}


def test_shared_subjects_link_actors(spark):
    """Queries of link scores take all actors of a subject, not only those of one day."""
    from hopweave.plans.catalogue import QUERIES

    assert QUERIES["link_jaccard"](spark, "/root/testdata/sf0.01").count() == 4950


def test_a_hub_makes_no_pairs(spark):
    """Pairs of leaves of a star go through the leaf's one neighbour, not through the hub's many."""
    star = spark.range(1, 3001).selectExpr("0L AS src", "id AS dst")
    pairs = spark.range(1, 3000).selectExpr("id AS src", "id + 1 AS dst")
    rows = graph.link_scores(star, pairs)
    assert rows.where("common = 1").count() == 2999


def test_known_pairs_and_metrics(spark):
    df = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    train, held = df([(1, 2), (1, 3), (2, 3), (4, 5)]), df([(1, 2), (4, 5), (1, 5), (1, 2)])
    assert sorted(map(tuple, graph.known_pairs(train, held).collect())) == [(1, 2), (4, 5)]
    assert graph.known_pairs(train, held, 1).count() == 1
    out = graph.evaluate_links(train, held, per_node=2).collect()
    assert {r.heuristic for r in out} == set(graph.HEURISTICS)
    assert all(r.n_eval == 2 and 0 < r.mrr <= 1 and r.hits_1 <= r.hits_3 <= r.hits_5 for r in out)


def test_node_types_from_neighbours(spark):
    """Held-out nodes, whose own type no feature tells, are told apart by their neighbours."""
    rng, edges = random.Random(3), set()
    for v in range(80):
        edges |= {(f"V:{v}", f"L:{rng.randrange(15)}") for _ in range(3)} | {(f"V:{v}", f"P:{rng.randrange(10)}") for _ in range(2)}
    edges |= {(f"P:{p}", f"L:{rng.randrange(15)}") for p in range(10) for _ in range(6)}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    nodes = graph.nodes_of(e)
    known = F.crc32(F.col("id").cast("binary")) % 2 == 0
    model, best = graph.classify_nodes(e, nodes, known)
    rows = best.collect()
    assert {r.id for r in rows} == {r.id for r in nodes.where(~known).collect()}
    assert sum(r.best[0].label == r.ntype for r in rows) > 0.9 * len(rows)
    own = graph.node_features(e, nodes, F.col("id") == "V:1").where("feature = 'type:Victim'")
    assert "V:1" not in {r.id for r in own.collect()}


def test_edges_are_read_once_and_lie_by_node(spark):
    """Nodes are classified by edges that were read once: they lie in buckets by node, so counts by node and joins with nodes shuffle none."""
    edges = [(f"V:{v}", f"{k}:{v % m}") for v in range(60) for k, m in (("L", 7), ("P", 5))] + [("L:1", "V:1"), ("P:1", "P:1")]
    read = spark.sparkContext.accumulator(0)
    e = spark.createDataFrame(spark.sparkContext.parallelize(edges, 2).map(lambda r: (read.add(1), r)[1]), "src string, dst string")
    model, best = graph.classify_nodes(e, None, F.crc32(F.col("id").cast("binary")) % 2 == 0)
    assert len(best.collect()) > 20 and read.value == len(edges)
    adj = graph.adjacent(spark.createDataFrame(edges, "src string, dst string"))
    assert {tuple(r) for r in adj.collect()} == {p for a, b in edges for p in ((a, b), (b, a))} and adj.count() == 2 * 120 + 1
    assert "Exchange" not in adj.groupBy("src").count()._jdf.queryExecution().executedPlan().toString()


def test_features_that_are_zero_or_absent(spark):
    """A feature of value 0 reaches neighbours as 0, an absent one does not, of as many features as one row has."""
    edges = spark.createDataFrame([("a", "b"), ("c", "c"), ("d", "e")], "src string, dst string")
    given = [("a", f"f{i:02}", float(i)) for i in range(graph.WIDE)] + [("c", "f03", 2.0), ("e", "f63", 0.0)]
    got = {(r.id, r.feature): r.x for r in graph.smoothed_features(edges, spark.createDataFrame(given, "id string, feature string, x double"), 1).collect()}
    want = {(n, f): x / 2 for m, f, x in given for n in {"a": "ab", "e": "de"}.get(m, "")} | {("c", "f03"): 2.0}
    assert got == pytest.approx(want)


def test_negatives_of_some_subjects_and_scores_of_few_pairs(spark):
    """Negatives of asked subjects, and scores of few pairs, are those of the whole."""
    rng = random.Random(3)
    edges = {(f"s{rng.randrange(40)}", f"a{rng.randrange(25)}") for _ in range(160)} | {("a1", "a2"), ("t1", "a3"), ("t2", "a3"), ("t1", "t2")}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    some = spark.createDataFrame([("s1",), ("s7",), ("s7",), ("unknown",)], "src string")
    every = {tuple(r) for r in graph.negative_pairs(e, 3).collect()}
    assert {tuple(r) for r in graph.negative_pairs(e, 3, of=some).collect()} == {p for p in every if p[0] in ("s1", "s7")} != set()
    pairs = spark.createDataFrame([("s1", "s7"), ("t1", "t2"), ("s1", "a1"), ("a1", "a2"), ("a1", "a1"), ("no", "a1")] + sorted(edges)[:20], "src string, dst string")
    rows = lambda few: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in graph.link_scores(e, pairs, few).collect())
    assert rows(True) == rows(False) and len(rows(True)) == 26


def brute(docs, queries, tfidf, bigrams=False, most=None):
    """Scores of all pairs with a term in common."""
    toks = lambda t: t.split() + ([f"{a} {b}" for a, b in zip(t.split(), t.split()[1:], strict=False)] if bigrams else [])
    tf = {d: Counter(toks(t)) for d, t in docs}
    if most:
        n = Counter()
        for c in tf.values():
            n += c
        keep = set(sorted(n, key=lambda w: (-n[w], w))[:most])
        tf = {d: Counter({w: x for w, x in c.items() if w in keep}) for d, c in tf.items()}
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + x)) + 1 for w, x in df.items()}
    out = {}
    for q, t in queries:
        qt = {w: x for w, x in Counter(toks(t)).items() if w in idf}
        for d, c in tf.items():
            both = c.keys() & qt.keys()
            if both and tfidf:
                norm = lambda v: math.sqrt(sum((x * idf[w]) ** 2 for w, x in v.items()))
                out[q, d] = sum(c[w] * qt[w] * idf[w] ** 2 for w in both) / norm(c) / norm(qt)
            elif both:
                out[q, d] = sum(idf[w] for w in both)
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("kind", ["tfidf", "bigrams", "overlap"])
def test_best_documents_by_brute_force(spark, kind, k):
    """The k best of all pairs, with very common words, ties, and queries with fewer documents than k."""
    rng = random.Random(k)
    words = [f"w{int(x)}" for x in np.random.default_rng(k).zipf(1.5, 4000) if x < 300]
    docs = [(i, " ".join(["the"] * rng.randrange(1, 4) + rng.sample(words, rng.randrange(1, 25)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(5)] + [(2000, "")]
    queries = [(i, " ".join(["the"] + rng.sample(words, rng.randrange(1, 8)))) for i in range(25)] + [(50, "the"), (51, "only unknown"), (52, "rare1"), (53, "")]
    docs.append((2001, "rare1 rare1"))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    tokens = F.expr("filter(split(text, ' '), x -> x <> '')")
    d, q = frame(docs, "d"), frame(queries, "q")
    if kind == "overlap":
        index, want = retrieval.overlap_index(d, "d", q, "q", tokens, tokens), brute(docs, queries, False)
    else:
        more = {"bigrams": True, "max_features": 120} if kind == "bigrams" else {}
        index, want = retrieval.tfidf_index(d, "d", q, "q", tokens, tokens, **more), brute(docs, queries, True, kind == "bigrams", 120 if more else None)
    got = {(r.q, r["rank"]): (r.d, round(r.score, 8)) for r in retrieval.best_documents(*index, "d", "q", k).collect()}
    best = {}
    for i, _ in queries:
        mine = sorted(((-round(s, 9), x) for (a, x), s in want.items() if a == i))[:k]
        best |= {(i, n): (x, round(-s, 8)) for n, (s, x) in enumerate(mine, 1)}
    assert got.keys() == best.keys()
    for key, (x, s) in got.items():
        assert (x, pytest.approx(s, abs=1e-7)) == best[key]


def test_common_words_are_not_needed(spark):
    """Postings of a word that all documents have are joined with what the other words leave only."""
    docs = spark.range(2000).selectExpr("id AS d", "concat('the w', id % 50, if(id % 400 = 0, ' rare', '')) AS text")
    q = spark.createDataFrame([(1, "the rare w0")], "q long, text string")
    tokens = F.split("text", " ")
    postings, asked = retrieval.tfidf_index(docs, "d", q, "q", tokens, tokens)
    needed = {r.term: r.needed for r in retrieval.bounded_terms(postings, asked, "d", "q", 3).collect()}
    assert needed["rare"] and not needed["the"]


@pytest.mark.parametrize("pays", [0.0, 1.0])
@pytest.mark.parametrize("shipped", [3, 1000])
def test_best_documents_by_either_way(spark, monkeypatch, pays, shipped):
    """By bounds or by document, and with weights that are broadcast or joined, results are the same; tokens of a document in several rows are counted together."""
    monkeypatch.setattr(retrieval, "PAYS", pays)
    monkeypatch.setattr(retrieval, "SHIPPED", shipped)
    rng = random.Random(4)
    texts = [" ".join(["the"] + [f"w{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(rng.randrange(1, 20))]) for _ in range(120)]
    docs, queries = list(enumerate(texts)), [(i, " ".join(["the"] + [f"w{rng.randrange(1, 60)}" for _ in range(4)])) for i in range(12)]
    split = spark.createDataFrame([(0, w) for w in texts[0].split()], "d long, text string")
    q = spark.createDataFrame(queries, "q long, text string")
    tokens = F.split("text", " ")
    want = brute(docs, queries, True)
    got = retrieval.best_documents(*retrieval.tfidf_index(spark.createDataFrame(docs, "d long, text string"), "d", q, "q", tokens, tokens), "d", "q", 5).collect()
    assert len(got) == 60 and all(r.score == pytest.approx(want[r.q, r.d], abs=1e-9) for r in got)
    for i, _ in queries:
        best = sorted((-round(s, 9), x) for (a, x), s in want.items() if a == i)[:5]
        assert [x for _, x in best] == [r.d for r in sorted(got, key=lambda r: r["rank"]) if r.q == i]
    terms = retrieval.term_table(retrieval.grams(retrieval.dealt(split, "d"), "d", tokens), "d").collect()
    assert {r.term: r.tf for r in terms} == Counter(texts[0].split())


@pytest.mark.parametrize("kind", ["tfidf", "bigrams", "overlap"])
def test_postings_are_scored_where_they_lie(spark, monkeypatch, kind):
    """Postings lie in buckets by document: scores by document shuffle no posting. A bucket has few documents, and fewer with many queries; no table stays in the catalog."""
    monkeypatch.setattr(retrieval, "PAYS", 0.0)
    monkeypatch.setattr(retrieval, "DEALT", 50)
    docs = spark.range(600).selectExpr("id AS d", "concat('the w', id % 50, ' x', id % 7) AS text")
    q = spark.range(20).selectExpr("id AS q", "concat('the w', id, ' x', id % 3) AS text")
    tokens = F.split("text", " ")
    if kind == "overlap":
        postings, asked = retrieval.overlap_index(docs, "d", q, "q", tokens, tokens)
    else:
        postings, asked = retrieval.tfidf_index(docs, "d", q, "q", tokens, tokens, **({"bigrams": True, "max_features": 40} if kind == "bigrams" else {}))
    best = retrieval.best_documents(postings, asked, "d", "q", 3)
    assert best.count() == 60
    shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", best._jdf.queryExecution().executedPlan().toString())
    assert shuffled and all("q#" in by and "d#" not in by for by in shuffled)
    files = postings.groupBy(F.input_file_name()).agg(F.count_distinct("d").alias("n")).collect()
    assert max(r.n for r in files) < 100 and sum(r.n for r in files) == 600
    assert retrieval.bucket_count(docs, q) == 12
    monkeypatch.setattr(retrieval, "PAIRED", 400)
    assert retrieval.bucket_count(docs, q) == 30
    assert not spark.catalog.listTables()


def test_features_are_counted_by_digest(spark):
    """What is frequent is told from digests in one pass, and only such terms are counted by document; ties at the least count go by term."""
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "a b d e"), (3, "a c d f")], "d long, text string")
    terms, stats = retrieval.feature_terms(docs, "d", F.split("text", " "), True, 3)
    assert {(r.term, r.df) for r in stats.collect()} == {("a", 3), ("a b", 2), ("b", 2)}
    assert {r.term for r in terms.collect()} == {"a", "b", "a b"}
    _, every = retrieval.feature_terms(docs, "d", F.split("text", " "), True, 1000)
    assert every.count() == 14  # six tokens and eight pairs


def test_percentiles_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([None, rng.randrange(-5, 6), rng.random() * 10 ** rng.randrange(-3, 6), 7.0]), rng.randrange(1, 4)) for g in ["a", None, "b", "one"] for _ in range(400 if g != "one" else 1)]
    rows += [("none", None, 1)]
    df = spark.createDataFrame([(g, None if v is None else float(v), w) for g, v, w in rows], "g string, v double, w long")
    shares = {"low": 0.0, "q": 0.37, "med": 0.5, "p90": 0.9, "high": 1.0}
    for weight in (None, "w"):
        got = {r.g: r for r in numbering.percentiles(df, ["g"], "v", shares, weight).collect()}
        by = defaultdict(list)
        for g, v, w in rows:
            by[g] += [float(v)] * (w if weight else 1) if v is not None else []
        assert got.keys() == {g for g, v in by.items() if v}
        for g, r in got.items():
            assert [r[n] for n in shares] == pytest.approx([float(np.quantile(by[g], p)) for p in shares.values()], rel=1e-12)
    assert numbering.percentiles(df, [], "v", {"m": 0.5}).first().m == pytest.approx(float(np.median([v for _, v, _ in rows if v is not None])))
    assert numbering.percentiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_actors_by_brute_force(spark, k):
    """The k best actors of each subject of all pairs, where actors have one place, some or all."""
    rng, rows = random.Random(k), []
    homes = {f"a{i}": rng.sample(range(12), rng.choice([1, 1, 2, 12])) for i in range(60)}
    for s in range(80):
        for i in range(rng.randrange(1, 15)):
            actor = rng.choice([*homes, None])
            place = rng.choice(homes[actor]) if actor else rng.choice([*range(12), 50])
            rows.append((f"s{s}", i, f"p{place}", actor))
    rows += [("lonely", 0, "nowhere", None), ("lost", 0, None, None)]
    df = spark.createDataFrame(rows, "sid string, ord int, loc string, actor string")
    at, every, visits = Counter((p, a) for _, _, p, a in rows if a), Counter(a for *_, a in rows if a), defaultdict(Counter)
    before = {}
    for s, _, p, _ in sorted((r for r in rows if r[2]), key=lambda r: (r[0], r[1])):
        if before.get(s) != p:
            visits[s][p] += 1
        before[s] = p
    want = {}
    for s in {r[0] for r in rows}:
        scores = Counter()
        for p, times in visits[s].items():
            for (q, a), n in at.items():
                scores[a] += n * times if q == p else 0
        scores = +scores or every
        t = sum(scores.values())
        for n, (x, a) in enumerate(sorted((-x, a) for a, x in scores.items())[:k], 1):
            want[s, n] = (a, round(-x / t, 9))
    got = {(r.sid, r["rank"]): (r.actor, round(r.score, 9)) for r in forecast.link_ranked(df, "sid", "loc", "ord", "actor", k).collect()}
    assert got == want


def test_actors_of_one_place_are_not_scored_for_each_subject(spark, monkeypatch):
    """Where each actor has one place, a place hands on its k first, ties by name, and no blocks are made."""
    monkeypatch.setattr(forecast, "best_by_blocks", lambda *_: pytest.fail("actors of one place need no bounds"))
    df = spark.range(4000).selectExpr("id % 40 AS sid", "id AS ord", "concat('p', id % 7) AS loc", "concat('a', lpad(id % 7 + 7 * (id % 300), 4, '0')) AS actor")
    got = rows_of(forecast.link_ranked(df, "sid", "loc", "ord", "actor", 3), "sid", "rank", "actor")
    want = rows_of(forecast.ranked(forecast.link_scores(df, "sid", "loc", "ord", "actor"), "sid", 3, "actor", "score"), "sid", "rank", "actor")
    assert got == want and len(got) == 120


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_long_roll_outs(spark):
    df = spark.createDataFrame([("s", i, "ABC"[i % 3]) for i in range(12)], "sid string, ord int, loc string")
    grams, ctx = forecast.ngrams(df, "sid", "loc", "ord"), forecast.contexts(df, "sid", "loc", "ord")
    assert [r.w for r in forecast.next_path(grams, ctx, "sid", 8).orderBy("step").collect()] == list("ABCABCAB")

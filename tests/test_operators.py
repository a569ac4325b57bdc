"""Operators on small frames with results worked out by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from hopweave.functions import fuzzy
from hopweave.operators import evaluate, filters, forecast, geo, graph, merge, ontology, retrieval, standardize, summary, trajectory
from hopweave.operators.numbering import running_sums, spread
from hopweave.sources.catalog import Catalog


@pytest.fixture(scope="module")
def route(spark):
    rows = [("v1", "A", 1, ["p1"]), ("v1", "B", 2, ["p1", "p2"]), ("v1", "C", 3, []), ("v2", "A", 1, []), ("v2", "B", 2, ["p2"]), ("v3", "B", 1, ["p3"]), ("v3", "C", 2, [])]
    return spark.createDataFrame(rows, "sid string, loc string, ord int, perps array<string>").withColumn("chiefs", F.array().cast("array<string>"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_route_goldens(route):
    assert rows(trajectory.origin_destination(route, "sid", "loc", "ord"), "sid", "origin", "destination") == [("v1", "A", "C"), ("v2", "A", "B"), ("v3", "B", "C")]
    assert rows(trajectory.transitions(route, "sid", "loc", "ord"), "a", "b", "weight") == [("A", "B", 2), ("B", "C", 2)]
    assert rows(summary.subjects_per(route, "sid", "perps", exploded=True), "perps", "n") == [("p1", 1), ("p2", 2), ("p3", 1)]
    edges = graph.hetero_edges(route, "sid", "loc", "perps", "chiefs")
    got = {(r.src, r.dst): r.weight for r in edges.collect()}
    assert len(got) == 15 and graph.nodes_of(edges).count() == 9
    assert got["V:v1", "P:p1"] == 2 and got["P:p2", "L:B"] == 1 and got["P:p1", "L:A"] == 0.5


def test_ngram_goldens(spark, route):
    grams = forecast.ngrams(route, "sid", "loc", "ord")
    got = {(r.n, r.c2, r.c1, r.w): r["count"] for r in grams.collect()}
    assert got == {(1, None, None, "A"): 2, (1, None, None, "B"): 3, (1, None, None, "C"): 2, (2, None, "A", "B"): 2, (2, None, "B", "C"): 2, (3, "A", "B", "C"): 1}
    ctx = spark.createDataFrame([("x", "A", "B"), ("y", None, "C")], "sid string, c2 string, c1 string")
    dist = {(r.sid, r.w): round(r.prob, 6) for r in forecast.next_distribution(grams, ctx, "sid").collect()}
    assert dist == {("x", "C"): 1.0, ("y", "A"): 0.286713, ("y", "B"): 0.426573, ("y", "C"): 0.286713}


def test_link_goldens(route):
    flat = route.select("sid", "loc", "ord", F.explode_outer("perps").alias("perp"))
    got = {r.perp: round(r.score, 6) for r in forecast.link_scores(flat.withColumn("ord", F.col("ord")), "sid", "loc", "ord", "perp").where("sid = 'v2'").collect()}
    assert got == {"p1": 0.4, "p2": 0.4, "p3": 0.2}


def test_eta_goldens(spark):
    rows_ = [("v1", "A", 1, None), ("v1", "B", 2, 3.0), ("v1", "C", 3, 14.0), ("v2", "A", 1, None), ("v2", "B", 2, 7.0)]
    df = spark.createDataFrame(rows_, "sid string, loc string, ord int, d double")
    med = trajectory.duration_medians(df, "sid", "loc", "ord", F.col("d"))
    got = {(r.grain, r.a, r.b): r.med for r in med.collect()}
    assert got == {("pair", "A", "B"): 5, ("pair", "B", "C"): 14, ("place", None, "B"): 5, ("place", None, "C"): 14, ("all", None, None): 7}
    path = spark.createDataFrame([("B", "C"), ("X", "B"), ("X", "Y")], "a string, b string")
    assert rows(forecast.eta(path, "a", "b", med), "a", "b", "days") == [("B", "C", 14.0), ("X", "B", 5.0), ("X", "Y", 7.0)]


@pytest.mark.parametrize(("w", "want"), [(2, [1, 1.5, 3, 6, 12]), (4, [1.5, 2.333333, 3.75, 7.5, 9.333333]), (3, [1.5, 2.333333, 4.666667, 9.333333, 12])])
def test_rolling(spark, w, want):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 4, 8, 16])], "i int, x double")
    got = [round(r.smoothed, 6) for r in summary.rolling_mean(df, "x", w, "i").orderBy("i").collect()]
    assert got == want


def test_predicates(spark):
    df = spark.createDataFrame([(1, ["Ali"]), (2, None), (3, [])], "i int, l array<string>")
    assert [r.i for r in df.where(filters.contains_any(F.col("l"), ["ALI"])).collect()] == [1]
    assert df.where(filters.contains_any(F.col("l"), [])).count() == 3
    assert filters.equals(df, i="Any").count() == 3
    assert filters.find_column(["Lat ", "b"], ["latitude", "lat"]) == "Lat "
    with pytest.raises(ValueError, match="missing"):
        filters.require(df, ["z"])


def test_splits(spark):
    df = spark.createDataFrame([(g, i) for g in range(10) for i in range(3)], "g int, i int")
    split = evaluate.group_holdout(df, "g")
    assert split.where("split = 'test'").count() == 3
    s = evaluate.split_summary(df.join(split, "g"), "g", "split").first()
    assert (s.test_rows, s.pool_rows, s.leaks) == (9, 21, 0)
    folds = evaluate.group_kfold(df, "g").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [2] * 5
    assert rows(split, "g", "split") == rows(evaluate.group_holdout(df.repartition(7), "g"), "g", "split")


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2), (1, 0.7)], "y int, s double")
    auc = evaluate.roc_auc(df, "y", "s").first().auc
    assert math.isclose(auc, 4 / 6)
    assert 0 < evaluate.average_precision(df, "y", "s").first().ap <= 1
    assert math.isclose(evaluate.brier(df, "y", "s").first().brier, (0.01 + 0.64 + 0.09 + 0.04 + 0.09) / 5)
    ci = evaluate.bootstrap_ci(df.withColumn("k", F.monotonically_increasing_id()), "k", F.col("y"), n=50).first()
    assert 0 <= ci.low <= ci.mean <= ci.high <= 1
    assert evaluate.run_sections({"a": lambda: 1, "b": lambda: 1 / 0})["b"]["available"] is False


def test_merge(spark):
    a = spark.createDataFrame([("k1", ["x"], 1), ("k2", ["y"], 2)], "key string, l array<string>, i int")
    b = spark.createDataFrame([("k1", ["z", "x"], 3)], "key string, l array<string>, i int")
    t = merge.tag({"a": a, "b": b})
    assert [r.key for r in merge.conflicts(t, "key", ["l"]).collect()] == ["k1"]
    pick = lambda s, o: {r.key: r.l for r in merge.resolve(t, "key", ["l"], s, o, "i").collect()}
    assert pick("priority", ["b"]) == {"k1": ["z", "x"], "k2": ["y"]}
    assert pick("keep_last", []) == {"k1": ["z", "x"], "k2": ["y"]}
    assert pick("union_lists", []) == {"k1": ["x", "z"], "k2": ["y"]}
    with pytest.raises(ValueError, match="strategy"):
        pick("other", [])


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = graph.components(spark.createDataFrame(chain, "src long, dst long"))
    sizes = {r.component: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {0: 41, 100: 2, 200: 1}


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(400, 420)] + [(7, 7), (500, 401)]
    least = {v: v for e in edges for v in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = graph.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == least


def test_components_read_fewer_edges_each_round(spark, monkeypatch):
    """After a round only edges between its trees are left: of a hub's and its leaves' none."""
    seen, keep = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *how: seen.append((df.columns, df.count())) or keep(df, *how))
    star = spark.range(1, 2000).selectExpr("0L AS src", "id AS dst").unionAll(spark.range(1, 1999).selectExpr("id AS src", "id + 1 AS dst"))
    assert graph.components(star).select("component").distinct().count() == 1
    assert [n for columns, n in seen if columns == ["src", "dst"]] == [3997, 0]


@pytest.mark.parametrize("most", [0, 64])
def test_smoothed_features_by_brute_force(spark, monkeypatch, most):
    """Features as rows and as columns, nodes of a loop only, and features that reach some nodes only."""
    monkeypatch.setattr(graph, "WIDE", most)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 1), (9, 9)]
    given = [(1, "a", 1.0), (2, "b", 2.0), (5, "a", 3.0), (9, "c", 0.5), (77, "a", 1.0)]
    near = {v: {v} for e in edges for v in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    x = {(i, f): v for i, f, v in given if i in near}
    for _ in range(2):
        new = {}
        for (j, f), v in x.items():
            for i in near[j]:
                new[i, f] = new.get((i, f), 0) + v / math.sqrt(len(near[i]) * len(near[j]))
        x = new
    got = graph.smoothed_features(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(given, "id long, feature string, x double"))
    assert {(r.id, r.feature): r.x for r in got.collect()} == pytest.approx(x)


def test_triples_round_trip(spark, route):
    df = route.withColumns({"uid": F.lit('u "1"\n'), "g": F.lit("Male"), "n": F.lit(None).cast("string")})
    t = ontology.triples(df, "http://x.org/o", "sid", "uid", "loc", "ord", "perps", "chiefs", "g", "n")
    odd = spark.createDataFrame([("<a> <b> <c> .",), ("# note",), ("",), ("<a> <b> c .",)], "value string")
    assert ontology.parse_n_triples(odd).count() == 1 and [r.value for r in ontology.unread_lines(odd).collect()] == ["<a> <b> c ."]
    back = ontology.parse_n_triples(ontology.n_triples(t).withColumnRenamed("line", "value"))
    assert rows(t, "s", "p", "o", "o_kind") == rows(back, "s", "p", "o", "o_kind")
    assert ontology.union(t, back.select(t.columns)).count() == t.count()
    assert ontology.mapping("http://x.org/o", {"Victim": "urn:v"})["Victim"] == "urn:v"


def test_triples_are_distinct_where_names_are_alike(spark):
    """Subjects, visits and actors whose names come to one URI give each triple once, and only short keys are told apart."""
    data = [("A-1", "1", "X", ["p q", "p-q", None, ""], ["c"], 1), ("A", "1-1", "X", ["P Q"], None, 1), ("a", "1-1", "x", None, ["c"], 1), (None, "2", None, ["z"], ["z"], 2), ("A-1", "1", "X", ["p q"], ["c"], 1)]
    df = spark.createDataFrame(data, "sid string, ord string, loc string, perps array<string>, chiefs array<string>, k int").withColumns({"uid": F.lit("u"), "g": F.lit("f"), "n": F.lit(None).cast("string")})
    df = df.withColumn("ord", F.col("ord"))
    for override in (None, {"hasChief": "urn:has", "hasTrafficker": "urn:has"}):
        t = ontology.triples(df, "http://x.org/o", "sid", "uid", "loc", "ord", "perps", "chiefs", "g", "n", override=override)
        got = [tuple(r) for r in t.collect()]
        assert len(got) == len(set(got))
    b, at = "http://x.org/o#", "http://x.org/o#visit/a-1-1-x"
    t = ontology.triples(df, "http://x.org/o", "sid", "uid", "loc", "ord", "perps", "chiefs", "g", "n")
    got = {tuple(r)[:3] for r in t.collect()}
    assert {(p.rsplit("#")[-1], o.replace(b, "")) for s, p, o in got if s == at} == {("type", "Visit"), ("atLocation", "location/x"), ("visitOrder", "1"), ("visitOrder", "1-1")}
    assert {s.replace(b, "") for s, p, o in got if o == at} == {"victim/a-1", "victim/a"}
    assert {o for s, p, o in got if s == f"{b}trafficker/p-q" and "label" in p} == {"p q", "p-q", "P Q"}
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [s#") <= 1  # of classes, subjects and names only


@pytest.mark.parametrize("name", ["hops", "cases"])
def test_tasks_of_views_do_not_grow(spark, monkeypatch, name):
    """Where tables have more rows than the tasks of a shuffle should take, there are more tasks, and rows are the same."""
    from hopweave.plans import views

    sf = "/root/testdata/sf0.001"
    made = lambda: sorted(str(r) for r in getattr(views, name)(spark, sf).collect())
    want = made()
    monkeypatch.setattr(views, "ROWS", 500)
    df = getattr(views, name)(spark, sf)
    assert df.rdd.getNumPartitions() == -(-views.table(spark, sf, "lineitem").count() // 500) > 4
    assert made() == want


def test_options_in_one_pass(spark):
    df = spark.createDataFrame([("a", ["x", None, " "], 1), (None, None, None), (" a ", [], 2)], "c string, l array<string>, n int")
    out = filters.distinct_values(df, ["c", "n"], ["l"])
    assert {(r.kind, r.value) for r in out.collect()} == {("c", "a"), ("l", "x"), ("n", "1"), ("n", "2")} and out.count() == 4
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {(r.kind, r.value) for r in filters.distinct_values(df, [], ["l"]).collect()} == {("l", "x")}


def test_geo(spark):
    gaz = spark.createDataFrame([("Tripoli", 32.9, 13.2, "LY", 1000, ["Trablus"]), ("Asmara", 15.3, 38.9, "ER", 500, [])], "name string, lat double, lon double, country string, population long, alt_list array<string>")
    places = spark.createDataFrame([("tripoli",), ("TRABLUS",), ("Tripolli",), ("Zsmara",), ("nowhere",), (None,)], "p string")
    got = {r.p: (r.how, r.lat) for r in geo.resolve_fuzzy(places, "p", gaz, 80).collect()}
    assert got == {"tripoli": ("exact", 32.9), "TRABLUS": ("alias", 32.9), "Tripolli": ("fuzzy", 32.9), "Zsmara": ("fuzzy", 15.3)}
    assert {r.p: r.lat for r in geo.resolve_in_country(spark.createDataFrame([("Asmera, ER",)], "p string"), "p", gaz, 80).collect()} == {"Asmera, ER": 15.3}


def test_standardize(spark):
    raw = spark.createDataFrame([(0, "u1", "Asmara, Tripoli", "Ali and the Boss", "2 weeks", "female"), (1, "", "Tripoli", None, None, None)], "i int, `Unique ID (Victim)` string, `Locations Crossed` string, `Name of the Perpetrators` string, `Time Spent in Location/Cities/Places` string, Gender string")
    got = standardize.standardize(raw, "i")
    assert got.columns == list(standardize.PROCESSED)
    out = sorted((r["Serialized ID"], r["Route_Order"], r["Location"], r["Time Spent (days)"], r["Gender of Victim"]) for r in got.collect())
    assert out == [("HTV1", 1, "Asmara", 14, "Female"), ("HTV1", 2, "Tripoli", 14, "Female"), ("HTV2", 1, "Tripoli", None, "Unknown")]
    full = standardize.with_columns(standardize.normalize_headers(raw)).withColumn("Final Location", F.lit("Rome"))
    strict = standardize.standardize_strict(full, "i").where("`Serialized ID` = 'HTV1'").orderBy("Route_Order")
    assert [r.Location for r in strict.collect()] == ["Asmara", "Tripoli", "Rome"]


def test_empty(spark, route):
    none = route.where("false")
    for df in (trajectory.origin_destination(none, "sid", "loc", "ord"), summary.flows(none, "sid", "loc", "ord"), graph.hetero_edges(none, "sid", "loc", "perps", "chiefs"), graph.components(graph.hetero_edges(none, "sid", "loc", "perps", "chiefs")), trajectory.appearance_ids(none, "sid", "ord"), forecast.ngrams(none, "sid", "loc", "ord")):
        assert df.count() == 0


def test_link_split_is_whole(spark):
    """Each edge is either trained on or held out, about three tenths of them."""
    pairs = spark.range(2000).selectExpr("id AS src", "id * 7 + 1 AS dst")
    train, test = graph.split_pairs(pairs)
    a, b = set(rows(train, "src", "dst")), set(rows(test, "src", "dst"))
    assert not a & b and a | b == set(rows(pairs, "src", "dst")) and 500 < len(b) < 700


def test_negatives_by_brute_force(spark):
    """per_node actors or all there are, none linked in either direction, not the subject; no rank without them."""
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if (i == 7 and j != 8) or (i, j) == (3, 7) or (i * j) % 11 == 3}
    links |= {(i, 7) for i in range(7)}
    both = links | {(b, a) for a, b in links}
    got = rows(graph.negative_pairs(spark.createDataFrame(sorted(both), "src long, dst long"), 5), "src", "dst")
    assert len(set(got)) == len(got)
    nodes = {a for a, _ in both}
    for u in nodes:
        can = {v for v in nodes if v != u and (u, v) not in both}
        mine = {v for a, v in got if a == u}
        assert mine <= can and len(mine) == min(5, len(can))
    alone = rows(graph.negative_pairs(spark.createDataFrame(sorted(links), "src long, dst long"), 5), "src", "dst")
    assert alone and all(a != b and (a, b) not in both for a, b in alone)
    scores = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.5)], "src long, dst long, score double")
    assert rows(graph.rank_metrics(scores, scores.where("src = 1")), "src", "dst", "rank") == [(1, 2, 2)]


def names_with_errors(n: int):
    """Names, and what is left of them after some letters are changed, words swapped or added."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeilmnorstu") for _ in range(rnd.randint(3, 9)))
    names = [" ".join(word() for _ in range(rnd.choice((1, 1, 2, 3)))) for _ in range(n)]
    asked = []
    for name in names:
        letters = list(name)
        for _ in range(rnd.choice((0, 1, 1, 2, 4))):
            letters[rnd.randrange(len(letters))] = rnd.choice("abcdeilmnorstu")
        words = "".join(letters).split() + ([word()] if rnd.random() < 0.3 else [])
        rnd.shuffle(words)
        asked.append(" ".join(words))
    return names, asked


def test_similar_names_by_brute_force(spark):
    """No pair that reaches the cutoff is missing among the candidates, for either kind of similarity."""
    names, asked = names_with_errors(120)
    left = spark.createDataFrame([(q,) for q in dict.fromkeys(asked)], "k string")
    right = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name_norm string")
    for cutoff, f in ((88.0, fuzzy.indel_ratio), (84.0, fuzzy.token_set), (90.0, fuzzy.token_set)):
        got = {(r.k, r.name_norm) for r in geo.similar_candidates(left, right, cutoff).collect()}
        want = {(q, n) for q in asked for n in names if f(q, n) >= cutoff}
        assert want and want <= got, sorted(want - got)[:3]


def test_cascade_by_brute_force(spark):
    names, asked = names_with_errors(60)
    rows = [(n, float(i), float(-i), ("AA", "BB", "CC")[i % 3], 1000 * (i % 7), []) for i, n in enumerate(names)]
    gaz = spark.createDataFrame(rows, "name string, lat double, lon double, country string, population long, alt_list array<string>")
    asked = [*asked, *names[:10], *(f"{n} bb" for n in names[10:30]), "zzzzqq aa", "zzzzqq", "", None, "Lookup Me"]
    lookup = spark.createDataFrame([("lookup me", 1.5, 2.5)], "location string, lat double, lon double")
    places = spark.createDataFrame([(q,) for q in asked], "p string")
    got = {r.p: (r.how, r.lat) for r in geo.resolve_locations(places, "p", gaz, [lookup]).collect()}

    def best(q, key, among, cutoff):
        scored = [(-fuzzy.token_set(q, key(r)), -r[4], r[0]) + (r,) for r in among]
        top = min(scored, default=None, key=lambda x: x[:3])
        return top[3][1] if top and -top[0] >= cutoff else None

    for q in {x for x in asked if x}:
        k, code = q.lower(), next((w.upper() for w in q.split() if len(w) == 2), None)
        here = [r for r in rows if r[3] == code]
        exact = min(((-r[4], r[0], r) for r in rows if r[0] == k), default=None)
        if k == "lookup me":
            want = ("lookup", 1.5)
        elif exact:
            want = ("exact", exact[2][1])
        elif (x := best(k, lambda r: f"{r[0]} {r[3].lower()}", here, 84.0)) is not None:
            want = ("country", x)
        elif (x := best(k, lambda r: r[0], rows, 90.0)) is not None:
            want = ("fuzzy", x)
        elif here:
            want = ("centroid", max(here, key=lambda r: (r[4], r[0]))[1])
        else:
            want = None
        assert got.get(q) == want, q
    assert {h for h, _ in got.values()} == {"lookup", "exact", "country", "fuzzy", "centroid"}


def test_gazetteer_from_tokens(spark):
    rows = [("Khartoum", 15.5, 32.5, "Sudan", 5_000_000), ("Kassala", 15.4, 36.4, "Sudan", 400_000), ("Kufra", 24.2, 23.3, "Libya", 60_000), ("Tripoli", None, 13.2, "Libya", 1)]
    gaz = spark.createDataFrame(rows, "name string, lat double, lon double, country string, population long")
    lines = ["['Khartum' 'Sudan']", "['Kufra' 'Sudan']", "[Kasala]", "['Sudan']", "no list", "['Khartoum' 'Sudan']", "['Xyz' 'Libya']"]
    got = {r.source_tokens: (r.name, r.matched_from, r.score) for r in geo.gazetteer_from_tokens(spark.createDataFrame([(x,) for x in lines], "value string"), gaz).collect()}
    assert got["Khartoum | Sudan"] == ("Khartoum", "Khartoum", 1.05) and "Khartum | Sudan" not in got  # one row of a place
    assert got["Kasala"][0] == "Kassala" and got["Xyz | Libya"][0] == "Kufra" and "Sudan" not in got


def test_tokens_by_all_pairs(spark):
    """The best name of each line as a scan of all names in question finds it, on 2,000 names in three countries and none."""
    from difflib import SequenceMatcher

    rng = random.Random(12)
    syllables = ["ka", "ru", "mi", "to", "sha", "el", "bo", "ne", "di", "lo"]
    made = lambda: "".join(rng.choices(syllables, k=rng.randrange(2, 5)))
    gaz = [(f"{made()} {made()}" if rng.random() < 0.3 else made(), float(i), 1.0, rng.choice(["Aland", "Bland", "Cland", None]), rng.choice([None, 100, 400_000, 9_000_000])) for i in range(2000)]
    gaz = list({(r[0], r[3]): r for r in gaz}.values())
    changed = lambda w: w[:2] + rng.choice(["", "x", "ru"]) + w[3:]
    lines = [[changed(rng.choice(gaz)[0]) for _ in range(rng.randrange(1, 3))] + rng.sample(["Aland", "Bland", "Cland"], rng.choice([0, 0, 1, 2])) for _ in range(60)]
    lines += [["xq"], ["zz zz", "Aland"], ["qqqq", "Bland", "Cland"], ["Aland"], ["w", changed(gaz[5][0])]]
    want = {}
    for tokens in lines:
        only = {t for t in tokens if t in {"Aland", "Bland", "Cland"}}
        cand = [r for r in gaz if not only or r[3] in only]
        scored = []
        for pos, t in enumerate(tokens):
            if t in only:
                continue
            for r in [r for r in cand if r[0][0] == t[0]] or cand:
                scored.append((SequenceMatcher(None, t, r[0]).ratio() + min(0.05, (r[4] or 0) / 5e7), pos, r[0], r[1], t))
        scored = [x for x in scored if x[0] > 0]
        if scored:
            s, _, name, lat, token = min(scored, key=lambda x: (-x[0], x[1], x[2], x[3]))
            want[" | ".join(tokens)] = (name, lat, token, round(s, 3))
    frame = spark.createDataFrame([("[" + " ".join(f"'{t}'" for t in x) + "]",) for x in lines], "value string")
    got = geo.gazetteer_from_tokens(frame, spark.createDataFrame(gaz, "name string, lat double, lon double, country string, population long")).collect()
    mine = {r.source_tokens: (r.name, r.lat, r.matched_from, round(r.score, 3)) for r in got}
    assert all(mine[x] == want[x] for x in mine)
    # lines with the same place keep the first
    assert {(want[x][0], want[x][1]) for x in want} == {(n, lat) for n, lat, *_ in mine.values()}


def test_list_segments(spark):
    gaz = spark.createDataFrame([("a", 1.0, 1.0, 1), ("b", 2.0, 2.0, 1), ("c", 3.0, 3.0, 1)], "name string, lat double, lon double, population long")
    df = spark.createDataFrame([("x", ["a", "b", "c"], [2.0, 3.0]), ("x", ["a", "zz", "b", "c"], [5.0]), ("y", ["a", "b"], [4.0, 9.0]), ("z", ["a"], [1.0])], "s string, p array<string>, d array<double>")
    got = geo.list_segments(df, "s", "p", "d", gaz, F.lit("2020-01-01").cast("timestamp")).collect()
    days = sorted((r.s, r.step, r.a, (r.t0 - r.t0.replace(month=1, day=1)).days, (r.t1 - r.t0).days) for r in got)
    assert days == [("x", 1, "a", 0, 2), ("x", 2, "b", 2, 3), ("x", 3, "b", 0, 1), ("y", 1, "a", 0, 4)]
    assert geo.has_lists(df, "p") and not geo.has_lists(df.where("s = 'z'"), "p")


def test_next_path_by_brute_force(spark, route):
    """The roll-out takes the best place of each step, with the context moved on."""
    grams, ctx = forecast.ngrams(route, "sid", "loc", "ord"), forecast.contexts(route, "sid", "loc", "ord")
    want = {}
    for r in ctx.collect():
        c2, c1 = r.c2, r.c1
        for step in (1, 2, 3):
            best = min(forecast.predict_next_dist(grams, c2, c1).collect(), key=lambda x: (-round(x.prob, 12), x.w))
            want[r.sid, step] = (best.w, round(best.prob, 9))
            c2, c1 = c1, best.w
    assert {(r.sid, r.step): (r.w, round(r.prob, 9)) for r in forecast.next_path(grams, ctx, "sid", 3).collect()} == want


def test_running_sums_by_brute_force(spark):
    """Sums over a whole table, whatever the numbers: tiny, huge, negative, equal."""
    rnd = random.Random(3)
    values = [rnd.choice((0.0, rnd.random(), -rnd.random(), rnd.random() * 1e12, rnd.random() * 1e-9, float(rnd.randint(-3, 3)))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(5)
    for sign, order in ((1, ["x", "i"]), (-1, [F.desc("x"), "i"])):
        got = {r.i: (r.n, r.s) for r in running_sums(df, sign * spread(F.col("x")), order, {"n": F.lit(1), "s": F.col("i")}).collect()}
        total = 0
        for n, (x, i) in enumerate(sorted((sign * x, i) for i, x in enumerate(values)), 1):
            total += i
            assert got[i] == (n, total)


def test_negatives_are_complete(spark):
    edges = spark.createDataFrame([(i, j) for i in range(20) for j in range(20) if (i * j) % 3 == 1 and i != j], "src int, dst int")
    linked = {tuple(r) for r in edges.collect()}
    actors = {d for _, d in linked}
    got = graph.negative_pairs(edges, 4).collect()
    assert not any((r.src, r.dst) in linked or (r.dst, r.src) in linked or r.src == r.dst for r in got)
    for s in {a for a, _ in linked}:
        free = [a for a in actors if a != s and (s, a) not in linked and (a, s) not in linked]
        assert sum(r.src == s for r in got) == min(4, len(free))


def test_uploads_and_lists_do_not_multiply(spark):
    up = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), ("a", None, 0.0)], "location string, lat double, lon double")
    df = spark.createDataFrame([("a", None, None), ("b", 5.0, 6.0)], "p string, lat double, lon double")
    assert sorted(tuple(r) for r in geo.with_uploaded(df, "p", up).select("p", "lat", "lon").collect()) == [("a", 1.0, 2.0), ("b", 5.0, 6.0)]


def test_average_precision_divides_by_all_relevant(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 4)], "q string, d string, rank int")
    rel = spark.createDataFrame([("q", f"d{i}", 1) for i in range(1, 8)], "q string, d string, grade int")
    assert math.isclose(retrieval.ranking_metrics(ranked, rel, "q", "d", 3).first().ap, 3 / 7)


def test_splits_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(g, i) for g in range(20) for i in range(3)], "g int, i int")
    splits = evaluate.build_splits(df, "g")
    catalog = Catalog(spark, str(tmp_path / "c"))
    back = catalog.load(evaluate.persist_splits(splits, catalog, "one", "g"))
    parts = [evaluate.apply_split(df, back, "g", "test").count(), *(evaluate.apply_split(df, back, "g", "pool", k).count() for k in range(5))]
    assert sum(parts) == 60 and parts[0] == 18 and min(parts) > 0
    assert evaluate.group_column(df, "g")._jc.toString() and evaluate.group_column(df.withColumnRenamed("i", "sid"))._jc.toString().find("sid") > 0

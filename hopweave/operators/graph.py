"""Graphs as node and edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hopweave.operators import dense, linear
from hopweave.operators.numbering import by_text, numbered, running_sums, spread
from hopweave.operators.trajectory import transitions
from hopweave.sources.shared import bucketed, checkpoint_folder, written

#: Prefix of node ids by type.
TYPES = {"Victim": "V", "Location": "L", "Trafficker": "P", "Chief": "C"}


def node_id(kind: str, c: Column) -> Column:
    return F.concat(F.lit(TYPES[kind] + ":"), c.cast("string"))


def hetero_edges(df: DataFrame, subject: str, place: str, perps: str, chiefs: str) -> DataFrame:
    """src, dst, weight, etype: subject to place, perp and chief once per row; perp and chief to place 0.5 per row.

    Rows without a subject or a place, and blank names of actors, give nothing.
    """
    df = df.where((F.coalesce(F.col(subject).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(place), F.lit("")) != ""))
    kind = lambda name, etype, names: F.struct(F.lit(TYPES[name] + ":").alias("kind"), F.lit(etype).alias("etype"), names.alias("names"))
    actors = lambda c: F.col(c).cast("array<string>")
    at = F.array(kind("Location", "visited", F.array(place)), kind("Trafficker", "victim_of", actors(perps)), kind("Chief", "held_by", actors(chiefs)))
    # names become rows before they become ids, so no row's edges are held as one array
    rows = df.select(node_id("Victim", F.col(subject)).alias("v"), node_id("Location", F.col(place)).alias("loc"), F.inline(at)).select("v", "loc", "kind", "etype", F.explode("names").alias("x"))
    place_ = F.col("kind") == TYPES["Location"] + ":"
    rows = rows.withColumn("x", F.when(place_, F.col("x")).otherwise(F.trim("x"))).where("x <> ''")
    rows = rows.select("v", "loc", F.concat("kind", "x").alias("a"), "etype", place_.alias("place"))
    own = F.struct(F.col("v").alias("src"), F.col("a").alias("dst"), F.lit(1.0).alias("w"), F.col("etype").alias("etype"))
    active = F.struct(F.col("a").alias("src"), F.col("loc").alias("dst"), F.lit(0.5).alias("w"), F.lit("active_in").alias("etype"))
    each = rows.select("place", F.inline(F.array(own, active))).where("etype <> 'active_in' OR NOT place")
    return each.groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.min("etype").alias("etype"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """id, label, ntype of both ends of edges with typed ids."""
    return _typed(edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct())


def _typed(ids: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (v, k)))
    return ids.select("id", F.expr("substring(id, 3)").alias("label"), names[F.substring("id", 1, 1)].alias("ntype"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: edges at each node."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def cdf(df: DataFrame, value: str) -> DataFrame:
    """value, share: how much of the rows have at most this value. Sums run over distinct values only."""
    n = df.groupBy(value).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    rows = running_sums(n, spread(F.col(value)), [value], {"c": F.col("n")})
    return rows.crossJoin(F.broadcast(total)).select(value, (F.col("c") / F.col("total")).alias("share"))


def components(edges: DataFrame, checkpoint: bool = True) -> DataFrame:
    """id, component (its least id): nodes hook onto their least neighbour, and edges go on between what is hooked together.

    A round reads the edges that are left: those between two of its trees, each once.
    Trees are cut short by pointer jumps over the nodes. Each round is checkpointed to
    spark.checkpoint.dir, so the plan stays short and lost executors cost a round at most.
    """
    spark = edges.sparkSession
    if checkpoint:
        checkpoint_folder(spark)
    cut = (lambda df: df.checkpoint()) if checkpoint else (lambda df: df.persist())
    left, labels = cut(edges.select("src", "dst")), None
    while True:
        ends = left.selectExpr("src AS id", "dst AS other").unionAll(left.selectExpr("dst AS id", "src AS other"))
        hooks = cut(ends.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("m")))
        while True:
            jumped = cut(hooks.join(hooks.select(F.col("id").alias("m"), F.col("m").alias("root")), "m").select("id", F.col("m").alias("old"), F.col("root").alias("m")))
            hooks = jumped.select("id", "m")
            if jumped.where("old <> m").isEmpty():
                break
        if labels is None:
            labels = hooks.withColumnRenamed("m", "component")
        else:
            labels = labels.join(hooks.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
        labels = cut(labels)
        of = lambda end, name: hooks.select(F.col("id").alias(end), F.col("m").alias(name))
        left = cut(left.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if left.isEmpty():
            return labels


def descriptives(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, median and 90th percentile of the degree; with labels of components() their number and the size of the largest."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.median("degree").cast("double").alias("median_degree"), F.percentile("degree", F.lit(0.9)).alias("p90_degree"))
    out = edges.agg(F.count("*").alias("edges")).crossJoin(d)  # one row each
    return out if labels is None else out.crossJoin(component_sizes(labels))


def component_sizes(labels: DataFrame) -> DataFrame:
    """One row: components, and the nodes of the largest."""
    return labels.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))


def bipartite_edges(df: DataFrame, subject: str, actors: str) -> DataFrame:
    """src, dst: distinct pairs; of names that differ in case only, a row counts the first."""
    rows = df.select(F.col(subject).alias("src"), F.col(actors).alias("names"), F.transform(F.col(actors), F.lower).alias("low"))
    first = F.transform(F.array_distinct("low"), lambda x: F.get("names", (F.array_position("low", x) - 1).cast("int")))
    return rows.select("src", F.explode(first).alias("dst")).where("dst <> ''").distinct()


def one_mode(edges: DataFrame) -> DataFrame:
    """src < dst: pairs of actors (dst of edges) with a subject (src) in common."""
    a, b = edges.select("src", F.col("dst").alias("x")), edges.select("src", F.col("dst").alias("y"))
    return a.join(b, "src").where("x < y").select(F.col("x").alias("src"), F.col("y").alias("dst")).distinct()


def twins(both: DataFrame) -> DataFrame:
    """id, twin, size, d: nodes with the same neighbours, themselves included, share a twin (the least id of the class), its size and a degree.

    both: src, dst, each edge in both directions. Neighbourhoods are compared by their
    size and two 64-bit digests, which a set's members add to in any order.
    """
    mark = lambda c, seed: F.xxhash64(F.lit(seed), c)
    nodes = both.groupBy("src").agg(F.count("*").alias("d"), *(F.bit_xor(mark("dst", seed)).alias(f"s{seed}") for seed in (1, 2)))
    nodes = nodes.select(F.col("src").alias("id"), "d", *(F.col(f"s{seed}").bitwiseXOR(mark("src", seed)).alias(f"s{seed}") for seed in (1, 2)))
    classes = nodes.groupBy("d", "s1", "s2").agg(F.min("id").alias("twin"), F.count("*").alias("size"))
    return nodes.join(classes, ["d", "s1", "s2"]).select("id", "twin", "size", "d")


def link_scores(edges: DataFrame, pairs: DataFrame, few: bool = False) -> DataFrame:
    """src, dst, common, jaccard, adamic_adar, resource_alloc, pref_attach of pairs in an undirected graph.

    Nodes with the same neighbours, themselves included, are one node of a smaller graph,
    so what is dense because many nodes are alike costs little. There only asked pairs
    make rows: each goes through the neighbours of its end of lower degree, and looks up
    by (neighbour, other end) whether that is an edge, so the rows are the sum of the
    lower degrees, and no node makes the pairs of its neighbours. The lookup's key is a
    pair of nodes, which no hub makes hot. Of pairs that are few beside the edges, the
    ends are written, and edges of other nodes are left out before they are shuffled.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = written(both, "links")
    nodes = written(twins(both), "twins")
    of = lambda end, **names: nodes.select(F.col("id").alias(end), *(F.col(c).alias(n) for n, c in names.items()))
    # twins have the same neighbours, so one of each class tells them all; edges within a class are told by its size
    small = both.join(nodes.where("id = twin").select(F.col("id").alias("src")), "src", "left_semi").join(of("dst", t="twin"), "dst")
    small = written(small.where("src <> t").select("src", F.col("t").alias("dst")).distinct(), "classes")
    deg = small.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    asked = pairs.select("src", "dst").join(of("src", ds="d", tx="twin"), "src", "left").join(of("dst", dt="d", ty="twin"), "dst", "left")
    asked = asked.withColumns({"x": F.least("tx", "ty"), "y": F.greatest("tx", "ty")})
    ends = asked.where("src <> dst AND tx IS NOT NULL AND ty IS NOT NULL").select("x", "y").distinct()
    ends = ends.join(deg.select(F.col("id").alias("x"), F.col("n").alias("dx")), "x").join(deg.select(F.col("id").alias("y"), F.col("n").alias("dy")), "y")
    low = F.col("dx") <= F.col("dy")
    ends = ends.select("x", "y", F.when(low, F.col("x")).otherwise(F.col("y")).alias("low"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("high"))
    ends = written(ends, "ends") if few else ends
    of_ends = lambda rows, *on: rows.join(ends.select(*on).distinct(), list(on), "left_semi") if few else rows
    wedges = ends.join(small.select(F.col("src").alias("low"), F.col("dst").alias("z")), "low").select("x", "y", "high", "z")
    closing = of_ends(small.select(F.col("src").alias("z"), F.col("dst").alias("high")), "high").join(nodes.where("id = twin").select(F.col("id").alias("z"), F.col("size").alias("s"), F.col("d").alias("dz")), "z")
    found = wedges.join(closing, ["z", "high"]).groupBy("x", "y").agg(F.sum("s").alias("common"), F.sum(F.col("s") / F.log("dz")).alias("adamic_adar"), F.sum(F.col("s") / F.col("dz")).alias("resource_alloc"))
    # classes of adjacent ends are complete, and their other members are neighbours of both ends
    here = lambda end: nodes.where("id = twin").select(F.col("id").alias(end), F.col("size").alias(f"s{end}"), F.col("d").alias(f"d{end}"))
    met = of_ends(small.select(F.col("src").alias("x"), F.col("dst").alias("y")).where("x < y"), "x", "y").join(here("x"), "x").join(here("y"), "y")
    met = met.select("x", "y", (F.col("sx") - 1).alias("mx"), (F.col("sy") - 1).alias("my"), F.col("dx"), F.col("dy"))
    met = met.unionByName(nodes.where("id = twin AND size > 1").select(F.col("id").alias("x"), F.col("id").alias("y"), (F.col("size") - 2).alias("mx"), F.lit(0).cast("long").alias("my"), F.col("d").alias("dx"), F.col("d").alias("dy")))
    each = lambda worth: F.when(F.col("mx") > 0, F.col("mx") * worth("dx")).otherwise(0.0) + F.when(F.col("my") > 0, F.col("my") * worth("dy")).otherwise(0.0)
    met = met.select("x", "y", (F.col("mx") + F.col("my")).alias("common"), each(lambda d: 1 / F.log(d)).alias("adamic_adar"), each(lambda d: 1 / F.col(d)).alias("resource_alloc"))
    sums = ["common", "adamic_adar", "resource_alloc"]
    found = found.unionByName(met).groupBy("x", "y").agg(*(F.sum(c).alias(c) for c in sums))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = asked.join(found, ["x", "y"], "left").withColumns({c: F.when(F.col("src") != F.col("dst"), F.col(c)) for c in sums})
    union = zero("ds") + zero("dt") - zero("common")
    return out.select(
        "src", "dst", zero("common").alias("common"),
        F.when(union > 0, zero("common") / union).otherwise(0.0).alias("jaccard"),
        F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"),
        F.coalesce("resource_alloc", F.lit(0.0)).alias("resource_alloc"),
        (zero("ds") * zero("dt")).alias("pref_attach"),
    )


#: A graph is dense where pairs of actors by subject, of which one is counted again for each subject, are at least this share of the squared number of actors.
DENSE = 1 / 500


def shared_scores(edges: DataFrame, measure: str) -> DataFrame:
    """src < dst, score: pairs of actors (dst of edges) with a subject (src) in common, by link_scores' measure in the graph of these pairs.

    Of a dense graph, where rows of common neighbours would be near the third power of
    the actors, blocks of its matrix are multiplied; a sparse one goes through its rows.
    """
    nodes, lists = dense.members(edges)
    n = nodes.count()
    pairs = lists.agg(F.sum(F.size("l").cast("double") * (F.size("l") - 1) / 2)).head()[0] or 0
    if pairs and pairs >= DENSE * n * n:
        return dense.linked_scores(nodes, lists, n, measure)
    pairs = written(one_mode(edges), "pairs")
    return link_scores(pairs, pairs).select("src", "dst", F.col(measure).alias("score"))


def _number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a md5 as a number, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def split_pairs(pairs: DataFrame, fraction: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and held-out edges, which together are all edges: an edge is held out by the md5 of both ends."""
    held = _number(F.concat_ws(":", F.lit(seed), "src", "dst"), 8) < int(fraction * 2**32)
    return pairs.where(~held), pairs.where(held)


def negative_pairs(edges: DataFrame, per_node: int, seed: int = 42, of: DataFrame | None = None) -> DataFrame:
    """src, dst: per_node actors (dst of edges), or all if there are fewer, that are not linked to each subject (of those in `of`) in either direction.

    Actors stand on a ring by a seeded md5, and each subject looks at those after its
    own place: as many as it has links, itself and per_node more, so that enough remain
    and no product of all subjects with all actors is made.
    """
    key = lambda c: F.concat_ws(":", F.lit(seed), c)
    actors = edges.select("dst").where("dst IS NOT NULL").distinct().withColumn("h", F.md5(key("dst").cast("binary")))
    ring = numbered(actors, by_text(F.col("h")), ["h", "dst"], "i").select("dst", (F.col("i") - 1).alias("place"))
    n = ring.agg(F.count("*").alias("n"))  # one row
    linked = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    linked = (linked if of is None else linked.join(of.select("src").distinct(), "src", "left_semi")).distinct()
    subjects = linked.join(edges.select("src").distinct(), "src", "left_semi").groupBy("src").agg(F.count("*").alias("d")).crossJoin(F.broadcast(n))
    many = F.least("n", F.col("d") + 1 + per_node)
    looks = subjects.select("src", "n", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("step"))
    looks = looks.select("src", "step", ((_number(key("src"), 15) + F.col("step")) % F.col("n")).alias("place"))
    drawn = looks.join(ring, "place").where("src <> dst").join(linked, ["src", "dst"], "left_anti")
    return drawn.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("step"))).where(F.col("k") <= per_node).select("src", "dst")


def rank_metrics(positives: DataFrame, negatives: DataFrame, *by: str) -> DataFrame:
    """by, src, dst, rank of each scored positive among its subject's negatives; ties at nine digits count against it; without negatives there is no rank."""
    scored = positives.select(*by, "src", "dst", "score").join(negatives.select(*by, "src", F.col("score").alias("s")), [*by, "src"])
    worse = F.count(F.when(F.round("s", 9) >= F.round("score", 9), 1))
    return scored.groupBy(*by, "src", "dst").agg((1 + worse).alias("rank"))


HEURISTICS = ("jaccard", "adamic_adar", "resource_alloc", "pref_attach")


def known_pairs(train: DataFrame, held: DataFrame, most: int | None = 300, seed: int = 42) -> DataFrame:
    """src, dst: edges that are in both tables, so that both ends are known; with `most`, that many in the order of a seeded md5."""
    both = train.select("src", "dst").distinct().join(held.select("src", "dst").distinct(), ["src", "dst"])
    key = F.md5(F.concat_ws(":", F.lit(seed), "src", "dst").cast("binary"))
    return both if most is None else both.orderBy(key, "src", "dst").limit(most)


def evaluate_links(train: DataFrame, held: DataFrame, per_node: int = 30, most: int | None = 300, seed: int = 42) -> DataFrame:
    """heuristic, hits_1, hits_3, hits_5, mrr, n_eval: how known edges rank among negatives of their subject, by scores of the train graph.

    Ranks are pessimistic: the edge comes after negatives of the same score. Negatives are
    drawn for the subjects of those edges only, and all pairs are scored together, so the
    graph is gone through once.
    """
    positives = written(known_pairs(train, held, most, seed), "positives")
    mirrored = train.select("src", "dst").unionAll(train.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    negatives = negative_pairs(mirrored, per_node, seed, positives)
    pairs = written(positives.withColumn("known", F.lit(True)).unionByName(negatives.withColumn("known", F.lit(False))), "pairs")
    scores = written(link_scores(train, pairs, few=most is not None), "scores").join(pairs, ["src", "dst"])
    each = scores.select("src", "dst", "known", F.inline(F.array(*(F.struct(F.lit(h).alias("heuristic"), F.col(h).cast("double").alias("score")) for h in HEURISTICS))))
    ranks = rank_metrics(each.where("known"), each.where("NOT known"), "heuristic")
    hits = (F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_{k}") for k in (1, 3, 5))
    return ranks.groupBy("heuristic").agg(*hits, F.avg(1 / F.col("rank")).alias("mrr"), F.count("*").alias("n_eval"))


def hierarchy_edges(df: DataFrame, chain: Column) -> DataFrame:
    """src, dst, weight: adjacent members of chains of command."""
    rows = df.select(chain.alias("c")).where(F.size("c") >= 2)
    pairs = rows.select(F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("src"), F.expr("slice(c, 2, size(c) - 1)").alias("dst"))).alias("e"))
    return pairs.select("e.src", "e.dst").where("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def location_network(df: DataFrame, subject: str, place: str, order: str, actors: str, max_nodes: int = 300, min_actors: int = 20, victims: bool = True) -> DataFrame:
    """src, dst, weight, etype: moves between places, actors at places and subjects at places, within a budget of nodes.

    First come the most visited places, up to the budget; then the actors with most rows
    at these places, as many as the budget leaves beside all subjects, but min_actors at
    least; then the subjects with most places, as many as it leaves then. Budgets are
    counts of a few rows, read on the driver.
    """
    rows = df.where(F.coalesce(F.col(place), F.lit("")) != "")
    keep = rows.groupBy(place).agg(F.count("*").alias("n")).orderBy(F.desc("n"), place).limit(max_nodes).select(place)
    at = rows.select(place, F.explode(actors).alias("actor")).where(F.trim("actor") != "").groupBy("actor", place).agg(F.count("*").alias("n")).join(keep, place, "left_semi")
    who = rows.select(subject, place).distinct()
    n_places, n_subjects = keep.count(), who.select(subject).distinct().count() if victims else 0
    scores = at.groupBy("actor").agg(F.sum("n").alias("s"))
    left = max(0, max_nodes - n_places - n_subjects)
    some = scores.orderBy(F.desc("s"), "actor").limit(max(min_actors, left)).select("actor")
    name = lambda kind, c: node_id(kind, F.col(c))
    both = transitions(df, subject, place, order).join(keep.withColumnRenamed(place, "a"), "a", "left_semi").join(keep.withColumnRenamed(place, "b"), "b", "left_semi")
    out = both.select(name("Location", "a").alias("src"), name("Location", "b").alias("dst"), "weight", F.lit("move").alias("etype"))
    out = out.unionAll(at.join(some, "actor", "left_semi").select(name("Trafficker", "actor"), name("Location", place), "n", F.lit("active_in")))
    if victims:
        first = who.groupBy(subject).agg(F.count("*").alias("n")).orderBy(F.desc("n"), subject)
        n_actors = some.count()
        if n_places + n_actors + n_subjects > max_nodes:
            first = first.limit(max(0, max_nodes - n_places - n_actors))
        seen = who.join(first.select(subject), subject, "left_semi").join(keep, place, "left_semi")
        out = out.unionAll(seen.select(name("Victim", subject), name("Location", place), F.lit(1).cast("long"), F.lit("visited")))
    return out


#: Features that are kept as columns of one row for each node; of more, each is a row.
WIDE = 64


def adjacent(edges: DataFrame) -> DataFrame:
    """src, dst: each edge in both directions, once, in buckets by src; written, since it is read by every step over the graph, none of which shuffles it."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = edges.select(F.inline(F.array(pair("src", "dst"), pair("dst", "src"))))
    return bucketed(both.repartition(n, "src").distinct(), "adjacent", "src", n)


def smoothed_features(edges: DataFrame, features: DataFrame, rounds: int = 2) -> DataFrame:
    """id, feature, x: features after `rounds` products with the normalised adjacency (self loops added), as joins.

    A node's features, up to WIDE of them, are one row, so a round makes a row for each
    edge, not for each edge and feature. The weight of an edge is a product of one factor
    for each end, so degrees are joined to nodes only.
    """
    adj = adjacent(edges)
    return _smoothed(adj, _sizes(adj), features, rounds)


def _sizes(adj: DataFrame) -> DataFrame:
    """id, n: neighbours of each node, itself included."""
    return written(adj.groupBy("src").agg((1 + F.count(F.when(F.col("src") != F.col("dst"), 1))).alias("n")).withColumnRenamed("src", "id"), "degree")


def _smoothed(adj: DataFrame, sizes: DataFrame, features: DataFrame, rounds: int) -> DataFrame:
    degree = sizes.select("id", (1 / F.sqrt("n")).alias("r"))
    names = [row["feature"] for row in features.select("feature").distinct().limit(WIDE + 1).collect()]
    if not names:
        return features.select("id", "feature", F.col("x").cast("double").alias("x")).limit(0)
    if len(names) > WIDE:
        x, by, columns, held = features.select("id", "feature", F.col("x").cast("double").alias("x")), ["feature"], ["x"], []
    else:
        names.sort()
        by, columns, held = [], [f"x{i}" for i in range(len(names))], ["held"]
        x = features.groupBy("id").agg(*(F.sum(F.when(F.col("feature") == n, F.col("x").cast("double"))).alias(c) for n, c in zip(names, columns, strict=True)))
        # bit i tells whether a node has feature i, so sums need not tell none from 0, and their code stays short enough to be compiled
        bits = (F.when(F.col(c).isNotNull(), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns))
        x = x.select("id", reduce(lambda p, q: p.bitwiseOR(q), bits).alias("held"), *columns)
    for _ in range(rounds):
        near = x.join(degree, "id").select(F.col("id").alias("src"), *by, *held, *((F.coalesce(c, F.lit(0.0)) * F.col("r") if held else F.col(c) * F.col("r")).alias(c) for c in columns))
        each = adj.where("src <> dst").join(near.hint("shuffle_hash"), "src").select(F.col("dst").alias("id"), *by, *held, *columns).unionAll(near)
        sums = each.groupBy("id", *by).agg(*(F.bit_or(c).alias(c) for c in held), *(F.sum(c).alias(c) for c in columns))
        x = sums.join(degree, "id").select("id", *by, *held, *((F.col(c) * F.col("r")).alias(c) for c in columns))
    if by:
        return x
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.when(F.getbit("held", F.lit(i)) == 1, F.col(c)).alias("x")) for i, (n, c) in enumerate(zip(names, columns, strict=True))))
    return x.select("id", F.inline(each)).where("x IS NOT NULL")


def node_features(edges: DataFrame, nodes: DataFrame, known: Column, rounds: int = 2) -> DataFrame:
    """id, feature, x: what a node's neighbourhood says of it, without its own type.

    type:T is the share of known neighbours of a type among all neighbours; degree:b,
    with b the whole logarithm of the degree, is smoothed over `rounds` steps of the
    normalised adjacency. Features are a few dozen, whatever the graph.
    """
    adj = adjacent(edges)
    return _features(adj, _sizes(adj), nodes, known, rounds)


def _features(adj: DataFrame, sizes: DataFrame, nodes: DataFrame, known: Column, rounds: int) -> DataFrame:
    both, deg = adj.where("src <> dst"), sizes.where("n > 1").select("id", (F.col("n") - 1).alias("d"))
    types = nodes.where(known).select(F.col("id").alias("src"), F.concat(F.lit("type:"), "ntype").alias("feature"))
    shares = both.join(types.hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id"), "feature").agg(F.count("*").alias("n")).join(deg, "id").select("id", "feature", (F.col("n") / F.col("d")).alias("x"))
    buckets = deg.select("id", F.concat(F.lit("degree:"), F.floor(F.log2("d")).cast("string")).alias("feature"), F.lit(1.0).alias("x"))
    return shares.unionByName(_smoothed(adj, sizes, buckets, rounds))


def with_vectors(rows: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """rows (id, ...) with the vector `features` of the values of named features; a feature that a node lacks is 0."""
    held = features.where(F.col("feature").isin(names)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("__m"))
    values = F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at("__m", n), F.lit(0.0)))
    return rows.join(held, "id", "left").withColumn("features", array_to_vector(values)).drop("__m")


def classify_nodes(edges: DataFrame, nodes: DataFrame | None, known: Column, rounds: int = 2, **how) -> tuple[linear.Classifier, DataFrame]:
    """A classifier of node types in the linear form of a graph network, and the other nodes with best (the likeliest types).

    The network's two layers of weights and its activation are left out: features are
    smoothed over the graph, and logistic regression is trained on the known nodes.
    Without nodes they are those of the edges, by their typed ids. Edges are read once,
    and the nodes' vectors, which training and the ranks go through again, are written.
    """
    adj = adjacent(edges)
    sizes = _sizes(adj)
    nodes = _typed(sizes.select("id")) if nodes is None else nodes
    features = written(_features(adj, sizes, nodes, known, rounds), "features")
    names = sorted(r["feature"] for r in features.select("feature").distinct().collect())  # a few dozen
    rows = written(with_vectors(nodes.select("id", "ntype", known.alias("__known")), features, names), "vectors")
    model = linear.fit(rows.where("__known"), "ntype", **how)
    return model, model.ranked(rows.where("NOT __known").drop("__known"), len(TYPES))

"""Queries of graphs and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.functions import text as T
from hopweave.operators import graph as G
from hopweave.operators import linear
from hopweave.operators import ontology as O
from hopweave.plans.register import query
from hopweave.plans.views import ACTOR_EDGES_SQL, GAZETTEER_SQL, MEETINGS_SQL, actor_edges, cases, gazetteer, meetings, table, with_cases
from hopweave.sources.shared import written

#: Cases of which some lack a place, and whose perps have blank and padded names.
_FLAWED = """, flawed AS (SELECT victim, chiefs, CASE WHEN case_id % 7 = 0 THEN NULL WHEN case_id % 11 = 0 THEN '' ELSE loc END AS loc,
  list_append(perps, CASE case_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' Extra ' END) AS perps FROM cases),
kept AS (SELECT victim, loc, list_filter(list_transform(perps, lambda x: trim(x)), lambda x: x <> '') AS perps, chiefs FROM flawed WHERE loc <> '')
"""


def flawed(spark, d):
    last = F.expr("CASE case_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN ' Extra ' END")
    place = F.expr("CASE WHEN case_id % 7 = 0 THEN NULL WHEN case_id % 11 = 0 THEN '' ELSE loc END")
    return cases(spark, d).select("victim", "chiefs", place.alias("loc"), F.concat("perps", F.array(last)).alias("perps"))


_EDGES = _FLAWED + """, e AS (SELECT src, dst, sum(w) AS weight, min(etype) AS etype FROM (
  SELECT 'V:' || victim AS src, 'L:' || loc AS dst, 1e0 AS w, 'visited' AS etype FROM kept
  UNION ALL SELECT 'V:' || victim, 'P:' || x, 1e0, 'victim_of' FROM (SELECT victim, loc, unnest(perps) AS x FROM kept)
  UNION ALL SELECT 'V:' || victim, 'C:' || x, 1e0, 'held_by' FROM (SELECT victim, loc, unnest(chiefs) AS x FROM kept)
  UNION ALL SELECT 'P:' || x, 'L:' || loc, 0.5e0, 'active_in' FROM (SELECT victim, loc, unnest(perps) AS x FROM kept)
  UNION ALL SELECT 'C:' || x, 'L:' || loc, 0.5e0, 'active_in' FROM (SELECT victim, loc, unnest(chiefs) AS x FROM kept)) GROUP BY 1, 2),
n AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)
"""


def with_edges(sql: str) -> str:
    return with_cases("").rstrip() + _EDGES + sql


def edges_of(spark, d):
    return G.hetero_edges(flawed(spark, d), "victim", "loc", "perps", "chiefs")


@query("hetero_edges", with_edges("SELECT src, dst, weight, etype FROM e"))
def _(spark, d):
    return edges_of(spark, d)


@query("hetero_nodes", with_edges("SELECT DISTINCT id, substr(id, 3) AS label, CASE id[1] WHEN 'V' THEN 'Victim' WHEN 'L' THEN 'Location' WHEN 'P' THEN 'Trafficker' ELSE 'Chief' END AS ntype FROM n"))
def _(spark, d):
    return G.nodes_of(edges_of(spark, d))


@query("degree", with_edges("SELECT id, count(*) AS degree FROM n GROUP BY 1"))
def _(spark, d):
    return G.degrees(edges_of(spark, d))


@query("degree_cdf", with_edges("SELECT degree, round(sum(n) OVER (ORDER BY degree) / sum(n) OVER (), 6) AS share FROM (SELECT degree, count(*) AS n FROM (SELECT count(*) AS degree FROM n GROUP BY id) GROUP BY 1)"))
def _(spark, d):
    return G.cdf(G.degrees(edges_of(spark, d)), "degree").withColumn("share", F.round("share", 6))


@query("graph_descriptives", with_edges("SELECT (SELECT count(*) FROM e) AS edges, count(*) AS nodes, median(degree) AS median_degree, round(quantile_cont(degree, 0.9), 6) AS p90_degree FROM (SELECT CAST(count(*) AS DOUBLE) AS degree FROM n GROUP BY id)"))
def _(spark, d):
    return G.descriptives(edges_of(spark, d)).withColumn("p90_degree", F.round("p90_degree", 6))


@query("bipartite_edges", with_cases("SELECT DISTINCT victim AS src, unnest(perps) AS dst FROM cases"))
def _(spark, d):
    return G.bipartite_edges(cases(spark, d), "victim", "perps")


#: Scores of the pairs in table `asked`, in the undirected graph of table g.
_SCORES = """u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), deg AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1),
c AS (SELECT p.src, p.dst, count(*) AS common, sum(1 / ln(deg.d)) AS aa, sum(1e0 / deg.d) AS ra FROM asked p JOIN u a ON p.src = a.src JOIN u z ON p.dst = z.src AND a.dst = z.dst JOIN deg ON deg.id = a.dst GROUP BY 1, 2),
o AS (SELECT p.src, p.dst, coalesce(common, 0) AS common, coalesce(aa, 0) AS aa, coalesce(ra, 0) AS ra, coalesce(s.d, 0) AS ds, coalesce(t.d, 0) AS dt
  FROM asked p LEFT JOIN c ON p.src = c.src AND p.dst = c.dst LEFT JOIN deg s ON s.id = p.src LEFT JOIN deg t ON t.id = p.dst)
"""
_MET = f"WITH b AS ({MEETINGS_SQL}), p AS (SELECT DISTINCT x.actor AS src, y.actor AS dst FROM b x JOIN b y ON x.event = y.event AND x.actor < y.actor)"
_SHARED = f"WITH b AS ({ACTOR_EDGES_SQL}), p AS (SELECT DISTINCT x.actor AS src, y.actor AS dst FROM b x JOIN b y ON x.victim = y.victim AND x.actor < y.actor)"
_PAIRS = _SHARED + ", g AS (SELECT src, dst FROM p), asked AS (SELECT src, dst FROM p), " + _SCORES
_JACCARD = "CASE WHEN ds + dt - common > 0 THEN common / (ds + dt - common) ELSE 0 END"


def met(spark, d, rows=None):
    """Pairs of actors that do something for one subject on one day."""
    return G.one_mode((meetings(spark, d) if rows is None else rows).select(F.col("event").alias("src"), F.col("actor").alias("dst")))


def scored_pairs(spark, d, measure):
    """Scores of all pairs of actors that do something for one subject."""
    return G.shared_scores(actor_edges(spark, d).toDF("src", "dst"), measure)


for _name, _sql, _column in (
    ("link_jaccard", _JACCARD, "jaccard"),
    ("link_adamic_adar", "aa", "adamic_adar"),
    ("link_resource_alloc", "ra", "resource_alloc"),
):

    @query(_name, _PAIRS + f"SELECT src, dst, round({_sql}, 6) AS score FROM o")
    def _(spark, d, column=_column):
        return scored_pairs(spark, d, column).withColumn("score", F.round("score", 6))


@query("link_pref_attach", _PAIRS + "SELECT src, dst, ds * dt AS score FROM o")
def _(spark, d):
    return scored_pairs(spark, d, "pref_attach")


def _negatives_sql(edges: str, subjects: str, per_node: int) -> str:
    """Tables ring, both_ways and neg: the first actors after a subject on the ring that are not linked to it."""
    return f"""both_ways AS (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges}),
ring AS (SELECT dst, row_number() OVER (ORDER BY md5('42:' || dst), dst) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT dst FROM both_ways)),
neg AS (SELECT src, dst FROM (SELECT s.src, r.dst, row_number() OVER (PARTITION BY s.src ORDER BY (r.place - CAST('0x' || substr(md5('42:' || s.src), 1, 15) AS BIGINT) % r.n + r.n) % r.n) AS k
  FROM {subjects} s, ring r WHERE r.dst <> s.src AND NOT EXISTS (SELECT 1 FROM both_ways l WHERE l.src = s.src AND l.dst = r.dst)) WHERE k <= {per_node})"""


@query(
    "link_rank",
    _MET
    + f""", k AS (SELECT src, dst, CAST('0x' || substr(md5('42:' || src || ':' || dst), 1, 8) AS BIGINT) < {int(0.3 * 2**32)} AS held FROM p),
g AS (SELECT src, dst FROM k WHERE NOT held), nodes AS (SELECT src FROM p UNION SELECT dst FROM p), {_negatives_sql("p", "nodes", 30)},
test AS (SELECT src, dst FROM k WHERE held AND src IN (SELECT src FROM neg)), asked AS (SELECT src, dst FROM test UNION ALL SELECT src, dst FROM neg), """
    + _SCORES
    + "SELECT t.src, t.dst, 1 + count(*) FILTER (round(n.aa, 9) >= round(t.aa, 9)) AS rank FROM o t JOIN test USING (src, dst) JOIN (SELECT o.* FROM o JOIN neg USING (src, dst)) n ON n.src = t.src GROUP BY 1, 2",
)
def _(spark, d):
    pairs = written(met(spark, d), "pairs")
    train, test = G.split_pairs(pairs)
    negatives = written(G.negative_pairs(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), 30), "negatives")
    scored = lambda p: G.link_scores(train, p).select("src", "dst", F.col("adamic_adar").alias("score"))
    # positives without negatives have no rank and are not scored
    test = test.join(negatives.select("src").distinct(), "src", "left_semi")
    return G.rank_metrics(scored(test), scored(negatives))


_HELD = "CAST('0x' || substr(md5('42:' || event), 1, 8) AS BIGINT) % 10 < 3"


@query(
    "link_eval",
    f"""WITH b AS ({MEETINGS_SQL}), p AS (SELECT x.actor AS src, y.actor AS dst, x.event FROM b x JOIN b y ON x.event = y.event AND x.actor < y.actor),
g AS (SELECT DISTINCT src, dst FROM p WHERE NOT {_HELD}), pos AS (SELECT src, dst FROM g JOIN (SELECT DISTINCT src, dst FROM p WHERE {_HELD}) USING (src, dst) ORDER BY md5('42:' || src || ':' || dst), src, dst LIMIT 300),
who AS (SELECT DISTINCT src FROM pos), {_negatives_sql("g", "who", 30)}, asked AS (SELECT src, dst FROM pos UNION ALL SELECT src, dst FROM neg), """
    + _SCORES
    + f""", s AS (SELECT src, dst, unnest(['jaccard', 'adamic_adar', 'resource_alloc', 'pref_attach']) AS heuristic, unnest([round(CAST({_JACCARD} AS DOUBLE), 9), round(aa, 9), round(ra, 9), CAST(ds * dt AS DOUBLE)]) AS score FROM o),
r AS (SELECT t.heuristic, t.src, t.dst, 1 + count(*) FILTER (n.score >= t.score) AS rank FROM (SELECT s.* FROM s JOIN pos USING (src, dst)) t JOIN (SELECT s.* FROM s JOIN neg USING (src, dst)) n ON n.src = t.src AND n.heuristic = t.heuristic GROUP BY 1, 2, 3)
SELECT heuristic, round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0 END), 6) AS hits_1, round(avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0 END), 6) AS hits_3, round(avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0 END), 6) AS hits_5, round(avg(1e0 / rank), 6) AS mrr, count(*) AS n_eval FROM r GROUP BY 1""",
)
def _(spark, d):
    rows = meetings(spark, d)
    held = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), "event").cast("binary")), 1, 8), 16, 10).cast("long") % 10 < 3
    train, test = (written(met(spark, d, rows.where(c)), "pairs") for c in (~held, held))
    return G.evaluate_links(train, test).withColumns({c: F.round(c, 6) for c in ("hits_1", "hits_3", "hits_5", "mrr")})


_MAX_NODES, _MIN_ACTORS = 40, 10


@query(
    "location_network",
    with_cases("").rstrip()
    + f""", visits AS (SELECT loc, count(*) AS n FROM cases GROUP BY 1), keep AS (SELECT loc FROM visits ORDER BY n DESC, loc LIMIT {_MAX_NODES}),
c AS (SELECT * FROM (SELECT victim, loc, case_id, lag(loc) OVER (PARTITION BY victim ORDER BY case_id) AS before FROM cases) WHERE before IS NULL OR before <> loc),
m AS (SELECT victim, loc AS a, lead(loc) OVER (PARTITION BY victim ORDER BY case_id) AS b FROM c),
p AS (SELECT x AS actor, loc, count(*) AS n FROM (SELECT loc, unnest(perps) AS x FROM cases) GROUP BY 1, 2),
who AS (SELECT DISTINCT victim, loc FROM cases), k AS (SELECT (SELECT count(*) FROM keep) AS places, (SELECT count(DISTINCT victim) FROM who) AS subjects),
chosen AS (SELECT actor FROM p GROUP BY 1 ORDER BY sum(n) DESC, actor LIMIT (SELECT greatest({_MIN_ACTORS}, {_MAX_NODES} - places - subjects) FROM k)),
people AS (SELECT victim FROM who GROUP BY 1 ORDER BY count(*) DESC, victim LIMIT (SELECT CASE WHEN places + subjects + (SELECT count(*) FROM chosen) > {_MAX_NODES} THEN greatest(0, {_MAX_NODES} - places - (SELECT count(*) FROM chosen)) ELSE subjects END FROM k))
SELECT 'L:' || a AS src, 'L:' || b AS dst, count(DISTINCT victim) AS weight, 'move' AS etype FROM m WHERE b IS NOT NULL AND a IN (SELECT loc FROM keep) AND b IN (SELECT loc FROM keep) GROUP BY 1, 2
UNION ALL SELECT 'P:' || actor, 'L:' || loc, n, 'active_in' FROM p WHERE actor IN (SELECT actor FROM chosen) AND loc IN (SELECT loc FROM keep)
UNION ALL SELECT 'V:' || victim, 'L:' || loc, 1, 'visited' FROM who WHERE victim IN (SELECT victim FROM people) AND loc IN (SELECT loc FROM keep)""",
)
def _(spark, d):
    return G.location_network(cases(spark, d), "victim", "loc", "case_id", "perps", _MAX_NODES, _MIN_ACTORS)


#: Least labels, handed on to neighbours in rounds; the test graphs are a few steps wide.
_LABELS = ", u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT DISTINCT id, id AS c FROM n)" + "".join(
    f", l{i} AS (SELECT l.id, least(min(l.c), min(m.c)) AS c FROM l{i - 1} l JOIN u ON u.a = l.id JOIN l{i - 1} m ON m.id = u.b GROUP BY 1)" for i in range(1, 7)
)


@query("components", with_edges("").rstrip() + _LABELS + " SELECT id, c AS component FROM l6")
def _(spark, d):
    return G.components(edges_of(spark, d))


@query("component_sizes", with_edges("").rstrip() + _LABELS + " SELECT count(*) AS components, max(n) AS largest FROM (SELECT c, count(*) AS n FROM l6 GROUP BY 1)")
def _(spark, d):
    return G.component_sizes(G.components(edges_of(spark, d)))


_CHAIN = "p_brand || ' -> ' || p_type || ' > ' || p_type || ', NGO and ' || p_name"


@query(
    "hierarchy_edges",
    f"""WITH c AS (SELECT p_partkey, string_split_regex({_CHAIN}, '\\s*(->|>|,|\\band\\b)\\s*') AS parts FROM part),
t AS (SELECT p_partkey, list_transform(list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> ''), lambda p: CASE WHEN upper(p) = p AND lower(p) <> p AND length(p) <= 5 THEN p ELSE array_to_string(list_transform(regexp_extract_all(p, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') END) AS l FROM c),
q AS (SELECT list_filter(l, lambda p, i: list_position(l, p) = i) AS l FROM t)
SELECT src, dst, count(*) AS weight FROM (SELECT unnest(l[:-2]) AS src, unnest(l[2:]) AS dst FROM q WHERE len(l) >= 2) GROUP BY 1, 2""",
)
def _(spark, d):
    return G.hierarchy_edges(table(spark, d, "part"), T.hierarchy_chain(F.expr(_CHAIN)))


@query("victim_actors", with_cases("SELECT DISTINCT kind, value FROM (SELECT 'perp' AS kind, unnest(perps) AS value FROM cases WHERE victim = 'C7' UNION ALL SELECT 'chief', unnest(chiefs) FROM cases WHERE victim = 'C7')"))
def _(spark, d):
    rows = cases(spark, d).where("victim = 'C7'")
    return rows.select(F.lit("perp").alias("kind"), F.explode("perps").alias("value")).unionAll(rows.select(F.lit("chief"), F.explode("chiefs"))).distinct()


@query("actor_victims", with_cases("SELECT DISTINCT victim FROM cases WHERE list_contains(chiefs, (SELECT max(p_brand) FROM part))"))
def _(spark, d):
    name = table(spark, d, "part").agg(F.max("p_brand").alias("name"))  # one row
    return cases(spark, d).crossJoin(F.broadcast(name)).where(F.array_contains("chiefs", F.col("name"))).select("victim").distinct()


@query("location_explorer", with_cases("SELECT DISTINCT kind, value FROM (SELECT 'victim' AS kind, victim AS value FROM cases WHERE loc = '1-URGENT' UNION ALL SELECT 'perp', unnest(perps) FROM cases WHERE loc = '1-URGENT' UNION ALL SELECT 'chief', unnest(chiefs) FROM cases WHERE loc = '1-URGENT')"))
def _(spark, d):
    rows = cases(spark, d).where("loc = '1-URGENT'")
    parts = rows.select(F.lit("victim").alias("kind"), F.col("victim").alias("value"))
    return parts.unionAll(rows.select(F.lit("perp"), F.explode("perps"))).unionAll(rows.select(F.lit("chief"), F.explode("chiefs"))).distinct()


_BASE = "http://example.org/onto"
_SLUG = "CASE WHEN {0} = '' THEN 'unk' ELSE {0} END"


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}_-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g')"


def _triples_sql() -> str:
    b = _BASE + "#"
    v, loc = f"'{b}victim/' || {_slug('victim')}", f"'{b}location/' || {_slug('loc')}"
    visit = "'" + b + "visit/' || " + _slug("victim || '-' || case_id || '-' || loc")
    mode = lambda c: f"(SELECT victim, {c} AS x FROM (SELECT victim, {c}, row_number() OVER (PARTITION BY victim ORDER BY count(*) DESC, {c}) AS r FROM cases GROUP BY 1, 2) WHERE r = 1)"
    part = lambda s, p, o, frm, kind="uri", of="": f"SELECT {s} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o, '{kind}' AS o_kind, '{of}' AS o_type FROM {frm}"
    out = [part(f"'{b}{c}'", O.RDF_TYPE, f"'{O.RDFS_CLASS}'", "(SELECT 1)") for c in O.CLASSES]
    out += [part(v, O.RDF_TYPE, f"'{b}Victim'", "cases"), part(v, b + "hasSerializedId", "victim", "cases", "literal")]
    out += [part(v, b + p, "x", mode(c), "literal") for p, c in (("hasUniqueId", "case_id"), ("hasGender", "gender"), ("hasNationality", "nat"))]
    out += [part(visit, O.RDF_TYPE, f"'{b}Visit'", "cases"), part(v, b + "hasVisit", visit, "cases"), part(visit, b + "atLocation", loc, "cases"), part(visit, b + "visitOrder", "case_id", "cases", "literal", O.XSD_INT)]
    out += [part(loc, O.RDF_TYPE, f"'{b}Location'", "cases"), part(loc, O.RDF_LABEL, "loc", "cases", "literal")]
    for kind, col in (("Trafficker", "perps"), ("Chief", "chiefs")):
        rows, who = f"(SELECT victim, unnest({col}) AS x FROM cases)", f"'{b}{kind.lower()}/' || {_slug('x')}"
        out += [part(who, O.RDF_TYPE, f"'{b}{kind}'", rows), part(who, O.RDF_LABEL, "x", rows, "literal"), part(v, f"{b}has{kind}", who, rows)]
    return with_cases("SELECT DISTINCT * FROM (" + " UNION ALL ".join(out) + ")")


@query("rdf_triples", _triples_sql())
def _(spark, d):
    rows = cases(spark, d).withColumn("uid", F.col("case_id").cast("string"))
    # the mode of numbers, not of their texts
    return O.triples(rows, _BASE, "victim", "case_id", "loc", "case_id", "perps", "chiefs", "gender", "nat")


def _turtle_sql() -> str:
    b = _BASE + "#"
    loc = f"'{b}location/' || {_slug('loc')}"
    at = " UNION ALL ".join(f"SELECT {loc} AS s, '{O.GEO}{p}' AS p, CAST({c} AS VARCHAR) AS o, 'literal' AS o_kind, '{O.XSD_DOUBLE}' AS o_type FROM cases JOIN (SELECT * FROM ({GAZETTEER_SQL}) UNION ALL SELECT '1-URGENT', lat, lon, country, population, alt_list FROM ({GAZETTEER_SQL}) WHERE name = 'NATION_1') g ON g.name = loc" for p, c in (("lat", "lat"), ("long", "lon")))
    rows = _triples_sql().replace("SELECT DISTINCT * FROM (", f"SELECT DISTINCT * FROM ({at} UNION ALL ", 1)
    escaped = "replace(replace(replace(o, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
    literal = f"chr(34) || {escaped} || chr(34) || CASE WHEN o_type <> '' THEN '^^<' || o_type || '>' ELSE '' END"
    head, _, tail = rows.partition("SELECT DISTINCT * FROM (")
    return f"{head}SELECT '<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'uri' THEN '<' || o || '>' ELSE {literal} END || ' .' AS line FROM (SELECT DISTINCT * FROM ({tail})"


@query("turtle_lines", _turtle_sql())
def _(spark, d):
    # places are priorities here, so the gazetteer takes their names
    places = gazetteer(spark, d).unionAll(gazetteer(spark, d).where("name = 'NATION_1'").withColumn("name", F.lit("1-URGENT")))
    return O.n_triples(O.triples(cases(spark, d), _BASE, "victim", "case_id", "loc", "case_id", "perps", "chiefs", "gender", "nat", places))


_GCN = """, a AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT id, id FROM n), d AS (SELECT src AS id, count(*) AS d FROM a GROUP BY 1),
w AS (SELECT a.src, a.dst, 1 / sqrt(x.d * y.d) AS w FROM a JOIN d x ON x.id = a.src JOIN d y ON y.id = a.dst),
x0 AS (SELECT DISTINCT id, CASE id[1] WHEN 'V' THEN 'Victim' WHEN 'L' THEN 'Location' WHEN 'P' THEN 'Trafficker' ELSE 'Chief' END AS feature, 1e0 AS x FROM n),
x1 AS (SELECT src AS id, feature, sum(w * x) AS x FROM w JOIN x0 ON x0.id = w.dst GROUP BY 1, 2)
SELECT src AS id, feature, round(sum(w * x), 6) AS x FROM w JOIN x1 ON x1.id = w.dst GROUP BY 1, 2"""


@query("gcn_features", with_edges("").rstrip() + _GCN)
def _(spark, d):
    edges = written(edges_of(spark, d), "edges")
    features = G.nodes_of(edges).select("id", F.col("ntype").alias("feature"), F.lit(1.0).alias("x"))
    return G.smoothed_features(edges, features).withColumn("x", F.round("x", 6))


#: Half of the nodes by a digest have a known type; in SQL, with w, n and e of the tables before.
_KNOWN = "CAST('0x' || substr(md5('7:' || id), 1, 8) AS BIGINT) % 2 = 0"
_FEATURES = _GCN[: _GCN.index("\nx0 AS")] + f"""
b AS (SELECT src, dst FROM a WHERE src <> dst), k AS (SELECT src AS id, count(*) AS d FROM b GROUP BY 1), t AS (SELECT DISTINCT id, CASE id[1] WHEN 'V' THEN 'Victim' WHEN 'L' THEN 'Location' WHEN 'P' THEN 'Trafficker' ELSE 'Chief' END AS ntype FROM n WHERE {_KNOWN}),
s AS (SELECT b.src AS id, 'type:' || ntype AS feature, count(*) / max(k.d) AS x FROM b JOIN t ON t.id = b.dst JOIN k ON k.id = b.src GROUP BY 1, 2),
x0 AS (SELECT id, 'degree:' || CAST(CAST(floor(log2(d)) AS INTEGER) AS VARCHAR) AS feature, 1e0 AS x FROM k), x1 AS (SELECT src AS id, feature, sum(w * x) AS x FROM w JOIN x0 ON x0.id = w.dst GROUP BY 1, 2),
x2 AS (SELECT src AS id, feature, sum(w * x) AS x FROM w JOIN x1 ON x1.id = w.dst GROUP BY 1, 2)
SELECT id, feature, round(x, 6) AS x FROM s UNION ALL SELECT id, feature, round(x, 6) FROM x2"""


def known(c="id"):
    return F.conv(F.substring(F.md5(F.concat(F.lit("7:"), c).cast("binary")), 1, 8), 16, 10).cast("long") % 2 == 0


@query("node_features", with_edges("").rstrip() + _FEATURES)
def _(spark, d):
    edges = written(edges_of(spark, d), "edges")
    return G.node_features(edges, G.nodes_of(edges), known()).withColumn("x", F.round("x", 6))


def classified(spark, d):
    # weights and types of edges are not needed, and no rows are sorted for them
    return G.classify_nodes(edges_of(spark, d).select("src", "dst"), None, known())[1]


@query("node_types")
def _(spark, d):
    """The type that the linear graph network gives to each node whose type it was not told."""
    rows = classified(spark, d)
    return rows.select("id", "ntype", F.col("best")[0]["label"].alias("predicted"), F.round(F.col("best")[0]["prob"], 4).alias("prob"))


@query("node_type_accuracy")
def _(spark, d):
    return linear.accuracy(classified(spark, d), "ntype", (1, 2)).withColumns({c: F.round(c, 4) for c in ("acc_1", "acc_2")})

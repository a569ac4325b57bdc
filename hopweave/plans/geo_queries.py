"""Queries of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.operators import geo as Z
from hopweave.plans.register import query
from hopweave.plans.views import GAZETTEER_SQL, cases, gazetteer, hops, table, with_cases, with_hops

#: The gazetteer lacks every seventh nation.
_PART = "CAST(substring(name, 8) AS INT) % 7 <> 0"


_GAZ = f"(SELECT * FROM ({GAZETTEER_SQL}) WHERE CAST(substr(name, 8) AS INTEGER) % 7 <> 0)"


def some(spark, d):
    return gazetteer(spark, d).where(_PART)


@query("geocode_left", with_hops(f"SELECT victim, CAST(ord AS INTEGER) AS ord, loc, lat, lon FROM hops LEFT JOIN {_GAZ} g ON lower(trim(loc)) = lower(trim(g.name))"))
def _(spark, d):
    return Z.attach(hops(spark, d), "loc", some(spark, d)).select("victim", "ord", "loc", "lat", "lon")


@query("match_report", with_hops(f"SELECT count(*) AS total, count(lat) AS matched, count(*) - count(lat) AS unmatched, round(count(lat) / count(*), 6) AS rate FROM hops LEFT JOIN {_GAZ} g ON loc = g.name"))
def _(spark, d):
    return Z.match_report(Z.attach(hops(spark, d), "loc", some(spark, d))).withColumn("rate", F.round("rate", 6))


@query("coalesce_uploaded", with_hops(f"SELECT loc, coalesce(lat, 1e0) AS lat, coalesce(lon, 2e0) AS lon FROM (SELECT DISTINCT loc FROM hops) h LEFT JOIN {_GAZ} g ON loc = g.name"))
def _(spark, d):
    places = Z.attach(hops(spark, d).select("loc").distinct(), "loc", some(spark, d))
    up = table(spark, d, "nation").select(F.col("n_name").alias("location"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    again = up.unionAll(up).unionAll(up.select("location", F.lit(5.0), F.lit(6.0))).unionAll(up.select("location", F.lit(None).cast("double"), F.lit(0.0)))
    return Z.with_uploaded(places, "loc", again).select("loc", "lat", "lon")


@query("resolve_exact_alias", f"WITH p AS (SELECT n_name AS loc FROM nation UNION ALL SELECT 'n-' || n_nationkey FROM nation) SELECT loc, lat, lon, CASE WHEN lower(loc) = lower(name) THEN 'exact' ELSE 'alias' END AS how FROM p JOIN {_GAZ} g ON lower(loc) = lower(name) OR lower(loc) = lower(alt_list[1])")
def _(spark, d):
    n = table(spark, d, "nation")
    places = n.selectExpr("n_name AS loc").unionAll(n.selectExpr("concat('n-', n_nationkey) AS loc"))
    return Z.resolve_exact_alias(places, "loc", some(spark, d))


@query("resolve_tables", "SELECT n_name AS loc, CASE WHEN n_nationkey < 10 THEN 5e0 ELSE 6e0 END AS lat, CAST(n_nationkey AS DOUBLE) AS lon FROM nation WHERE n_nationkey < 20")
def _(spark, d):
    n = table(spark, d, "nation")
    tab = lambda limit, lat: n.where(F.col("n_nationkey") < limit).select(F.col("n_name").alias("name"), F.lit(lat).alias("lat"), F.col("n_nationkey").cast("double").alias("lon"))
    return Z.resolve_tables(n.selectExpr("n_name AS loc"), "loc", [tab(10, 5.0), tab(20, 6.0)])


@query("resolve_fuzzy")
def _(spark, d):
    n = table(spark, d, "nation")
    return Z.resolve_fuzzy(n.selectExpr("concat(n_name, 'X') AS loc").unionAll(n.selectExpr("n_name AS loc")), "loc", some(spark, d))


@query("resolve_in_country")
def _(spark, d):
    n = table(spark, d, "nation")
    return Z.resolve_in_country(n.selectExpr("concat(n_name, '1, R', n_regionkey) AS loc"), "loc", gazetteer(spark, d))


@query("largest_city", f"SELECT country, arg_max(name, population) AS name, arg_max(lat, population) AS lat, arg_max(lon, population) AS lon FROM ({GAZETTEER_SQL}) GROUP BY 1")
def _(spark, d):
    return Z.largest_city(gazetteer(spark, d))


@query("place_counts", with_cases(f"SELECT c.name, n, lat, lon FROM (SELECT name, count(*) AS n FROM (SELECT unnest([nat, loc]) AS name FROM cases) GROUP BY 1) c LEFT JOIN {_GAZ} g ON c.name = g.name"))
def _(spark, d):
    return Z.place_counts(cases(spark, d), F.array("nat", "loc"), some(spark, d)).select("name", "n", "lat", "lon")


@query("place_edges", with_hops("SELECT place, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing FROM (SELECT b AS place, 1 AS i, 0 AS o FROM m UNION ALL SELECT a, 0, 1 FROM m) GROUP BY 1").replace(") SELECT place", "), m AS (SELECT loc AS b, lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS a FROM hops QUALIFY a IS NOT NULL) SELECT place", 1))
def _(spark, d):
    return Z.place_edges(hops(spark, d), "victim", "loc", "ord")


@query(
    "timed_segments",
    with_hops(f"""SELECT victim, step, a, b, strftime(TIMESTAMP '2020-01-01' + to_microseconds(CAST((till - days) * 86400000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS t0,
    strftime(TIMESTAMP '2020-01-01' + to_microseconds(CAST(till * 86400000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS t1 FROM (
      SELECT *, sum(CASE WHEN lat_a IS NOT NULL AND lat_b IS NOT NULL AND b IS NOT NULL THEN days ELSE 0 END) OVER (PARTITION BY victim ORDER BY step) AS till FROM (
        SELECT victim, CAST(ord AS INTEGER) AS step, loc AS a, lead(loc) OVER w AS b, CAST(coalesce(gap_days, 1) AS DOUBLE) AS days, lat AS lat_a, lead(lat) OVER w AS lat_b
        FROM hops LEFT JOIN {_GAZ} g ON loc = g.name WINDOW w AS (PARTITION BY victim ORDER BY ord)))
    WHERE lat_a IS NOT NULL AND lat_b IS NOT NULL AND b IS NOT NULL"""),
)
def _(spark, d):
    rows = Z.timed_segments(hops(spark, d), "victim", "loc", "ord", F.col("gap_days"), some(spark, d), F.lit("2020-01-01").cast("timestamp"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("victim", "step", "a", "b", shown("t0"), shown("t1"))


#: Coordinates of brands; every fifth has none. Days of a case: one for each hop, one for each place, too few, or none.
_BRANDS = "SELECT DISTINCT p_brand AS name, CAST(substr(p_brand, 7) AS DOUBLE) AS lat, CAST(substr(p_brand, 7) AS DOUBLE) * 2 AS lon FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 5 <> 0"
_AT = lambda x: f"strftime(TIMESTAMP '2020-01-01' + to_microseconds(CAST(({x}) * 86400000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


@query(
    "timed_segments_list",
    with_cases("").rstrip()
    + f""", gaz AS ({_BRANDS}), h AS (SELECT case_id, len(chiefs) AS n, CASE case_id % 4 WHEN 0 THEN len(chiefs) - 1 WHEN 1 THEN len(chiefs) WHEN 2 THEN 1 END AS given, chiefs, unnest(range(1, len(chiefs))) AS i FROM cases),
s AS (SELECT case_id, CAST(i AS INTEGER) AS step, chiefs[i] AS a, chiefs[i + 1] AS b, CASE WHEN given IN (n - 1, n) THEN i * 1.5e0 ELSE 1e0 END AS d FROM h),
f AS (SELECT case_id, step, a, b, x.lat AS lat_a, x.lon AS lon_a, y.lat AS lat_b, y.lon AS lon_b, d, sum(d) OVER (PARTITION BY case_id ORDER BY step) AS till FROM s JOIN gaz x ON x.name = a JOIN gaz y ON y.name = b)
SELECT case_id, step, a, b, lat_a, lon_a, lat_b, lon_b, {_AT('till - d')} AS t0, {_AT('till')} AS t1 FROM f""",
)
def _(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.expr("cast(substring(p_brand, 7) as double)").alias("lat")).distinct().where("lat % 5 <> 0")
    brands = brands.select("name", "lat", (F.col("lat") * 2).alias("lon"), F.lit(0).alias("population"))
    given = F.expr("CASE case_id % 4 WHEN 0 THEN size(chiefs) - 1 WHEN 1 THEN size(chiefs) WHEN 2 THEN 1 END")
    days = F.when(given > 0, F.transform(F.sequence(F.lit(1), F.greatest(given, F.lit(1))), lambda i: i * 1.5))
    rows = Z.list_segments(cases(spark, d).withColumn("days", days), "case_id", "chiefs", "days", brands, F.lit("2020-01-01").cast("timestamp"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("case_id", "step", "a", "b", "lat_a", "lon_a", "lat_b", "lon_b", shown("t0"), shown("t1"))


@query("resolve_locations")
def _(spark, d):
    n = table(spark, d, "nation")
    asked = ["n_name", "concat(n_name, ' r', n_regionkey)", "concat('Nation ', n_nationkey)", "concat('somewhere r', n_regionkey)", "concat('X', n_name)", "''"]
    places = n.select(F.explode(F.array(*(F.expr(x) for x in asked))).alias("loc"))
    lookup = n.where("n_nationkey < 5").select(F.col("n_name").alias("location"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return Z.resolve_locations(places, "loc", gazetteer(spark, d), [lookup])


@query("gazetteer_from_tokens")
def _(spark, d):
    n = table(spark, d, "nation")
    lines = n.selectExpr("concat('[', chr(39), n_name, 'X', chr(39), ' ', chr(39), 'R', n_regionkey, chr(39), ']') AS value").unionAll(n.selectExpr("concat('[', n_name, ' nowhere]') AS value"))
    return Z.gazetteer_from_tokens(lines, gazetteer(spark, d))


@query("heat_points", f"SELECT lat, lon FROM {_GAZ}")
def _(spark, d):
    return Z.heat_points(some(spark, d), "lat", "lon")

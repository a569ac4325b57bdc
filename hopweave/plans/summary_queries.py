"""Queries of filters and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hopweave.functions import text as T
from hopweave.operators import filters as P
from hopweave.operators import summary as S
from hopweave.plans.register import query
from hopweave.plans.views import cases, event_hops, hops, table, with_cases, with_event_hops, with_hops


@query("filter_gender", with_cases("SELECT case_id, gender, nat FROM cases WHERE gender = 'BUILDING' AND nat = 'NATION_3'"))
def _(spark, d):
    return P.equals(cases(spark, d), gender="BUILDING", nat="NATION_3", loc="Any").select("case_id", "gender", "nat")


@query(
    "filter_composite",
    with_cases("""SELECT case_id, CAST(year AS INTEGER) AS year FROM cases WHERE nat <> '' AND gender = 'MACHINERY' AND year BETWEEN 1995 AND 1997
    AND list_has_any(list_transform(chiefs, lambda x: lower(x)), ['brand#1', 'brand#7', 'brand#12']) AND (contains(lower(loc), 'urgent') OR contains(lower(nat), 'urgent'))"""),
)
def _(spark, d):
    rows = P.composite(cases(spark, d), equal={"gender": "MACHINERY"}, any_token={"chiefs": ["BRAND#1", "brand#7", "Brand#12"]}, numbers={"year": (1995, 1997)}, substring=(["loc", "nat"], "URGENT"))
    return rows.select("case_id", "year")


@query("list_contains_any", with_cases("SELECT case_id FROM cases WHERE list_has_any(list_transform(chiefs, lambda x: lower(x)), ['brand#11', 'brand#23', 'brand_1'])"))
def _(spark, d):
    return cases(spark, d).where(P.tokens_in_text(F.col("chiefs"), "Brand#11, brand#23,BRAND_1")).select("case_id")


@query("list_contains_exact", with_cases("SELECT case_id FROM cases WHERE list_contains(perps, (SELECT min(s_name) FROM supplier))"))
def _(spark, d):
    name = table(spark, d, "supplier").agg(F.min("s_name").alias("name"))  # one row
    return cases(spark, d).crossJoin(F.broadcast(name)).where(P.contains_exact(F.col("perps"), F.col("name"))).select("case_id")


@query("filter_range_coerce", "SELECT event_id, user_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 20 AND 40")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(P.in_range(k, 20, 40)).select("event_id", "user_id")


@query("filter_substr_or", "SELECT p_partkey FROM part WHERE regexp_matches(lower(p_name), 'a.*e') OR regexp_matches(lower(p_type), 'a.*e')")
def _(spark, d):
    return table(spark, d, "part").where(P.substring_in([F.col("p_name"), F.col("p_type")], "a.*e", literal=False)).select("p_partkey")


@query("filter_year_missing_fails", with_cases("SELECT case_id FROM cases WHERE case_id % 5 <> 0 AND year BETWEEN 1996 AND 1997"))
def _(spark, d):
    rows = cases(spark, d).withColumn("year", F.when(F.col("case_id") % 5 != 0, F.col("year")))  # every fifth year is missing
    return rows.where(P.year_between(F.col("year"), 1996, 1997)).select("case_id")


@query("legacy_filter", with_cases("SELECT case_id FROM cases WHERE nat = 'NATION_3' AND gender = 'MACHINERY' AND year BETWEEN 1996 AND 1999 AND contains(lower(loc), 'high')"))
def _(spark, d):
    names = {"nationality": "nat", "place": "loc"}
    return P.legacy_filter(cases(spark, d), "NATION_3", "MACHINERY", (1996, 1999), "High", columns=names).select("case_id")


_TABLES = """SELECT 'gender' AS tab, gender AS name, count(*) AS n FROM cases GROUP BY 2
UNION ALL (SELECT 'nationality', nat, count(*) AS n FROM cases GROUP BY 2 ORDER BY n DESC, nat LIMIT 15)
UNION ALL SELECT 'per_place', loc, count(DISTINCT victim) FROM cases GROUP BY 2
UNION ALL SELECT 'per_perp', x, count(DISTINCT victim) FROM (SELECT victim, unnest(perps) AS x FROM cases) GROUP BY 2
UNION ALL SELECT 'per_chief', x, count(DISTINCT victim) FROM (SELECT victim, unnest(chiefs) AS x FROM cases) GROUP BY 2"""


@query("summary_tables", with_cases(_TABLES))
def _(spark, d):
    tables = S.summary_tables(cases(spark, d), "victim", "case_id", "loc", "gender", "nat", "perps", "chiefs")
    parts = [t.select(F.lit(n).alias("tab"), F.col(t.columns[0]).alias("name"), F.col(t.columns[1]).alias("n")) for n, t in tables.items() if n != "core"]
    return reduce(lambda a, b: a.unionAll(b), parts)


@query("plausible_days", "SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN o_totalprice END AS plausible FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.plausible(F.col("o_totalprice")).alias("plausible"))


@query("first_n_victims", with_event_hops("SELECT event_id FROM event_hops WHERE victim IN (SELECT victim FROM event_hops GROUP BY 1 ORDER BY min(event_id), victim LIMIT 25)"))
def _(spark, d):
    return P.first_subjects(event_hops(spark, d), "victim", "event_id", 25).select("event_id")


@query("paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def _(spark, d):
    return P.page(table(spark, d, "orders"), 3, 50, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query(
    "filter_options",
    with_cases("SELECT DISTINCT kind, value FROM (SELECT 'genders' AS kind, gender AS value FROM cases UNION ALL SELECT 'nationalities', nat FROM cases UNION ALL SELECT 'locations', unnest([loc, nat]) FROM cases UNION ALL SELECT 'victims', victim FROM cases) WHERE value <> ''"),
)
def _(spark, d):
    rows = cases(spark, d).withColumn("places", F.array("loc", "nat"))
    return P.filter_options(rows, {"genders": "gender", "nationalities": "nat", "victims": "victim", "chiefs": "no such column"}, {"locations": "places"})


@query(
    "enumerate_values",
    with_cases("SELECT DISTINCT kind, value FROM (SELECT 'gender' AS kind, gender AS value FROM cases UNION ALL SELECT 'nat', nat FROM cases UNION ALL SELECT 'perps', unnest(perps) FROM cases UNION ALL SELECT 'chiefs', unnest(chiefs) FROM cases) WHERE value <> ''"),
)
def _(spark, d):
    return P.distinct_values(cases(spark, d), ["gender", "nat"], ["perps", "chiefs"])


@query("preview_head", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def _(spark, d):
    return P.top(table(spark, d, "orders"), 20, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("drop_null_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").dropna(subset=["doc_id", "lang", "source"]).select("doc_id", "lang")


@query("pick_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(spark, d):
    return P.pick_columns(table(spark, d, "customer"), ["c_name", "c_custkey"], ["c_acctbal", "c_custkey", "c_name"])


@query("coerce_for_save", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def _(spark, d):
    return P.coerce_for_save(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"))


@query("metric_unpivot", "SELECT r_regionkey, metric, value FROM (SELECT r_regionkey, n, total FROM (SELECT n_regionkey AS r_regionkey, CAST(count(*) AS DOUBLE) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation GROUP BY 1)) UNPIVOT (value FOR metric IN (n, total))")
def _(spark, d):
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").cast("double").alias("n"), F.sum("n_nationkey").cast("double").alias("total"))
    return P.unpivot(rows, ["r_regionkey"], ["n", "total"])


@query("route_lengths", with_hops("SELECT victim, count(loc) AS n FROM hops GROUP BY 1"))
def _(spark, d):
    return S.route_lengths(hops(spark, d), "victim", "loc")


@query("victims_per_location", with_hops("SELECT loc, count(DISTINCT victim) AS n FROM hops GROUP BY 1"))
def _(spark, d):
    return S.subjects_per(hops(spark, d), "victim", "loc")


for _name, _column in (("victims_per_perp", "perps"), ("victims_per_chief", "chiefs")):

    @query(_name, with_cases(f"SELECT {_column}, count(DISTINCT victim) AS n FROM (SELECT victim, unnest({_column}) AS {_column} FROM cases) GROUP BY 1"))
    def _(spark, d, column=_column):
        return S.subjects_per(cases(spark, d), "victim", column, exploded=True)


@query("gender_by_row", with_cases("SELECT coalesce(gender, 'Unknown') AS gender, count(*) AS n FROM cases GROUP BY 1"))
def _(spark, d):
    return S.count_by(cases(spark, d), "gender")


@query("nationality_topn", with_cases("SELECT nat, count(*) AS n FROM cases GROUP BY 1 ORDER BY n DESC, nat LIMIT 15"))
def _(spark, d):
    return S.top_counts(S.count_by(cases(spark, d), "nat"), "nat", 15)


@query(
    "core_counts",
    with_cases("""SELECT count(*) AS rows, count(DISTINCT victim) AS subjects, count(DISTINCT case_id) AS uids, count(DISTINCT loc) AS places,
    (SELECT count(DISTINCT x) FROM (SELECT unnest(perps) AS x FROM cases)) AS perps, (SELECT count(DISTINCT x) FROM (SELECT unnest(chiefs) AS x FROM cases)) AS chiefs,
    CAST(floor((SELECT median(n) FROM (SELECT count(loc) AS n FROM cases GROUP BY victim))) AS INTEGER) AS median_route, round(count(DISTINCT case_id) / count(DISTINCT victim), 3) AS uid_ratio FROM cases"""),
)
def _(spark, d):
    return S.core_counts(cases(spark, d), "victim", "case_id", "loc", {"perps": "perps", "chiefs": "chiefs"})


@query("token_frequency", with_cases("SELECT x AS token, count(*) AS n FROM (SELECT unnest(perps) AS x FROM cases) GROUP BY 1"))
def _(spark, d):
    return cases(spark, d).select(F.explode("perps").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


for _name, _column in (("gender_by_victim", "gender"), ("nationality_by_victim", "nat"), ("priority_by_victim", "loc")):

    @query(_name, with_cases(f"SELECT {_column}, count(*) AS n FROM (SELECT victim, coalesce(arg_min({_column}, case_id), 'Unknown') AS {_column} FROM cases GROUP BY 1) GROUP BY 1"))
    def _(spark, d, column=_column):
        return S.by_subject(cases(spark, d), "victim", column, "case_id")


@query("stops_per_victim", with_hops("SELECT victim, max(ord) AS stops FROM hops GROUP BY 1"))
def _(spark, d):
    return S.stops(hops(spark, d), "victim", "ord").withColumn("stops", F.col("stops").cast("long"))


@query(
    "stops_hist",
    with_hops("SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((stops - lo) / ((hi - lo) / 25.0)), 24) END AS INTEGER) AS bin, count(*) AS n FROM (SELECT victim, max(ord) AS stops FROM hops GROUP BY 1), (SELECT CAST(min(s) AS DOUBLE) AS lo, CAST(max(s) AS DOUBLE) AS hi FROM (SELECT max(ord) AS s FROM hops GROUP BY victim)) GROUP BY 1"),
)
def _(spark, d):
    return S.histogram(S.stops(hops(spark, d), "victim", "ord"), "stops", 25)


@query("value_hist", "SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def _(spark, d):
    return S.histogram(table(spark, d, "orders"), "o_totalprice", 10)


@query("trend_year_group", with_cases("SELECT CAST(year AS INTEGER) AS year, gender, count(DISTINCT victim) AS n FROM cases GROUP BY 1, 2"))
def _(spark, d):
    return S.distinct_by(cases(spark, d), "victim", "year", "gender")


_TREND = "SELECT CAST(year AS INTEGER) AS year, gender, count(DISTINCT victim) AS n FROM cases GROUP BY 1, 2"


@query("trend_smoothed", with_cases(f"SELECT year, gender, n, round(avg(n) OVER (PARTITION BY gender ORDER BY year ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS smoothed FROM ({_TREND})"))
def _(spark, d):
    rows = S.distinct_by(cases(spark, d), "victim", "year", "gender")
    return S.rolling_mean(rows, "n", 4, "year", "gender").withColumn("smoothed", F.round("smoothed", 6))


@query("trend_cumulative", with_cases(f"SELECT year, gender, n, CAST(sum(n) OVER (PARTITION BY gender ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM ({_TREND})"))
def _(spark, d):
    return S.running_sum(S.distinct_by(cases(spark, d), "victim", "year", "gender"), "n", "year", "gender")


@query("first_seen_year", with_cases("SELECT CAST(year(m) AS INTEGER) AS year, count(*) AS n FROM (SELECT min(opened) AS m FROM cases GROUP BY victim) GROUP BY 1"))
def _(spark, d):
    return S.first_seen(cases(spark, d), "victim", "opened")


@query(
    "month_location_heat",
    with_hops("SELECT strftime(on_date, '%Y-%m') AS month, loc, count(DISTINCT victim) AS n FROM hops WHERE loc IN (SELECT loc FROM hops GROUP BY 1 ORDER BY count(DISTINCT victim) DESC, loc LIMIT 10) GROUP BY 1, 2"),
)
def _(spark, d):
    return S.month_heat(hops(spark, d), "victim", "loc", "on_date")


@query("flows_topn", with_hops("SELECT a, b, count(*) AS n FROM (SELECT loc AS a, lead(loc) OVER (PARTITION BY victim ORDER BY ord) AS b FROM hops) WHERE b IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 40"))
def _(spark, d):
    return P.top(S.flows(hops(spark, d), "victim", "loc", "ord"), 40, F.desc("n"), "a", "b")


@query(
    "term_topk",
    "SELECT conv_id, term, n, rank FROM (SELECT conv_id, term, count(*) AS n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, term) AS INTEGER) AS rank FROM (SELECT conv_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS term FROM conversations) GROUP BY 1, 2) WHERE rank <= 8",
)
def _(spark, d):
    return S.terms(table(spark, d, "conversations"), "conv_id", T.topic_tokens(F.col("text")), 8)


@query("bounds", "SELECT min(lat) AS min_lat, max(lat) AS max_lat, avg(lat) AS mean_lat, min(lon) AS min_lon, max(lon) AS max_lon, avg(lon) AS mean_lon FROM (SELECT n_nationkey * 7.0 - 84 AS lat, n_nationkey * 14.0 - 168 AS lon FROM nation)".replace("7.0", "7e0").replace("14.0", "14e0"))
def _(spark, d):
    from hopweave.plans.views import gazetteer

    return S.bounds(gazetteer(spark, d), "lat", "lon")


@query(
    "radii",
    with_hops("SELECT loc, n, round(CASE WHEN hi = lo THEN 8e0 ELSE 8 + 20e0 * (n - lo) / (hi - lo) END, 6) AS radius FROM (SELECT loc, count(DISTINCT victim) AS n FROM hops GROUP BY 1), (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(DISTINCT victim) AS n FROM hops GROUP BY loc))"),
)
def _(spark, d):
    return S.radii(S.subjects_per(hops(spark, d), "victim", "loc"), "n").withColumn("radius", F.round("radius", 6))


@query("coverage", "SELECT count(*) AS rows, count(DISTINCT source) AS subjects, count(lang) AS n_lang, count(text) AS n_text FROM documents")
def _(spark, d):
    return S.coverage(table(spark, d, "documents"), "source", ["lang", "text"])


@query("fold_mean_std", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std FROM lineitem GROUP BY 1")
def _(spark, d):
    return S.mean_std(table(spark, d, "lineitem"), "l_quantity", "l_returnflag").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("dedup_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def _(spark, d):
    return P.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", "l_partkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")

"""Queries over trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.operators import trajectory as J
from hopweave.plans.register import query
from hopweave.plans.views import cases, event_hops, hops, table, with_cases, with_event_hops, with_hops

R6 = lambda *names: {n: F.round(n, 6) for n in names}

_COLLAPSED = "c AS (SELECT * FROM (SELECT *, lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS before FROM hops) WHERE before IS NULL OR before <> loc)"


def with_collapsed(sql: str) -> str:
    return with_hops("").rstrip() + ", " + _COLLAPSED + " " + sql


@query("origin_destination", with_hops("SELECT victim, arg_min(loc, ord) AS origin, arg_max(loc, ord) AS destination FROM hops GROUP BY victim"))
def _(spark, d):
    return J.origin_destination(hops(spark, d), "victim", "loc", "ord")


@query("route_renumber", with_event_hops("SELECT event_id, CAST(row_number() OVER (PARTITION BY victim ORDER BY coalesce(k, event_id), event_id) AS INTEGER) AS ord FROM event_hops"))
def _(spark, d):
    rows = event_hops(spark, d).withColumn("k", F.col("k").cast("long"))
    return J.renumber(rows, "victim", "k", "event_id").select("event_id", "ord")


@query(
    "renumber_if_gaps",
    with_event_hops("SELECT event_id, CASE WHEN (SELECT bool_or(k IS NULL) FROM event_hops) THEN CAST(row_number() OVER (PARTITION BY victim ORDER BY event_id) AS INTEGER) ELSE k END AS ord FROM event_hops"),
)
def _(spark, d):
    return J.renumber_if_gaps(event_hops(spark, d), "victim", "k", "event_id").select("event_id", "ord")


@query("first_appearance_ids", with_event_hops("SELECT victim, 'HTV' || row_number() OVER (ORDER BY m, victim) AS serial FROM (SELECT victim, min(event_id) AS m FROM event_hops GROUP BY 1)"))
def _(spark, d):
    return J.appearance_ids(event_hops(spark, d), "victim", "event_id")


@query("collapse_repeats", with_collapsed("SELECT victim, loc, CAST(ord AS INTEGER) AS ord FROM c"))
def _(spark, d):
    return J.collapse(hops(spark, d), "victim", "loc", "ord").select("victim", "loc", "ord")


@query("next_location", with_hops("SELECT victim, CAST(ord AS INTEGER) AS ord, loc, lag(loc) OVER w AS previous, lead(loc) OVER w AS next FROM hops WINDOW w AS (PARTITION BY victim ORDER BY ord)"))
def _(spark, d):
    return J.next_place(hops(spark, d), "victim", "loc", "ord").select("victim", "ord", "loc", "previous", "next")


@query("dwell_days", with_event_hops("SELECT event_id, round(dwell, 6) AS dwell_days FROM (SELECT event_id, (epoch_us(lead(happened) OVER (PARTITION BY victim ORDER BY happened, event_id)) - epoch_us(happened)) / 86400e6 AS dwell FROM event_hops) WHERE dwell >= 0"))
def _(spark, d):
    return J.dwell(event_hops(spark, d), "victim", "happened", "happened", "event_id").select("event_id", F.round("dwell_days", 6).alias("dwell_days"))


@query("gap_hours", with_event_hops("SELECT event_id, round(gap, 6) AS gap_hours FROM (SELECT event_id, (epoch_us(happened) - epoch_us(lag(happened) OVER (PARTITION BY victim ORDER BY happened, event_id))) / 3600e6 AS gap FROM event_hops) WHERE gap IS NOT NULL"))
def _(spark, d):
    return J.gaps(event_hops(spark, d), "victim", "happened", "happened", "event_id").select("event_id", F.round("gap_hours", 6).alias("gap_hours"))


@query("last_location", with_hops("SELECT victim, arg_max(loc, ord) AS last_place FROM hops GROUP BY 1"))
def _(spark, d):
    return J.last_place(hops(spark, d), "victim", "loc", "ord")


_GAPPY = "SELECT event_id, victim, CASE WHEN event_id % 3 = 0 THEN loc END AS nat FROM event_hops"


@query(
    "fill_static",
    with_event_hops(f"SELECT event_id, coalesce(last_value(nat IGNORE NULLS) OVER (PARTITION BY victim ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(nat IGNORE NULLS) OVER (PARTITION BY victim ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS nat FROM ({_GAPPY})"),
)
def _(spark, d):
    rows = event_hops(spark, d).select("event_id", "victim", F.when(F.col("event_id") % 3 == 0, F.col("loc")).alias("nat"))
    return J.fill_static(rows, "victim", "event_id", ["nat"]).select("event_id", "nat")


@query("transition_weights", with_collapsed("SELECT loc AS a, nxt AS b, count(DISTINCT victim) AS weight FROM (SELECT victim, loc, lead(loc) OVER (PARTITION BY victim ORDER BY ord) AS nxt FROM c) WHERE nxt IS NOT NULL GROUP BY 1, 2"))
def _(spark, d):
    return J.transitions(hops(spark, d), "victim", "loc", "ord")


@query(
    "location_profile",
    with_collapsed("""SELECT p.loc, visits, subjects, n_in, n_out, top_actors FROM
    (SELECT loc, count(*) AS visits, count(DISTINCT victim) AS subjects, count(prev) AS n_in, count(nxt) AS n_out FROM
      (SELECT victim, loc, lag(loc) OVER w AS prev, lead(loc) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY victim ORDER BY ord)) GROUP BY 1) p
    JOIN (SELECT loc, string_agg(actor, ', ' ORDER BY r) AS top_actors FROM
      (SELECT loc, actor, row_number() OVER (PARTITION BY loc ORDER BY count(*) DESC, actor) AS r FROM hops GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) t ON p.loc = t.loc"""),
)
def _(spark, d):
    return J.place_profile(hops(spark, d), "victim", "loc", "ord", "actor")


@query("perp_profile", with_hops("SELECT actor, CAST(sum(n) AS BIGINT) AS rows, count(*) AS places, CAST(sum(s) AS BIGINT) AS subjects FROM (SELECT actor, loc, count(*) AS n, count(DISTINCT victim) AS s FROM hops GROUP BY 1, 2) GROUP BY 1"))
def _(spark, d):
    return J.actor_profile(hops(spark, d), "victim", "loc", "actor")


_MEDIANS = """SELECT 'pair' AS grain, a, b, {m} AS med FROM g WHERE a IS NOT NULL GROUP BY a, b UNION ALL SELECT 'place', NULL, b, {m} FROM g GROUP BY b UNION ALL SELECT 'all', NULL, NULL, {m} FROM g"""


@query("duration_medians", with_hops("").rstrip() + ", g AS (SELECT lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS a, loc AS b, gap_days AS d, ord FROM hops), g2 AS (SELECT * FROM g WHERE d IS NOT NULL) " + _MEDIANS.format(m="CAST(floor(median(d)) AS INTEGER)").replace("FROM g ", "FROM g2 ").replace("FROM g", "FROM g2").replace("g22", "g2"))
def _(spark, d):
    return J.duration_medians(hops(spark, d), "victim", "loc", "ord", F.col("gap_days"))


@query(
    "duration_medians_float",
    with_collapsed("").rstrip() + ", g AS (SELECT lag(loc) OVER (PARTITION BY victim ORDER BY ord) AS a, loc AS b, CASE WHEN gap_days > 0 THEN CAST(gap_days AS DOUBLE) END AS d FROM c), g2 AS (SELECT * FROM g WHERE d IS NOT NULL) " + _MEDIANS.format(m="round(median(d), 6)").replace("FROM g", "FROM g2"),
)
def _(spark, d):
    days = F.when(F.col("gap_days") > 0, F.col("gap_days").cast("double"))
    return J.duration_medians(J.collapse(hops(spark, d), "victim", "loc", "ord"), "victim", "loc", "ord", days, whole=False).withColumns(R6("med"))


@query("hop_percentiles", with_hops("SELECT median(n) AS median, round(quantile_cont(n, 0.9), 6) AS p90, count(*) AS n FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM hops GROUP BY victim)"))
def _(spark, d):
    return J.hop_percentiles(hops(spark, d), "victim", F.count("*")).withColumns(R6("p90"))


@query("attr_mode", with_cases("SELECT victim, loc FROM (SELECT victim, loc, row_number() OVER (PARTITION BY victim ORDER BY count(*) DESC, loc) AS r FROM cases GROUP BY 1, 2) WHERE r = 1"))
def _(spark, d):
    return J.attribute_mode(cases(spark, d), "victim", "loc")


@query("traceroute", with_collapsed("SELECT CAST(row_number() OVER (ORDER BY ord) AS INTEGER) AS step, loc, actor FROM c WHERE victim = 'C7'"))
def _(spark, d):
    return J.traceroute(hops(spark, d), "victim", "loc", "ord", "C7", "actor")


@query("route_dag", with_hops("SELECT victim, 'Step ' || ord || ': ' || loc AS src, 'Step ' || (ord + 1) || ': ' || nxt AS dst FROM (SELECT victim, ord, loc, lead(loc) OVER (PARTITION BY victim ORDER BY ord) AS nxt FROM hops) WHERE nxt IS NOT NULL"))
def _(spark, d):
    return J.route_dag(hops(spark, d), "victim", "loc", "ord")


@query("victim_paths", with_collapsed("SELECT victim, string_agg(loc, '>' ORDER BY ord) AS path, string_agg(loc, '>' ORDER BY ord) FILTER (r <= 2) AS context FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY ord DESC) AS r FROM c) GROUP BY 1"))
def _(spark, d):
    rows = J.paths(hops(spark, d), "victim", "loc", "ord")
    return rows.select("victim", F.array_join("path", ">").alias("path"), F.array_join(J.last_context(F.col("path")), ">").alias("context"))


@query("append_final", with_collapsed("SELECT victim, string_agg(loc, '>' ORDER BY ord) || CASE WHEN arg_max(loc, ord) = 'NATION_3' THEN '' ELSE '>nation_3' END AS path FROM c GROUP BY 1"))
def _(spark, d):
    rows = J.paths(hops(spark, d), "victim", "loc", "ord")
    return rows.select("victim", F.array_join(J.append_final(F.col("path"), F.lit("nation_3")), ">").alias("path"))


@query(
    "arrivals",
    with_hops("SELECT victim, CAST(ord AS INTEGER) AS ord, round(days / 7, 2) AS weeks, cumulative, CAST(DATE '2020-01-01' + CAST(floor(cumulative) AS INTEGER) AS DATE) AS arrival FROM (SELECT victim, ord, days, sum(days) OVER (PARTITION BY victim ORDER BY ord ROWS UNBOUNDED PRECEDING) AS cumulative FROM (SELECT victim, ord, CAST(coalesce(gap_days, 7) AS DOUBLE) AS days FROM hops))"),
)
def _(spark, d):
    rows = hops(spark, d).select("victim", "ord", F.coalesce("gap_days", F.lit(7)).cast("double").alias("days"), F.to_date(F.lit("2020-01-01")).alias("start"))
    return J.arrivals(rows, "victim", "ord", "days", "start").select("victim", "ord", "weeks", "cumulative", "arrival")


@query("victim_trajectory", with_hops("SELECT CAST(ord AS INTEGER) AS ord, loc FROM hops WHERE victim = 'C11'"))
def _(spark, d):
    return hops(spark, d).where("victim = 'C11'").select("ord", "loc")


@query("stops_per_month", "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct("user_id").alias("n"))

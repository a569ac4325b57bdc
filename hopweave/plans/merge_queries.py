"""Queries of unions and merges, on three overlapping slices of the cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from hopweave.operators import merge as M
from hopweave.plans.register import query
from hopweave.plans.views import cases, table, with_cases

LISTS = ["perps", "chiefs"]
ORDER = ["c", "a"]


def sources(spark, d):
    """Tagged rows of three sources: the second has its perps reversed for some cases, the third lacks the first chief."""
    rows = cases(spark, d).select("case_id", "victim", "perps", "chiefs", "loc")
    a = rows.where("case_id % 3 <> 0")
    b = rows.where("case_id % 4 <> 0").withColumn("perps", F.when(F.col("case_id") % 5 == 0, F.reverse("perps")).otherwise(F.col("perps")))
    c = rows.where("case_id % 7 = 0").withColumn("chiefs", F.slice("chiefs", 2, 1000))
    out = M.tag({"a": a, "b": b, "c": c})
    return out.withColumn("key", M.merge_key(M.subject_key(F.lit(None).cast("string"), F.col("victim")), F.col("case_id"), F.col("loc")))


_SOURCES = """, base AS (SELECT case_id, victim, perps, chiefs, loc FROM cases),
s AS (
  SELECT *, victim || '||r=' || case_id || '||l=' || loc AS key, CASE source WHEN 'c' THEN 0 WHEN 'a' THEN 1 ELSE 1000000 END AS prio FROM (
    SELECT *, 'a' AS source, 0 AS source_order FROM base WHERE case_id % 3 <> 0
    UNION ALL SELECT case_id, victim, CASE WHEN case_id % 5 = 0 THEN list_reverse(perps) ELSE perps END, chiefs, loc, 'b', 1 FROM base WHERE case_id % 4 <> 0
    UNION ALL SELECT case_id, victim, perps, chiefs[2:], loc, 'c', 2 FROM base WHERE case_id % 7 = 0)),
x AS (SELECT key, count(*) AS n_rows, count(DISTINCT source) AS n_sources FROM s GROUP BY 1 HAVING count(DISTINCT perps) > 1 OR count(DISTINCT chiefs) > 1)
"""


def with_sources(sql: str) -> str:
    return with_cases("").rstrip() + _SOURCES + sql


_SHOWN = "key, source, array_to_string(perps, ';') AS perps, array_to_string(chiefs, ';') AS chiefs"


def shown(df):
    return df.select("key", "source", F.array_join("perps", ";").alias("perps"), F.array_join("chiefs", ";").alias("chiefs"))


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    a = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return M.union_by_name([a, table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")])


@query("edge_intersect", "SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber > 1")
def _(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_linenumber = 1").select("l_orderkey", "l_suppkey").intersect(rows.where("l_linenumber > 1").select("l_orderkey", "l_suppkey"))


@query("merge_conflicts", with_sources("SELECT key, n_rows, n_sources FROM x"))
def _(spark, d):
    return M.conflicts(sources(spark, d), "key", LISTS)


@query("merge_priority", with_sources(f"SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, source_order, case_id) AS n FROM s) WHERE n = 1"))
def _(spark, d):
    return shown(M.resolve(sources(spark, d), "key", LISTS, "priority", ORDER, "case_id"))


@query("merge_keep_last", with_sources(f"SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_order DESC, case_id) AS n FROM s) WHERE n = 1"))
def _(spark, d):
    return shown(M.resolve(sources(spark, d), "key", LISTS, "keep_last", ORDER, "case_id"))


_UNION = """, u AS (SELECT key, flatten(list(perps ORDER BY source_order)) AS ps, flatten(list(chiefs ORDER BY source_order)) AS cs FROM s GROUP BY key),
v AS (SELECT key, list_filter(ps, lambda p, i: list_position(ps, p) = i) AS ps, list_filter(cs, lambda p, i: list_position(cs, p) = i) AS cs FROM u)
"""


@query("merge_union_lists", with_sources("").rstrip() + _UNION + "SELECT v.key, source, array_to_string(ps, ';') AS perps, array_to_string(cs, ';') AS chiefs FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY prio, source_order, case_id) AS n FROM s) b JOIN v ON b.key = v.key WHERE n = 1")
def _(spark, d):
    return shown(M.resolve(sources(spark, d), "key", LISTS, "union_lists", ORDER, "case_id"))


@query(
    "merge_manual",
    with_sources("").rstrip() + _UNION + """, m AS (SELECT *, CASE WHEN case_id % 11 = 0 THEN 'union' WHEN case_id % 11 = 1 THEN 'choose' END AS decision FROM s)
SELECT b.key, source, array_to_string(CASE WHEN decision = 'union' THEN ps ELSE perps END, ';') AS perps, array_to_string(CASE WHEN decision = 'union' THEN cs ELSE chiefs END, ';') AS chiefs
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN decision = 'choose' AND source = 'b' THEN 0 ELSE 1 END, prio, source_order, case_id) AS n FROM m) b JOIN v ON b.key = v.key WHERE n = 1""",
)
def _(spark, d):
    rows = sources(spark, d)
    r = F.col("case_id") % 11
    decisions = rows.where(r <= 1).select("key", F.when(r == 0, "union").otherwise("choose").alias("decision"), F.lit("b").alias("choice")).distinct()
    return shown(M.resolve_manually(rows, "key", LISTS, decisions, ORDER, "case_id"))


@query("merge_summary", with_sources("SELECT (SELECT count(*) FROM s) AS rows_before, (SELECT count(DISTINCT key) FROM s) AS rows_after, (SELECT count(DISTINCT victim) FROM s) AS subjects, (SELECT count(*) FROM x) AS conflicts"))
def _(spark, d):
    rows = sources(spark, d)
    return M.summary(rows, M.resolve(rows, "key", LISTS, "priority", ORDER, "case_id"), "victim", "key", LISTS)


_REPORT = """, k AS (SELECT key, n_rows, n_sources FROM x ORDER BY key LIMIT 300),
ex AS (SELECT key, concat_ws(' / ', source, array_to_string(perps, ';'), array_to_string(chiefs, ';')) AS shown, row_number() OVER (PARTITION BY key ORDER BY source_order, perps, chiefs) AS r FROM s JOIN k USING (key))
SELECT k.key, n_rows, n_sources, examples FROM k JOIN (SELECT key, string_agg(shown, ' || ' ORDER BY shown) AS examples FROM ex WHERE r <= 3 GROUP BY 1) USING (key)"""


@query("merge_conflict_report", with_sources("").rstrip() + _REPORT)
def _(spark, d):
    return M.conflict_report(sources(spark, d), "key", LISTS)


@query("anti_join_conflicts", with_sources("SELECT key, source FROM s WHERE key NOT IN (SELECT key FROM x)"))
def _(spark, d):
    rows = sources(spark, d)
    return rows.join(M.conflicts(rows, "key", LISTS), "key", "left_anti").select("key", "source")

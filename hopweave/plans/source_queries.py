"""Queries of the catalog, readers and sinks: what is written to the shared folder is read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopweave.plans.register import query
from hopweave.plans.views import cases, table, with_cases
from hopweave.sources import readers, sinks
from hopweave.sources.catalog import Catalog, history, with_overrides
from hopweave.sources.shared import shared_folder


def folder(spark) -> str:
    return f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"


def filled(spark, d) -> tuple[Catalog, dict[str, str]]:
    """A catalog with a dataset of the nations of each region and two artifacts about it, and the datasets' ids by region.

    Kinds, formats, owners and titles follow from the region's key.
    """
    c, ids = Catalog(spark, folder(spark)), {}
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sizes = {r["n_regionkey"]: r["n"] for r in nation.groupBy("n_regionkey").agg(F.count("*").alias("n")).collect()}
    for r in table(spark, d, "region").orderBy("r_regionkey").collect():
        k, name = r["r_regionkey"], r["r_name"]
        own = nation.where(F.col("n_regionkey") == k).drop("n_regionkey")
        ids[name] = c.save(own, name, "raw" if k % 2 else "processed", owner=f"owner {k % 2}", fmt="parquet" if k % 3 else "csv")
        c.save_json({"nations": sizes.get(k, 0)}, f"run {name}", "prediction", owner=f"owner {k % 2}", extra={"title": f"{name}: {sizes.get(k, 0)}"} if k % 2 else None)
        c.save_text(f"<{name}> <a> <region> .", f"graph {name}", "ontology", ext="ttl")
    return c, ids


_ENTRIES = """WITH n AS (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), e AS (
  SELECT r_regionkey AS k, r_name AS name, CASE WHEN r_regionkey % 2 = 1 THEN 'raw' ELSE 'processed' END AS kind, 'owner ' || r_regionkey % 2 AS owner, NULL AS title, false AS artifact FROM region
  UNION ALL SELECT r_regionkey, 'run ' || r_name, 'prediction', 'owner ' || r_regionkey % 2, CASE WHEN r_regionkey % 2 = 1 THEN r_name || ': ' || coalesce(c, 0) END, true FROM region LEFT JOIN n ON n_regionkey = r_regionkey
  UNION ALL SELECT r_regionkey, 'graph ' || r_name, 'ontology', NULL, NULL, true FROM region)
"""


@query("catalog_load", "SELECT r_name AS dataset, CAST(n_nationkey AS VARCHAR) AS k, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    c, ids = filled(spark, d)
    parts = [c.load_any(i).select(F.lit(name).alias("dataset"), F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")) for name, i in ids.items()]
    return reduce(DataFrame.unionAll, parts)


@query(
    "catalog_lists",
    _ENTRIES + "SELECT 'all' AS list, name FROM e UNION ALL SELECT 'owned', name FROM e WHERE owner = 'owner 1' UNION ALL SELECT 'artifacts', name FROM e WHERE artifact UNION ALL SELECT 'recent', name FROM (SELECT name FROM e WHERE kind = 'prediction' ORDER BY k DESC LIMIT 2)",
)
def _(spark, d):
    c, _ = filled(spark, d)
    lists = {"all": c.entries(), "owned": c.find(owner="owner 1"), "artifacts": c.artifacts(), "recent": c.recent("prediction", 2)}
    return reduce(DataFrame.unionAll, [rows.select(F.lit(name).alias("list"), "name") for name, rows in lists.items()])


@query("catalog_counts", _ENTRIES + "SELECT kind, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    return filled(spark, d)[0].counts()


@query("history_view", _ENTRIES + "SELECT CASE kind WHEN 'prediction' THEN 'Run' ELSE 'Graph' END AS what, coalesce(title, name) AS title, owner FROM e WHERE artifact")
def _(spark, d):
    return history(filled(spark, d)[0].entries(), {"prediction": "Run", "ontology": "Graph"}).select("what", "title", "owner")


@query("overlay", _ENTRIES + "SELECT CASE WHEN NOT artifact AND k % 2 = 0 THEN 'new ' || name ELSE name END AS name FROM e WHERE artifact OR k % 4 <> 3")
def _(spark, d):
    c, _ = filled(spark, d)
    known = c.entries().where("NOT format IN ('json', 'ttl')").join(table(spark, d, "region"), F.col("name") == F.col("r_name"))
    over = known.select("id", F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("new "), "name")).alias("name"), (F.col("r_regionkey") % 4 == 3).alias("deleted"))
    return with_overrides(c.entries(), over).select("name")


@query("catalog_changes", "SELECT r_name || CASE WHEN r_regionkey % 2 = 0 THEN ' (renamed)' ELSE '' END AS name, CAST(r_regionkey * 2 AS VARCHAR) AS score, CASE WHEN r_regionkey = (SELECT max(r_regionkey) FROM region WHERE r_regionkey % 2 = 0) THEN true ELSE false END AS active FROM region WHERE r_regionkey % 4 <> 3")
def _(spark, d):
    c, ids = filled(spark, d)
    for k, name in table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect():
        c.update(ids[name], extra={"score": k})
        c.update(ids[name], extra={"score": 2 * k})
        if k % 2 == 0:
            c.rename(ids[name], f"{name} (renamed)")
            c.activate(ids[name], "dataset")
        if k % 4 == 3:
            c.delete(ids[name])
    return c.entries().where(F.col("kind").isin("raw", "processed")).select("name", F.col("extra")["score"].alias("score"), (F.col("id") == c.active("dataset")).alias("active"))


@query("load_processed", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN [c_mktsegment] ELSE NULL END AS seg FROM customer")
def _(spark, d):
    c = Catalog(spark, folder(spark))
    rows = table(spark, d, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN ' NaN ' WHEN 2 THEN concat(' ', c_name) END").alias("name"), F.array("c_mktsegment").alias("seg"))
    even, odd = c.save(rows.where("c_custkey % 2 = 0"), "even", "processed"), c.save(rows.where("c_custkey % 2 = 1").drop("seg"), "odd", "merged")
    other = c.save(rows, "other", "raw")
    return c.load_processed([even, odd, other], ["c_custkey", "name"]).select("c_custkey", "name", "seg")


@query("token_lines", "SELECT DISTINCT unnest([n_name, 'New ' || n_name]) AS token FROM nation UNION SELECT 'bare' UNION SELECT 'words'")
def _(spark, d):
    path = folder(spark)
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    lines = table(spark, d, "nation").select(F.concat(F.lit("["), quoted(F.col("n_name")), F.lit(" "), quoted(F.concat(F.lit("New "), "n_name")), F.lit("]")).alias("line"))
    sinks.write_lines(lines.unionAll(spark.range(1).select(F.lit("[bare words]"))), path)
    return readers.read_tokens(spark, path)


@query("csv_lists", with_cases("SELECT CAST(case_id AS VARCHAR) AS case_id, array_to_string(perps, ';') AS perps, loc FROM cases"))
def _(spark, d):
    path = folder(spark)
    sinks.write_csv(cases(spark, d).select("case_id", "perps", "loc"), path)
    return readers.read_csv(spark, path)


@query("query_set", "SELECT CAST(item_id AS VARCHAR) AS qid, trim(text) AS text, CASE item_id % 3 WHEN 0 THEN 'a' || item_id || ':2' WHEN 1 THEN 'b:0' ELSE '' END AS judged FROM benchmark WHERE trim(coalesce(text, '')) <> ''")
def _(spark, d):
    path = folder(spark)
    item = table(spark, d, "benchmark").withColumn("k", F.col("item_id").cast("string"))
    one = item.where("item_id % 3 = 0").select(F.col("k").alias("qid"), "text", F.expr("array(named_struct('doc_id', concat('a', k), 'grade', 2), named_struct('doc_id', 'x', 'grade', cast(null as int)))").alias("relevance"))
    one = one.withColumn("relevance", F.expr("filter(relevance, x -> x.grade is not null)"))
    two = item.where("item_id % 3 = 1").select(F.col("item_id").alias("id"), F.concat(F.lit(" "), "text").alias("query"))
    two = two.withColumn("labels", F.expr("array(named_struct('uid', 'b', 'grade', '0'), named_struct('uid', 'c', 'grade', 'high'))"))
    three = item.where("item_id % 3 = 2").select(F.col("k").alias("query_id"), "text").unionAll(item.limit(1).select(F.lit(" "), "text"))
    for n, part in enumerate((one, two, three)):
        part.write.json(f"{path}/{n}")
    rows = readers.read_queries(spark, f"{path}/*")
    return rows.select("qid", "text", F.array_join(F.transform("relevance", lambda x: F.concat_ws(":", x["doc_id"], x["grade"].cast("string"))), ",").alias("judged"))

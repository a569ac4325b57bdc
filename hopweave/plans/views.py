"""Canonical views that let the trajectory operators run on star-schema tables.

HOPS_SQL and the like are the same views in SQL, for the queries' checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of lineitem for each task of a shuffle, about.
ROWS = 500_000


def roomy(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys to n tasks where spark.sql.shuffle.partitions are fewer, so that a task's share does not grow with the tables."""
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shares(rows: DataFrame) -> int:
    """How many tasks have about ROWS of these rows each; a table's count comes from the footers of its files."""
    return -(-rows.count() // ROWS)


#: Columns that order the hops of a subject completely.
HOP_ORDER = ("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject and hop: victim, loc, ord, gap_days (days since the hop before), actor, when."""
    t = lambda n: table(spark, sf_dir, n)
    n = shares(t("lineitem"))
    rows = (
        roomy(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"), n, "l_orderkey")
        .join(t("orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("victim"), "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("supplier").select("s_suppkey", "s_nationkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    # operators that partition by subject go on in the same tasks
    w = W.partitionBy("victim").orderBy(*HOP_ORDER)
    return roomy(rows, n, "victim").select(
        "victim",
        F.col("n_name").alias("loc"),
        F.row_number().over(w).alias("ord"),
        F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("gap_days"),
        F.col("s_name").alias("actor"),
        F.to_date("o_orderdate").alias("on_date"),
    )


HOPS_SQL = """
SELECT 'C' || o_custkey AS victim, n_name AS loc, row_number() OVER w AS ord,
       date_diff('day', CAST(lag(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE)) AS gap_days,
       s_name AS actor, CAST(o_orderdate AS DATE) AS on_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice)
"""


def with_hops(sql: str) -> str:
    return f"WITH hops AS ({HOPS_SQL}) {sql}"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: case_id, victim, perps and chiefs (sorted distinct arrays), gender, nat, year, loc, opened."""
    t = lambda n: table(spark, sf_dir, n)
    n = shares(t("lineitem"))
    rows = (
        t("lineitem")
        .select("l_orderkey", "l_suppkey", "l_partkey")
        .join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    )
    lists = roomy(rows, n, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("perps"), F.array_sort(F.collect_set("p_brand")).alias("chiefs"))
    heads = roomy(t("orders"), n, "o_custkey").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    # lists stay where they are made
    return (
        heads.join(lists, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.col("o_orderkey").alias("case_id"),
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("victim"),
            "perps",
            "chiefs",
            F.col("c_mktsegment").alias("gender"),
            F.col("n_name").alias("nat"),
            F.year("o_orderdate").alias("year"),
            F.col("o_orderpriority").alias("loc"),
            F.to_date("o_orderdate").alias("opened"),
            F.col("o_totalprice").alias("amount"),
        )
    )


CASES_SQL = """
SELECT o_orderkey AS case_id, 'C' || o_custkey AS victim, perps, chiefs, c_mktsegment AS gender, n_name AS nat,
       year(o_orderdate) AS year, o_orderpriority AS loc, CAST(o_orderdate AS DATE) AS opened, o_totalprice AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN (SELECT l_orderkey, list_sort(list_distinct(list(s_name))) AS perps, list_sort(list_distinct(list(p_brand))) AS chiefs
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey
"""


def with_cases(sql: str) -> str:
    return f"WITH cases AS ({CASES_SQL}) {sql}"


def event_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped trajectories: victim, loc, happened (timestamp), event_id, k (a number from the event's JSON), value."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("victim"), F.col("event_type").alias("loc"), F.col("ts").cast("timestamp").alias("happened"), "event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), "value"
    )


EVENT_HOPS_SQL = "SELECT user_id AS victim, event_type AS loc, ts AS happened, event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events"


def with_event_hops(sql: str) -> str:
    return f"WITH event_hops AS ({EVENT_HOPS_SQL}) {sql}"


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, lat, lon, country, population, alt_list of each nation; coordinates are made up from its key."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") * 7 - 84).cast("double").alias("lat"),
        (F.col("n_nationkey") * 14 - 168).cast("double").alias("lon"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("country"),
        (F.lit(1000) * (F.col("n_nationkey") + 1)).cast("long").alias("population"),
        F.array(F.concat(F.lit("N-"), F.col("n_nationkey").cast("string"))).alias("alt_list"),
    )


GAZETTEER_SQL = """
SELECT n_name AS name, CAST(n_nationkey * 7 - 84 AS DOUBLE) AS lat, CAST(n_nationkey * 14 - 168 AS DOUBLE) AS lon, 'R' || n_regionkey AS country,
       CAST(1000 * (n_nationkey + 1) AS BIGINT) AS population, ['N-' || n_nationkey] AS alt_list FROM nation
"""


def actor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (victim, actor) pairs."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("victim"), F.col("l_suppkey").alias("actor")).distinct()


ACTOR_EDGES_SQL = "SELECT DISTINCT o_custkey AS victim, l_suppkey AS actor FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (event, actor) pairs: the actors that do something for a subject on a day."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.concat_ws("|", "o_custkey", F.to_date("l_shipdate").cast("string")).alias("event"), F.col("l_suppkey").alias("actor")).distinct()


MEETINGS_SQL = "SELECT DISTINCT o_custkey || '|' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS event, l_suppkey AS actor FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

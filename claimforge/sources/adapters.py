"""Views that give the star-schema tables the roles of the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.session import table


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as claims about their order."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END").alias("weight"),
        (F.col("l_linestatus") == "F").alias("confirmed"), (F.col("l_tax") >= 0.08).alias("decided_against"),
        F.col("l_shipdate").alias("fetched_at"), F.col("l_quantity").alias("value_num"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("value_date"),
        F.expr("element_at(array('announced','permitting','construction','operational','paused','cancelled'), int(l_linenumber % 6) + 1)").alias("value_phase"),
        F.expr("concat('s', lpad(l_suppkey, 8, '0'), '-', lpad(l_partkey, 8, '0'), '-', l_linenumber)").alias("url"),
        "l_suppkey", "l_partkey", "l_linenumber")


#: The same for DuckDB.
CLAIM = """claim AS (
  SELECT l_orderkey AS project_id, CASE l_returnflag WHEN 'A' THEN 3 WHEN 'N' THEN 2 ELSE 1 END AS weight,
         l_linestatus = 'F' AS confirmed, l_tax >= 0.08 AS decided_against, l_shipdate AS fetched_at, l_quantity AS value_num,
         strftime(l_shipdate, '%Y-%m-%d') AS value_date,
         (['announced','permitting','construction','operational','paused','cancelled'])[CAST(l_linenumber % 6 AS INT) + 1] AS value_phase,
         's' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || CAST(l_linenumber AS VARCHAR) AS url,
         l_suppkey, l_partkey, l_linenumber
  FROM lineitem)"""


def projects(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer and nation as projects."""
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("state"),
        F.col("o_totalprice").alias("mw"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'announced' WHEN 'P' THEN 'construction' ELSE 'operational' END").alias("phase"),
        F.to_date("o_orderdate").alias("announced"), F.expr("int(o_orderkey % 4)").alias("confidence"), F.col("o_custkey").alias("custkey"))


PROJECT = """project AS (
  SELECT o_orderkey AS id, c_name AS company, c_mktsegment AS segment, n_name AS state, o_totalprice AS mw,
         CASE o_orderstatus WHEN 'O' THEN 'announced' WHEN 'P' THEN 'construction' ELSE 'operational' END AS phase,
         CAST(o_orderdate AS DATE) AS announced, CAST(o_orderkey % 4 AS INT) AS confidence, o_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def risks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as risks: category, severity by quantity, status by line status."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.expr("element_at(array('power','water','permit','labour','finance'), int(l_partkey % 5) + 1)").alias("category"),
        F.expr("CASE WHEN l_quantity >= 40 THEN 'blocking' WHEN l_quantity >= 20 THEN 'material' ELSE 'watch' END").alias("severity"),
        F.expr("CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 1 END").alias("severity_rank"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'resolved' END").alias("status"),
        F.to_date("l_shipdate").alias("first_seen"), (F.col("l_suppkey") % 3 == 0).alias("quoted"),
        F.expr("lower(concat(l_returnflag, ' ', l_linenumber % 3))").alias("summary"),
        F.expr("concat(lpad(l_linenumber, 2, '0'), '-', lpad(l_partkey, 8, '0'), '-', lpad(l_suppkey, 8, '0'), '-', date_format(l_shipdate, 'yyyyMMdd'))").alias("risk_id"))


RISK = """risk AS (
  SELECT l_orderkey AS project_id, (['power','water','permit','labour','finance'])[CAST(l_partkey % 5 AS INT) + 1] AS category,
         CASE WHEN l_quantity >= 40 THEN 'blocking' WHEN l_quantity >= 20 THEN 'material' ELSE 'watch' END AS severity,
         CASE WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 20 THEN 2 ELSE 1 END AS severity_rank,
         CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'resolved' END AS status, CAST(l_shipdate AS DATE) AS first_seen,
         l_suppkey % 3 = 0 AS quoted, lower(l_returnflag || ' ' || CAST(l_linenumber % 3 AS VARCHAR)) AS summary,
         lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') || '-' || strftime(l_shipdate, '%Y%m%d') AS risk_id
  FROM lineitem)"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with host, source weight and status as a publisher's queue."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")
    return table(spark, d, "pages").select(
        "page_id", "url", host.alias("host"), F.length("html").cast("long").alias("size"),
        F.expr("element_at(array('ok','thin','no_project','failed','pending','ok','ok'), int(page_id % 7) + 1)").alias("status"),
        F.expr("CASE WHEN page_id % 11 = 0 THEN NULL ELSE concat('feed', page_id % 9) END").alias("feed"))


PAGE = r"""page AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, CAST(length(html) AS BIGINT) AS size,
         (['ok','thin','no_project','failed','pending','ok','ok'])[CAST(page_id % 7 AS INT) + 1] AS status,
         CASE WHEN page_id % 11 = 0 THEN NULL ELSE 'feed' || CAST(page_id % 9 AS VARCHAR) END AS feed
  FROM pages)"""

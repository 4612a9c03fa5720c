"""The examination entities as views over the given tables, and the same views as SQL.

orders: evaluations (one for each answer book); lineitem: question marks; part: questions;
customer: examiners, whose market segment is the exam; supplier: moderators; nation and region:
institutions and their groups; documents: answer pages (source: the book); events: the event bus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"O": "IN_PROGRESS", "P": "SUBMITTED", "F": "APPROVED"}
MARK_STATUS = {"A": "MARKED", "R": "FLAGGED", "N": "NOT_ATTEMPTED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recoded(col: str, names: dict[str, str]) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("evaluation_id"),
        F.col("o_custkey").alias("examiner_id"),
        recoded("o_orderstatus", STATUS).alias("status"),
        F.col("o_totalprice").alias("total_marks"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderpriority").alias("paper_set"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "RESCAN_REQUIRED").otherwise("PASSED").alias("quality_status"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("evaluation_id"),
        F.col("l_linenumber").alias("question_number"),
        F.col("l_partkey").alias("question_id"),
        F.col("l_suppkey").alias("moderator_id"),
        F.col("l_quantity").alias("marks"),
        F.col("l_extendedprice").alias("amount"),
        recoded("l_returnflag", MARK_STATUS).alias("mark_status"),
        (F.col("l_linestatus") == "F").alias("reviewed"),
        F.col("l_shipdate").alias("marked_at"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_size").alias("max_marks"), F.col("p_name").alias("text"), F.col("p_brand").alias("paper"))


def examiners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("examiner_id"), F.col("c_name").alias("examiner_name"), F.col("c_mktsegment").alias("exam"), F.col("c_nationkey").alias("institution_id"), F.col("c_acctbal").alias("load")
    )


def moderators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("moderator_id"), F.col("s_name").alias("moderator_name"), F.col("s_nationkey").alias("institution_id"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select(F.col("n_nationkey").alias("institution_id"), F.col("n_name").alias("institution"), F.col("r_name").alias("institution_group"))


#: The same views for SQL; a query goes on with ``, more AS (...)`` or ``SELECT``.
SQL = """WITH evaluations AS (
  SELECT o_orderkey AS evaluation_id, o_custkey AS examiner_id,
         CASE o_orderstatus WHEN 'O' THEN 'IN_PROGRESS' WHEN 'P' THEN 'SUBMITTED' WHEN 'F' THEN 'APPROVED' END AS status,
         o_totalprice AS total_marks, o_orderdate AS started_at, o_orderpriority AS paper_set,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'RESCAN_REQUIRED' ELSE 'PASSED' END AS quality_status FROM orders),
marks AS (
  SELECT l_orderkey AS evaluation_id, l_linenumber AS question_number, l_partkey AS question_id, l_suppkey AS moderator_id,
         l_quantity AS marks, l_extendedprice AS amount,
         CASE l_returnflag WHEN 'A' THEN 'MARKED' WHEN 'R' THEN 'FLAGGED' WHEN 'N' THEN 'NOT_ATTEMPTED' END AS mark_status,
         l_linestatus = 'F' AS reviewed, l_shipdate AS marked_at FROM lineitem),
questions AS (SELECT p_partkey AS question_id, p_size AS max_marks, p_name AS text, p_brand AS paper FROM part),
examiners AS (SELECT c_custkey AS examiner_id, c_name AS examiner_name, c_mktsegment AS exam, c_nationkey AS institution_id, c_acctbal AS load FROM customer),
moderators AS (SELECT s_suppkey AS moderator_id, s_name AS moderator_name, s_nationkey AS institution_id FROM supplier),
institutions AS (SELECT n_nationkey AS institution_id, n_name AS institution, r_name AS institution_group FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)
"""

"""Views over the given tables, in the shapes that the operators expect, and the same views as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-item events with a rating of 1 to 5 from the event's value."""
    item = F.get_json_object("props", "$.k").cast("long")
    rating = F.least(F.lit(5.0), 1 + F.floor(F.col("value") / 25)).cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", item.alias("item_id"), F.col("event_type").alias("interaction_type"), rating.alias("rating"), "value", F.col("ts").cast("timestamp").alias("ts"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as long histories with a rating of 1 to 5 from the quantity."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + (F.col("l_quantity") - 1) % 5).cast("double").alias("rating"), F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with title, genres (the words of the name), type, creator, duration, popularity."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("content_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("genres"), F.col("p_type").alias("content_type"), F.col("p_brand").alias("creator"), F.col("p_size").alias("duration"), F.col("p_retailprice").cast("double").alias("popularity_score"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their group, location and region."""
    customer, nation, region = (table(spark, sf_dir, n) for n in ("customer", "nation", "region"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", F.col("n_name").alias("location"), F.col("r_name").alias("region"))
    # nations and regions are fixed lists of a few rows
    return customer.join(F.broadcast(places), customer["c_nationkey"] == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("user_group"), "location", "region", F.col("c_acctbal").cast("double").alias("income"))


#: The same views for DuckDB, to stand after WITH.
INTERACTIONS = """interactions AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
  event_type AS interaction_type, CAST(least(5.0, 1 + floor(value / 25)) AS DOUBLE) AS rating, value, ts FROM events)"""
PURCHASES = """purchases AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(1 + (l_quantity - 1) % 5 AS DOUBLE) AS rating,
  CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CONTENT = """content AS (SELECT p_partkey AS content_id, p_name AS title, string_split(p_name, ' ') AS genres, p_type AS content_type,
  p_brand AS creator, p_size AS duration, CAST(p_retailprice AS DOUBLE) AS popularity_score FROM part)"""
USERS = """users AS (SELECT c_custkey AS user_id, c_mktsegment AS user_group, n_name AS location, r_name AS region,
  CAST(c_acctbal AS DOUBLE) AS income FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

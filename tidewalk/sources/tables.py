"""The recommender's entities over the event log and the item table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewalk.functions.scalar import interaction_weight

#: The moment that batch queries take as present.
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_interactions(events: DataFrame) -> DataFrame:
    """id, user_id, project_id, created_at, type, weight of each event; works on batches and streams."""
    kind, n = F.col("event_type"), F.col("event_id")
    even = n % 2 == 0
    named = (
        F.when(kind == "view", F.when(even, "IMPRESSION").otherwise("OPEN")).when(kind == "click", F.when(n % 5 == 0, "UNSAVE").otherwise("SAVE"))
        .when(kind == "signup", "SHARE").when(kind == "purchase", F.when(even, "BUILD").otherwise("COMPLETE")).when(kind == "error", "DISLIKE")
    )
    out = events.select(n.alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("project_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), named.alias("type"))
    return out.withColumn("weight", interaction_weight(F.col("type")))


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    return as_interactions(table(spark, folder, "events"))


def as_catalog(parts: DataFrame) -> DataFrame:
    """project_id, slug, title, tag_slugs, language_slugs, difficulty, estimated_hours, prior of each item."""
    kind = F.col("p_type")
    difficulty = F.when(kind.startswith("ECONOMY") | kind.startswith("SMALL"), "BEGINNER").when(kind.startswith("MEDIUM") | kind.startswith("STANDARD"), "INTERMEDIATE").otherwise("ADVANCED")
    return parts.select(
        F.col("p_partkey").alias("project_id"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("slug"), F.col("p_name").alias("title"),
        F.array_distinct(F.split("p_name", " ")).alias("tag_slugs"), F.array(F.lower("p_brand")).alias("language_slugs"), difficulty.alias("difficulty"),
        F.col("p_size").alias("estimated_hours"), ((F.col("p_partkey") * 37 % 101) / F.lit(100.0)).alias("prior"),
    )


def catalog(spark: SparkSession, folder: str, log: DataFrame | None = None) -> DataFrame:
    """The items that the event log knows; log: the interactions, if they are at hand."""
    used = (interactions(spark, folder) if log is None else log).select("project_id").distinct()
    return as_catalog(table(spark, folder, "part")).join(used, "project_id", "left_semi")


def users(spark: SparkSession, folder: str, log: DataFrame | None = None) -> DataFrame:
    """user_id and exploration preference e; log: the interactions, if they are at hand."""
    return (interactions(spark, folder) if log is None else log).select("user_id").distinct().withColumn("e", (F.col("user_id") % 21) / F.lit(20.0))

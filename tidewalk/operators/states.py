"""What a user's events say about an item, without folding them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewalk.config import CONFIG


def project_states(interactions: DataFrame) -> DataFrame:
    """One row per user and item: flags, saved_at, interaction_count and the first touch.

    The last of SAVE, UNSAVE and DISLIKE decides ``saved``, the last of SAVE and DISLIKE ``disliked``; the other flags
    and ``excluded`` never go back.
    """
    kind, order = F.col("type"), F.struct("created_at", "id")
    last = lambda *kinds: F.max(F.when(kind.isin(*kinds), F.struct(order.alias("o"), kind.alias("k"))))["k"]
    ever = lambda *kinds: F.max(kind.isin(*kinds))
    states = interactions.groupBy("user_id", "project_id").agg(
        F.coalesce(last("SAVE", "UNSAVE", "DISLIKE") == "SAVE", F.lit(False)).alias("saved"),
        F.coalesce(last("SAVE", "DISLIKE") == "DISLIKE", F.lit(False)).alias("disliked"),
        F.max(F.when(kind == "SAVE", F.col("created_at"))).alias("last_save"),
        ever("BUILD").alias("built"), ever("COMPLETE").alias("completed"), ever("OPEN").alias("opened"), ever("SHARE").alias("shared"),
        ever(*CONFIG.excluding).alias("excluded"), F.count("*").alias("interaction_count"), F.min("created_at").alias("first_touch"),
    )
    return states.withColumn("saved_at", F.when(F.col("saved"), F.col("last_save"))).drop("last_save")


def user_stats(interactions: DataFrame, states: DataFrame) -> DataFrame:
    """Counts of each type over the full history, and of items by state."""
    counts = interactions.groupBy("user_id").agg(*[F.count(F.when(F.col("type") == k, 1)).alias(k.lower()) for k in CONFIG.weights], F.count("*").alias("total"))
    items = states.groupBy("user_id").agg(*[F.count(F.when(F.col(c), 1)).alias(f"{c}_items") for c in ("saved", "disliked", "built", "completed")])
    return counts.join(items, "user_id")


def catalog_stats(catalog: DataFrame, users: DataFrame, interactions: DataFrame) -> DataFrame:
    """Five totals in one row."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    tags, langs = catalog.select(F.explode("tag_slugs").alias("t")).distinct(), catalog.select(F.explode("language_slugs").alias("t")).distinct()
    parts = [count(catalog, "projects"), count(tags, "tags"), count(langs, "languages"), count(users, "users"), count(interactions, "interactions")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)  # one row each
    return out
